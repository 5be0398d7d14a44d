import hashlib
import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import intake, normalize, report, sessions
from ledgerloom.plans.model import SCENARIOS, ReconciliationError, Session, Source
from ledgerloom.sources import json_records



def invoice(i, doc, pretax, **more):
    return {"id": i, "sourceId": "i", "sourceRow": int(i[1:]), "date": "2026-03-05", "docNo": doc, "series": "1C26TAA", "partnerTaxId": "0100000001", "partnerName": "Công ty A", "pretaxAmount": pretax, "vatAmount": pretax / 10, "totalAmount": pretax * 1.1, **more}


def entry(i, doc, pretax, **more):
    return {"id": i, "sourceId": "l", "sourceRow": int(i[1:]), "date": "2026-03-06", "docNo": doc, "series": "1C26TAA", "partnerTaxId": "0100000001", "pretaxAmount": pretax, "totalAmount": pretax, "debitAccount": "131", "creditAccount": "5111", "description": f"Doanh thu {doc}", **more}


#: Three that agree, one booked in two parts, one that no entry has and one number given twice; and an entry without an invoice.
INVOICES = [invoice("i1", "0000201", 1000), invoice("i2", "0000202", 2000, vatAmount=None), invoice("i3", "203", 3000), invoice("i4", "204", 900), invoice("i5", "205", 50), invoice("i6", "206", 70), invoice("i7", "206", 70)]
ENTRIES = [entry("l1", "201", 1000), entry("l2", "202", 2000), entry("l3", "204", 400), entry("l4", "204", 500), entry("l5", "205", 50), entry("l6", "999", 12)]


@pytest.fixture
def files(tmp_path):
    """Canonical records as JSON documents, as the wire has them."""
    out = {}
    for name, rows in (("invoices", INVOICES), ("entries", ENTRIES)):
        out[name] = str(tmp_path / f"{name}.json")
        Path(out[name]).write_text(json.dumps(rows, ensure_ascii=False))
    return out



def test_content_comes_by_id_then_path_then_disk(tmp_path):
    disk = tmp_path / "a.xlsx"
    disk.write_bytes(b"disk")
    s = Source("a", "custom", path=str(disk))
    assert sessions.content(s, {"a": b"id"}, {str(disk): b"path"}) == b"id"
    assert sessions.content(s, {"b": b"id"}, {str(disk): b"path"}) == b"path"
    assert sessions.content(s) == b"disk"
    with pytest.raises(ReconciliationError):
        sessions.content(replace(s, path=""))


def test_roles_and_semantics():
    sources = (Source("x", "ledger511"), Source("y", "e_invoice"), Source("z", "cash_book"))
    made = sessions.assign_roles(sources, {"e_invoice": "PRIMARY", "ledger511": "OPTIONAL"})
    assert [s.role for s in made] == ["OPTIONAL", "PRIMARY", "SECONDARY"]
    assert [s.role for s in sessions.assign_roles(sources, {})] == ["PRIMARY", "SECONDARY", "SECONDARY"]
    session = SCENARIOS["scenario_revenue_vat_receivables"].session("s", sources[:2])
    assert sessions.active_semantics(session.rules, sources) == ["REVENUE"]
    assert sessions.first_rule(session, "e_invoice", "ledger511").tolerance == 10
    assert sessions.first_rule(session, "e_invoice", "cash_book") is None


def test_reference_sources_go():
    sources = (Source("m", "partner_master", role="PRIMARY"), Source("l", "ledger511"), Source("i", "e_invoice"))
    left = sessions.without_references(Session("s", sources, primary_id="m", expected_primary_kind="partner_master", required_ids=("m", "l")))
    assert [s.id for s in left.sources] == ["l", "i"] and left.primary_id == "i" and left.expected_primary_kind is None and left.required_ids == ("l",)


def test_parts_merge_and_ids_follow(spark):
    rows = lambda n: spark.createDataFrame([(f"{n}{i}", i, f"{n}{i}", "S", f"2026-01-{i + 1:02}", "01", float(i)) for i in range(5)], "id string, pos bigint, doc_no string, series string, date string, partner_tax_id string, total_amount double").withColumns({c: F.lit(None).cast("string") for c in ("voucher_no", "debit_account", "credit_account", "debit_amount", "credit_amount")})
    records = {"a": rows("a"), "b": rows("b"), "copy": rows("a")}
    session = Session("s", tuple(Source(n, "ledger511", n, path=n) for n in records), primary_id="copy", required_ids=("a", "b", "copy"))
    made, out, n = sessions.merge_logical(session, records)
    assert len(made.sources) == 1 and made.primary_id == made.sources[0].id and made.required_ids == (made.primary_id,)
    assert n == {"physical": 3, "unique": 2, "exact_duplicates": 0, "content_duplicates": 1, "logical": 1}
    assert sorted(r.id for r in out[made.primary_id].collect()) == [f"{made.primary_id}_rec_{i:05}" for i in range(1, 11)]
    with pytest.raises(ReconciliationError, match="DATASET_CONFLICT"):
        sessions.merge_logical(session, records | {"copy": rows("a").unionByName(rows("c"))})


def test_json_records(spark, files):
    rows = json_records.read_records(spark, files["invoices"])
    assert rows.count() == 7 and rows.where("total_amount IS NULL").count() == 0 and rows.where("vat_amount IS NULL").count() == 1
    assert rows.where("id = 'i1'").first().doc_no == "0000201"
    again = json_records.from_documents(json_records.to_documents(rows)).drop("pos")
    assert sorted(again.collect(), key=str) == sorted(rows.drop("pos").collect(), key=str)


def test_session_from_json_to_json(spark, files, tmp_path):
    from ledgerloom.operators import matching

    read = lambda name: json_records.read_records(spark, files[name])
    session = replace(SCENARIOS["scenario_revenue_standard"].session("e2e", (Source("i", "e_invoice", role="PRIMARY"), Source("l", "ledger511"))))
    session = replace(session, rules=tuple(replace(r, secondary_field="pretaxAmount") for r in session.rules))
    frames = matching.reconcile(session, {"i": read("invoices"), "l": read("entries")})
    one = frames.summary.first()
    assert (one.exact_matches_count, one.aggregate_matches_count, one.missing_in_target_count, one.missing_in_source_count) == (3, 1, 3, 1)
    json_records.write_result(frames, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/groups").count() == frames.groups.count()
    sheet = report.report_sheet(frames, primary_name="Hóa đơn")
    assert sheet.columns == list(report.REPORT_TITLES.values()) and [r.STT for r in sheet.collect()] == list(range(1, sheet.count() + 1))


def test_titles_that_repeat(spark):
    rows = spark.createDataFrame([("s", 1, ["01/01/2026", "7", "100", "first", "second", ""]), ("s", 2, ["02/01/2026", "8", "200", "only", "", "x"])], "source_id string, row_idx bigint, cells array<string>")
    columns = ["Ngày", "Số", "Tiền", "Ghi chú", "Ghi chú", "Khác"]
    got = normalize.canonical(rows, Source("s", "custom", mapping={"date": "Ngày", "doc_no": "Số", "total_amount": "Tiền"}), columns).orderBy("pos").collect()
    assert [r.raw_fields["Ghi chú"] for r in got] == ["second", "only"] and "Khác" not in got[0].raw_fields


def test_money_and_time(spark):
    texts = {None: "0", "": "0", "-": "0", "1.250.000 ₫": "1250000", "500.000": "500000", "1250000.50": "1250000.50", "(1.000,5)": "-1000.5", "-7,00": "-7", ",5": "0.5", "-0": "0"}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "x string, want string")
    assert df.where(~S.lenient_money(F.col("x")).eqNullSafe(F.col("want"))).collect() == []
    assert spark.range(1).select(S.executed_at().alias("t")).first().t.endswith("+00:00")


def test_sessions_as_documents():
    for scenario in SCENARIOS.values():
        session = scenario.session("s", (Source("a", "e_invoice", "Hóa đơn", "PRIMARY", mapping={"doc_no": "Số HĐ"}), Source("b", "ledger511", header_row=3)))
        assert json_records.read_session(json_records.session_document(session)) == session
    for bad, code in {"[1]": "NOT_A_SESSION", "{": "NOT_A_SESSION", '{"id": "s"}': None, '{"id": "s", "sources": [], "extra": 1}': "UNKNOWN_FIELD", '{"id": "s", "sources": [{"id": "a"}]}': "FIELD_MISSING"}.items():
        if code:
            with pytest.raises(ReconciliationError, match=code):
                json_records.read_session(bad)
        else:
            assert json_records.read_session(bad).sources == ()


def test_results_as_documents_with_the_last_control_of_each_source(spark):
    from test_matching import frame, inv, led

    from ledgerloom.operators import matching

    sources = (Source("inv", "e_invoice", role="PRIMARY"), Source("reg", "sales_register"))
    session = SCENARIOS["scenario_invoice_sales_register"].session("s", sources)
    more = {"vat_amount": 10, "total_amount": 110}
    rows = lambda made: frame(spark, made).withColumn("vat_amount", F.lit(10).cast("decimal(18,2)"))
    register = rows([{**led("r1", "1", None), **more, "pretax_amount": 100}, {**led("r2", "2", None), **more, "pretax_amount": 90, "total_amount": 111}])
    frames = matching.reconcile(session, {"inv": rows([{**inv("a", "1", 100), **more}, {**inv("b", "2", 100), **more}, {**inv("c", "3", 100), **more}]), "reg": register})
    back = json_records.read_result(json_records.result_documents(frames))
    assert sorted(back.collect(), key=str) == sorted(json_records.nested_result(frames).collect(), key=str)
    got = {r.id: r for r in back.collect()}
    a, b, c = (got[f"grp_match_{x}"] for x in "abc")
    assert [x.status for x in a.semanticComparisons] == ["MATCHED_EXACT"] * 3 and a.sourceBreakdowns["reg"].comparedAmount == 110 and a.targetSourceRecordIds == ["r1"]
    assert [x.control for x in b.semanticComparisons] == [0, 1, 2] and [x.actualAmount for x in b.semanticComparisons] == [90, 10, 111]
    assert (b.sourceBreakdowns["reg"].comparedAmount, b.sourceBreakdowns["reg"].status, b.sourceBreakdowns["reg"].recordIds) == (111, "MISMATCH_AMOUNT", ["r2"])
    assert b.semanticComparisons[0].discrepancies[0].fieldName == "amount" and b.semanticComparisons[1].discrepancies == []
    assert c.sourceBreakdowns["reg"].status == "UNMATCHED_MISSING_IN_TARGET" and c.sourceBreakdowns["reg"].recordIds == []
    assert got["grp_missing_source_r2"].sourceBreakdowns == {} and got["grp_missing_source_r2"].targetSourceRecordIds == ["r2"]
    with pytest.raises(Exception, match="NOT_A_GROUP"):
        json_records.read_result(spark.createDataFrame([("not json",)], "document string")).collect()


def test_pages_end_at_the_last_one(spark):
    df = spark.range(7)
    page = lambda n, size=3: [(r.id, r.row_index) for r in report.page_rows(df, [F.col("id")], n, size).collect()]
    assert report.pages(df, 3) == 3 and report.pages(df.limit(0), 3) == 1
    assert page(0) == page(1) == [(0, 1), (1, 2), (2, 3)] and page(3) == page(99) == [(6, 7)] and page(1, 50) == page(2, 50)
    assert report.page_rows(df.limit(0), [F.col("id")], 5).collect() == []


def test_the_plain_digest_holds_at_any_size(spark, monkeypatch):
    """Sorted digests with repeats over many blocks, as one SHA-256; a dataset is never given another kind of digest."""
    monkeypatch.setattr(intake, "BLOCK_ROWS", 3)
    monkeypatch.setattr(intake, "PLAIN_DIGEST_ROWS", 100, raising=False)
    fp = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [("a", fp(i % 300)) for i in range(1000)] + [("b", fp(i)) for i in range(7)] + [("c", fp(1))] * 20
    want = {s: (sum(x == s for x, _ in rows), hashlib.sha256("".join(f"{f};" for f in sorted(f for x, f in rows if x == s)).encode()).hexdigest()) for s in "abc"}
    made = intake.content_fingerprints(spark.createDataFrame(rows, "source_id string, fp string"))
    assert {r.source_id: (r.n_records, r.fingerprint) for r in made.collect()} == want
    assert intake.content_fingerprints(spark.createDataFrame([], "source_id string, fp string")).collect() == []
