from decimal import Decimal
from zipfile import ZipFile

from pyspark.sql import functions as F

from ledgerloom.operators import controls, matching, report
from ledgerloom.plans.model import SCENARIOS, Source
from ledgerloom.sources import xlsx
from test_matching import SOURCES, frame, inv, led

BALANCES = "account string, pos bigint, id string, balance decimal(18,2), debit_amount decimal(18,2), credit_amount decimal(18,2)"


def test_balances_go_on_over_ranges(spark):
    balance, rows = {"a": 0, "b": 0, None: 0}, []
    for i in range(3_000):
        account = "a" if i % 3 else ("b" if i % 2 else None)
        balance[account] += 5 if i % 4 else -2
        stated = None if i % 50 == 7 else balance[account] + (1 if i in (600, 1_999) else 0)
        rows.append((account, i, f"r{i}", None if stated is None else Decimal(stated), Decimal(5) if i % 4 else None, None if i % 4 else Decimal(2)))
    expected, last = [], {}
    for account, _, name, stated, debit, credit in rows:
        if stated is None:
            continue
        if account in last and (off := stated - last[account] - (debit or 0) + (credit or 0)):
            expected.append((account, name, off))
        last[account] = stated
    df = spark.createDataFrame(rows, BALANCES).repartition(5)
    got = [tuple(r) for r in controls.running_balance_breaks(df).collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(expected, key=key) and len(expected) > 50
    assert controls.running_balance_breaks(df.limit(0)).count() == 0


def test_identities_of_some_kinds(spark):
    masters = spark.createDataFrame([("01", "K")], "partner_tax_id string, partner_code string")
    records = spark.createDataFrame([("1", "i", "01", None), ("2", "b", "99", None)], "id string, source_id string, partner_tax_id string, partner_code string")
    sources = (Source("i", "e_invoice"), Source("b", "bank_statement"))
    assert tuple(controls.identity_control(records, masters, sources).first()) == (1, 0, "MATCHED_EXACT")
    assert tuple(controls.identity_control(records, masters).first()) == (2, 1, "NEEDS_REVIEW")


def test_missing_documents_are_named_and_found(spark, tmp_path):
    session = SCENARIOS["scenario_revenue_standard"].session("s", SOURCES)
    frames = matching.reconcile(session, {"inv": frame(spark, [inv("a", "1", 5), inv("b", "0042", 50)]), "led": frame(spark, [led("zz9", "1", 5)])})
    lost = frames.discrepancies.where("field_name = 'NOT_FOUND'").collect()
    assert len(lost) == 1 and lost[0].group_id == "grp_match_b"
    assert lost[0].message.startswith("Chứng từ #42 không tìm thấy trong nguồn ") and lost[0].source_value.startswith("42 (Ký hiệu ")
    find = lambda text, *more: sorted(r.group_id for r in report.search(frames.groups, None, text, *more).collect())
    assert find("KHÔNG TÌM THẤY") == [] and find("KHÔNG TÌM THẤY", frames.discrepancies) == ["grp_match_b"]
    assert find("zz9") == [] and find("zz9", frames.discrepancies, frames.links) == ["grp_match_a"]
    xlsx.export_report(frames, tmp_path / "t.xlsx", "Hóa đơn")
    rows = list(xlsx.sheet_rows((tmp_path / "t.xlsx").read_bytes(), "Chi tiet tat ca"))
    assert rows[0] == list(report.REPORT_TITLES.values()) and [r[0] for r in rows[1:]] == ["1", "2"]


def test_three_sources_say_high(spark):
    from ledgerloom.operators import messages

    said = spark.range(1).select(messages.not_found(F.lit("7"), F.lit("Sổ"), True).alias("m"), messages.not_found(F.lit(None).cast("string"), F.lit("Sổ"), True).alias("n")).first()
    assert said.m == "HIGH: chứng từ #7 không tìm thấy trong nguồn Sổ của kiểm soát ba nguồn" and said.n is None


def test_ranges_of_sheets(spark, tmp_path):
    xlsx.write_workbook(tmp_path / "a.xlsx", {"A": [[], [None, "x", 2.5], [], [None, None, None, "y"]], "B": []})
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    content = (tmp_path / "a.xlsx").read_bytes()
    assert xlsx.extent(content, "A") == (2, 3, 3) and xlsx.extent(content, "B") == (1, 0, 0)
    a = xlsx.inspect_workbook(content)["sheets"][0]
    assert (a["total_rows"], a["total_cols"], a["range_start_row"]) == (3, 3, 2)
    seen = {r.source_id.rsplit("/", 1)[-1]: r.inspection for r in xlsx.inspect_files(spark, str(tmp_path / "*.xlsx")).collect()}
    assert seen["b.xlsx"] is None and '"total_rows": 3' in seen["a.xlsx"]
    with ZipFile(tmp_path / "a.xlsx") as z:
        assert 's="1"><v>2.5</v>' in z.read("xl/worksheets/sheet1.xml").decode() and "xl/styles.xml" in z.namelist()
