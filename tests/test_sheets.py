import random

import pytest

from ledgerloom.operators import controls, infer, intake, normalize, report
from ledgerloom.plans.model import ReconciliationError, Source
from ledgerloom.sources import xlsx

EINVOICE = ["Ký hiệu mẫu số", "Ký hiệu hóa đơn", "Số hóa đơn", "Ngày lập", "MST người bán", "MST người mua", "Tổng tiền chưa thuế", "Tổng tiền thuế", "Tổng tiền thanh toán"]


def test_invoice_sheet():
    got = infer.inspect([["BẢNG KÊ HÓA ĐƠN"], [], EINVOICE, ["1", "1C26TAA", "7", "05/01/2026", "01", "02", "100", "10", "110"]], "Sheet1")
    assert got["header_row"] == 3 and got["kind"] == "e_invoice" and got["confidence"] == 0.99
    m = got["mapping"]
    assert (m["template_code"], m["series"], m["doc_no"], m["seller_tax_id"], m["buyer_tax_id"], m["partner_tax_id"], m["pretax_amount"], m["vat_amount"], m["total_amount"]) == (EINVOICE[0], EINVOICE[1], EINVOICE[2], EINVOICE[4], EINVOICE[5], EINVOICE[5], EINVOICE[6], EINVOICE[7], EINVOICE[8])


def test_other_kinds():
    register = infer.inspect([["Ngày ct", "Mã ct", "Số ct", "Mã khách", "Tên khách hàng", "Tiền", "Thuế", "Phải thu"]])
    assert register["kind"] == "sales_register" and register["mapping"]["doc_code"] == "Mã ct" and register["mapping"]["revenue"] == "Tiền" and register["mapping"]["total_amount"] == "Phải thu"
    master = infer.inspect([["Mã khách/ncc", "Tên khách hàng/ncc", "Mã số thuế", "Địa chỉ", "Khách hàng", "Nhà cung cấp", "Trạng thái"]])
    assert master["kind"] == "partner_master" and master["mapping"]["is_customer"] == "Khách hàng"
    assert infer.inspect([["Phát sinh nợ", "Phát sinh có", "Ngày ct", "Số ct"]], "So chi tiet 112")["kind"] == "ledger112"
    assert infer.source_kind({"a": 60, "b": 55}) == ("custom", 0.45) and infer.source_kind({"a": 30, "b": 0}) == ("custom", 0.35)
    assert infer.inspect([]) == {"header_row": 1, "data_start_row": 2, "columns": [], "mapping": {}, "kind": "custom", "confidence": 0.0}
    assert infer.map_columns(["Số phiếu"]) == {"fee_amount": "Số phiếu"} and infer.map_columns(["No."]) == {"debit_amount": "No."}


def test_workbook_to_records(spark, tmp_path):
    rows = [["BẢNG KÊ"], [], [*EINVOICE, "Trạng thái hóa đơn"], [1, "1c26taa", "0000007", 46027, "01", "02", "1.000", "100", None, "Hóa đơn mới"], ["", "", "Tổng cộng", None, None, None, "1.000"], [1, "1C26TAA", "8", "06/01/2026", "01", "03", 2500.5, "100", "=1+1", "Đã hủy"]]
    xlsx.write_workbook(tmp_path / "a.xlsx", {"Hóa đơn & kê": rows, "Trống": []})
    content = (tmp_path / "a.xlsx").read_bytes()
    seen = xlsx.inspect_workbook(content)["sheets"][0]
    assert seen["kind"] == "e_invoice" and seen["header_row"] == 3 and len(seen["preview"]) == 6
    assert xlsx.resolve_sheet(["A", "B"], " b ") == "B" and xlsx.resolve_sheet(["A"], "") == "A"
    with pytest.raises(ReconciliationError):
        xlsx.resolve_sheet(["A"], "C")
    sheet = xlsx.read_sheets(spark, str(tmp_path / "*.xlsx"), "hóa đơn & kê")
    source = Source("inv", "e_invoice", mapping=seen["mapping"], data_start_row=seen["data_start_row"])
    got = {r.doc_no: r for r in normalize.canonical(sheet, source, seen["columns"]).collect()}
    assert sorted(got) == ["0000007", "8"]
    a = got["0000007"]
    assert (a.date, a.series, a.pretax_amount, a.total_amount, a.total_amount_origin, a.lifecycle, a.source_row) == ("2026-01-05", "1C26TAA", 1000, 1100, "DERIVED", "STANDARD", 4)
    assert got["8"].lifecycle == "CANCELLED" and got["8"].raw_fields["MST người mua"] == "03"
    assert xlsx.files(spark, str(tmp_path / "a.xlsx")).first().sha256


def test_partners_and_analysis(spark):
    columns = ["Mã khách/ncc", "Tên khách hàng/ncc", "Mã số thuế", "Khách hàng"]
    df = spark.createDataFrame([("m", 0, columns), ("m", 1, ["K1", "A", "01-0", "x"]), ("m", 2, ["K2", "B", "01-0", "0"]), ("m", 3, ["", "", "", "x"])], "source_id string, row_idx bigint, cells array<string>")
    p = normalize.partners(df, Source("m", "partner_master", mapping=infer.map_columns(columns)), columns)
    assert [(r.partner_code, r.is_customer) for r in p.orderBy("id").collect()] == [("K1", True), ("K2", False)]
    assert controls.partner_master_control(p).first().status == "NEEDS_REVIEW"
    a = spark.createDataFrame([("GROUP", 5, 1, 6, 3, 2), ("DETAIL", 3, 1, 4, 2, 1), ("DETAIL", 2, 0, 2, 1, 1)], "row_level string, revenue int, vat int, receivable int, cost int, profit int")
    assert controls.sales_layer_control(a).first().code == "OK"
    assert controls.sales_layer_control(a.where("revenue <> 2")).first().code == "SALES_ANALYSIS_GROUP_DETAIL_MISMATCH"
    assert controls.sales_layer_control(a.where("row_level = 'GROUP'")).first().code == "SALES_ANALYSIS_LAYER_MISSING"


def test_gate(spark):
    rows = [("a", x) for x in "pqr"] + [("b", x) for x in "rqp"] + [("c", x) for x in "pq"] + [("d", x) for x in "rs"] + [("e", x) for x in "xyz"]
    prints = spark.createDataFrame(rows, "source_id string, fp string")
    related = intake.relations(prints)
    kinds = {(r.a, r.b): r.relation for r in related.collect()}
    assert kinds[("a", "b")] == "CONTENT_DUPLICATE" and kinds[("a", "c")] == "SUBSET_DUPLICATE" and kinds[("a", "d")] == "PARTIAL_OVERLAP" and ("a", "e") not in kinds
    fp = {r.source_id: r.fingerprint for r in intake.dataset_fingerprints(prints).collect()}
    source = lambda i, path="": {"id": i, "kind": "ledger511", "key": "k", "path": path or i, "sheet": "S", "raw_hash": "", "fingerprint": fp[i]}
    assert [x["relation"] for x in intake.gate([source("a"), source("b"), source("e")], related)] == ["UNIQUE", "CONTENT_DUPLICATE", "UNIQUE"]
    assert intake.gate([source("a", "f"), source("b", "F ")], related)[1]["relation"] == "EXACT_DUPLICATE"
    for other in ("c", "d"):
        for order in ((source("a"), source(other)), (source(other), source("a"))):
            with pytest.raises(ReconciliationError, match="DATASET_CONFLICT"):
                intake.gate(list(order), related)


def test_report_workbook(spark, tmp_path):
    from test_matching import SOURCES, frame, inv, led

    from ledgerloom.operators import matching
    from ledgerloom.plans.model import SCENARIOS

    session = SCENARIOS["scenario_revenue_standard"].session("s", SOURCES)
    frames = matching.reconcile(session, {"inv": frame(spark, [inv("a", "1", 5), inv("b", "2", 50)]), "led": frame(spark, [led("c", "1", 5)])})
    xlsx.export_report(frames, tmp_path / "r.xlsx")
    content = (tmp_path / "r.xlsx").read_bytes()
    assert len(list(xlsx.sheet_rows(content, "Tong quan"))) == 15
    assert [r[:2] for r in xlsx.sheet_rows(content, "Sai lech & Can chu y")] == [["STT", "Số chứng từ"], ["1", "2"]]
    assert len(list(xlsx.sheet_rows(content, "Chi tiet tat ca"))) == 3
    assert report.search(frames.groups, text="GRP_MATCH_A").count() == 1


def test_any_number_of_sheets_as_one_by_one(spark):
    rng = random.Random(1)
    words = [w for known in infer.KEYWORDS.values() for w in known]
    odd = ["STT", "tien", "thue", "phai thu", "ma ct", "no", "co", "x no", "co x", "", "ghi chú", "tổng tiền thuế", "mẫu số", "%"]

    def title():
        t = rng.choice(words) if rng.random() < 0.85 else rng.choice(odd)
        t = "".join({"a": "ấ", "o": "ọ", "e": "é", "d": "đ", "u": "ứ"}.get(c, c) if rng.random() < 0.3 else c for c in t)
        return rng.choice([t, t.upper(), f" {t} ", t.title(), t + " (VND)"])

    sheets = {}
    for i in range(120):
        rows = [rng.choice([[], ["Sổ chi tiết " + rng.choice(["511", "3331", "112", "131 phải thu", "quỹ tiền mặt", "chi nhánh", "ngân hàng"])], ["Danh mục", "khách hàng"], ["", "x"]]) for _ in range(rng.randint(0, 4))]
        rows += [[title() for _ in range(rng.randint(1, 12))]] + [[str(rng.randint(1, 99)) for _ in range(5)]] * 3
        sheets[f"s{i}"] = rows, rng.choice(["", "Sheet1", "Sổ 511", "Hóa đơn", "Sao kê"])
    df = spark.createDataFrame([(k, i, r, name) for k, (rows, name) in sheets.items() for i, r in enumerate(rows)], "source_id string, row_idx bigint, cells array<string>, name string")
    got = {r.source_id: r for r in infer.infer_sources(df, "name").collect()}
    assert len(got) == len(sheets) and len({r.kind for r in got.values()}) > 5
    for k, (rows, name) in sheets.items():
        want = infer.inspect(rows, name)
        assert {c: round(got[k][c], 6) if c == "confidence" else got[k][c] for c in want} == {c: round(v, 6) if c == "confidence" else v for c, v in want.items()}
    assert infer.infer_sources(df.limit(0)).collect() == []
