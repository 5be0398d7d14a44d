"""From workbooks of all formats to a report, in one call."""

import pytest
from test_workbooks import ole, xls_stream, xlsb_bytes

from ledgerloom.operators import uploads
from ledgerloom.plans.model import ReconciliationError
from ledgerloom.sources import xlsx

INVOICE = ["Ký hiệu mẫu số", "Ký hiệu hóa đơn", "Số hóa đơn", "Ngày lập", "MST người mua", "Tên khách hàng", "Tổng tiền chưa thuế", "Tổng tiền thuế", "Tổng tiền thanh toán"]
LEDGER = ["Ngày ct", "Số ct", "Ký hiệu", "Mã số thuế", "Diễn giải", "Phát sinh có"]


def invoice(no, amount, day=5):
    return ["1", "1C26TAA", no, f"{day:02}/03/2026", "0100000001", "Công ty A", amount, amount // 10, amount + amount // 10]


def entry(no, amount, day=6):
    return [f"{day:02}/03/2026", no, "1C26TAA", "0100000001", f"Doanh thu {no}", amount]


def cells(title, header, rows):
    return {(r, c): v for r, row in enumerate([[title], header, *rows]) for c, v in enumerate(row)}


@pytest.fixture
def folder(tmp_path):
    books = tmp_path / "in"
    books.mkdir()
    first, second = [invoice("201", 1000), invoice("202", 2000)], [invoice("203", 3000), invoice("204", 900)]
    xlsx.write_workbook(books / "a.xlsx", {"Tháng 3": [["BẢNG KÊ HÓA ĐƠN"], [], INVOICE, *first], "Ghi chú": [["không có gì"]]})
    xlsx.write_workbook(books / "b.xlsx", {"Tháng 3 (2)": [["BẢNG KÊ HÓA ĐƠN"], INVOICE, *second]})
    (books / "c.xls").write_bytes(ole(xls_stream(cells("Sổ chi tiết 511 doanh thu", LEDGER, [entry("201", 1000), entry("202", 2000), entry("204", 400)]))))
    (books / "d.xlsb").write_bytes(xlsb_bytes(cells("Sổ chi tiết 511 doanh thu", LEDGER, [entry("204", 500), entry("999", 12)])))
    return books


def test_from_files_to_the_report(spark, folder, tmp_path):
    (folder / "e.xls").write_bytes((folder / "c.xls").read_bytes())  # a copy
    out = uploads.reconcile_files(spark, str(folder))
    assert out.counters["physical"] == 5 and out.counters["logical"] == 2 and out.counters["content_duplicates"] + out.counters["exact_duplicates"] == 1
    assert [s.kind for s in out.session.sources].count("ledger511") == 1 and out.session.primary().kind == "e_invoice"
    assert "Ghi chú" in {s.sheet for s in out.left_out}
    got = {r.doc_no: r.status for r in out.frames.groups.collect()}
    assert got == {"201": "MATCHED_EXACT", "202": "MATCHED_EXACT", "203": "UNMATCHED_MISSING_IN_TARGET", "204": "MATCHED_AGGREGATE", "999": "UNMATCHED_MISSING_IN_SOURCE"}
    path = tmp_path / "report.xlsx"
    xlsx.export_report(out.frames, path, out.session.primary().title)
    rows = list(xlsx.sheet_rows(path.read_bytes(), "Chi tiet tat ca"))
    assert sorted(r[1] for r in rows[1:]) == ["201", "202", "203", "204", "999"]
    assert any("không có trong nguồn chính" in c for r in rows for c in r)


def test_conflicts_and_gaps_stop_the_run(spark, folder):
    with pytest.raises(ReconciliationError, match="TOO_FEW_SOURCES"):
        uploads.reconcile_files(spark, str(folder / "*.xlsx"), "scenario_ledger112_bank_statement")
    with pytest.raises(ReconciliationError, match="REQUIRED_SOURCE_MISSING|TOO_FEW_SOURCES"):
        uploads.reconcile_files(spark, str(folder / "*.xlsx"))
    (folder / "part.xls").write_bytes(ole(xls_stream(cells("Sổ chi tiết 511 doanh thu", LEDGER, [entry("201", 1000), entry("777", 7)]))))
    with pytest.raises(ReconciliationError, match="DATASET_CONFLICT"):
        uploads.reconcile_files(spark, str(folder))


def test_kinds_given_by_hand(spark, folder):
    (folder / "c.xls").write_bytes(ole(xls_stream(cells("Sổ khác", LEDGER[:-1] + ["Phát sinh có"], [entry("201", 1000), entry("202", 2000), entry("204", 400)]))))
    out = uploads.reconcile_files(spark, str(folder), kinds={"Sổ": "ledger511"})
    assert {r.doc_no: r.status for r in out.frames.groups.collect()}["204"] == "MATCHED_AGGREGATE"
