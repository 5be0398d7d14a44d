from decimal import Decimal

from ledgerloom.operators import controls
from ledgerloom.sources import xlsx


def test_rows_given_twice(spark):
    rows = [("a", "s", "S", "1", "2026-01-01", Decimal(5)), ("b", "s", "S", "1", "2026-01-01", Decimal(5)), ("c", "s", None, "1", "2026-01-01", Decimal(5)), ("d", "s", None, "1", "2026-01-01", Decimal(5)), ("e", "s", "S", "1", "2026-01-02", Decimal(5)), ("f", "s", "S", None, "2026-01-01", Decimal(5)), ("g", "s", "S", None, "2026-01-01", Decimal(5))]
    df = spark.createDataFrame(rows, "id string, source_id string, series string, doc_no string, date string, total_amount decimal(18,2)")
    assert sorted((r.id, r.n) for r in controls.duplicate_suspects(df).collect()) == [("a", 2), ("b", 2), ("c", 2), ("d", 2)]


def test_totals_by_level(spark):
    df = spark.createDataFrame([("GROUP", 5, 1, 6, 3, 2), ("DETAIL", 3, 1, 4, 2, 1), ("DETAIL", 2, None, 2, 1, 1)], "row_level string, revenue int, vat int, receivable int, cost int, profit int")
    assert {r.row_level: tuple(r)[1:] for r in controls.level_totals(df).select("row_level", "revenue", "vat", "receivable", "cost", "profit").collect()} == {"GROUP": (5, 1, 6, 3, 2), "DETAIL": (5, 1, 6, 3, 2)}


def test_cells_that_are_no_formulas(spark):
    df = spark.createDataFrame([("=1+1", 1), ("+84", 2), ("-x", 3), ("@a", 4), ("a=1", 5), ("", 6), (None, 7)], "t string, n int")
    assert [tuple(r) for r in xlsx.safe_csv(df).orderBy("n").collect()] == [("'=1+1", 1), ("'+84", 2), ("'-x", 3), ("'@a", 4), ("a=1", 5), ("", 6), (None, 7)]


def test_the_reports_name():
    path = xlsx.default_report_path("phiên/1 ü")
    assert path.name == "Bao_Cao_Doi_Chieu_phi_n_1__.xlsx"
