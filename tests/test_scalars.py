from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def value(spark, f, text):
    df = spark.createDataFrame([(text,)], "x string")
    return df.select(f(df["x"]).alias("v")).first()["v"]


@pytest.mark.parametrize(("f", "cases"), [
    (S.doc_number, {"0000123": "123", " 101.00 ": "101", "000": "0", "HD0042": "HD0042", "12.50": "12.50", "7.": "7", "": "", ".": "0"}),
    (S.tax_number, {"MST 0101-001 ": "0101-001", "abc": ""}),
    (S.plain_letters, {"Đối Chiếu": "doi chieu", "SỔ QUỸ": "so quy"}),
    (S.token, {" Số (HĐ)! ": "so hd", "% thuế": "thue"}),
    (S.date_text, {"05/01/2026": "2026-01-05", "2026-1-5": "2026-01-05", "5.1.2026 08:00": "2026-01-05", "46027": "2026-01-05", "31/02/2026": "31/02/2026", "2026": "1905-07-18", " abc ": "abc"}),
    (S.lifecycle, {"Hóa đơn điều chỉnh": "ADJUSTED", "Bị thay thế": "REPLACED", "Đã hủy": "CANCELLED", "Hóa đơn mới": "STANDARD", "": "UNKNOWN"}),
    (S.yes_no, {"X": True, "không": False, "?": None}),
    (S.bank_key, {"Ref-00 1/a": "ref001a"}),
])
def test_text(spark, f, cases):
    assert {k: value(spark, f, k) for k in cases} == cases


def test_amounts(spark):
    cases = {"1.234.567": "1234567", "1,234,567.89": "1234567.89", "1.234.567,89": "1234567.89", "(500)": "-500", "500-": "-500", "-1.000": "-1000", "0.125": "125", "12,5": "12.5", "1 000 VND": "1000", "7₫": "7", "N/A": None, "": None, "-": None, "abc": None, "5đ": None, "12.5000": "12.5"}
    got = {k: value(spark, S.amount, k) for k in cases}
    assert got == {k: v if v is None else Decimal(v).quantize(Decimal("0.000001")) for k, v in cases.items()}


def test_money_input(spark):
    ok = {"1.234,5": Decimal("1234.5"), "1234": Decimal(1234)}
    for text, want in ok.items():
        r = value(spark, S.parse_local_money, text)
        assert r.ok and r.value == want
    for text, error in {"": "EMPTY", "-5": "NEGATIVE", "1.23": "MALFORMED", "1,23456": "MALFORMED"}.items():
        r = value(spark, S.parse_local_money, text)
        assert not r.ok and r.error == error


def test_null_dates_three_ways(spark):
    df = spark.createDataFrame([("2026-01-01", None), ("2026-01-01", "x"), ("2026-01-01", "2026-01-03")], "a string, b string")
    rows = df.select(S.within_days(df.a, df.b, 1, True).alias("t"), S.within_days(df.a, df.b, 1, False).alias("f")).collect()
    assert [(r.t, r.f) for r in rows] == [(True, False), (True, False), (False, False)]


def test_garbage_rows(spark):
    rows = [["", "Tổng cộng", "5"], ["", " "], ["Công ty Tổng Cộng", "5"], ["1", "x"]]
    df = spark.createDataFrame([(r,) for r in rows], "cells array<string>")
    assert [r.g for r in df.select(S.is_garbage_row(df.cells).alias("g")).collect()] == [True, True, False, False]


def test_dates_of_ten_characters_are_those_of_the_pattern(spark):
    texts = ["2026-01-05", " 2026-01-05 ", "2026-1-5", "2026-02-30", "0000-01-01", "2026-01-5T", "2026-01-05\n", "+202-01-05", "12026-01-05", "2026-01-0x", "2026/01/05", "05-01-2026", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(S.as_date(F.col("x")).cast("string").alias("a"), F.try_to_date(F.trim("x"), "yyyy-M-d").cast("string").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a is not None and rows[2].a is not None and rows[3].a is None
