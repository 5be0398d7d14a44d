"""The bank feed, over streams of files that arrive one after the other."""

import pytest

from ledgerloom.streaming import bank_feed

SCHEMA = "id string, ts timestamp, amount decimal(18,2), direction string"


@pytest.fixture
def stream(spark, tmp_path):
    """Writes batches of rows as files, and reads them as a stream of one file a trigger."""

    def add(name, rows):
        df = spark.createDataFrame([tuple(r) for r in rows], "id string, ts string, amount string, direction string")
        df.selectExpr("id", "CAST(ts AS TIMESTAMP) AS ts", "CAST(amount AS DECIMAL(18,2)) AS amount", "direction").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def read(name):
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    def run(df, mode="append"):
        name = f"out_{abs(hash(str(tmp_path))) % 10**8}"
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    return add, read, run


def test_pairs_within_the_window(stream):
    add, read, run = stream
    add("ledger", [("l1", "2026-01-05 10:00:00", "100", "IN"), ("l2", "2026-01-05 11:00:00", "200", "OUT"), ("l3", "2026-01-01 00:00:00", "300", "IN")])
    add("ledger", [("l4", "2026-01-06 10:00:00", "100", "IN")])
    add("bank", [("b1", "2026-01-06 09:00:00", "100", "IN"), ("b2", "2026-01-06 09:00:00", "200", "IN"), ("b3", "2026-01-06 00:00:00", "300", "IN")])
    add("bank", [("b4", "2026-01-08 10:00:00", "100", "IN"), ("b5", "2026-01-07 10:00:00", "200", "OUT")])
    got = {(r.ledger_id, r.bank_id) for r in run(bank_feed.match_feed(read("ledger"), read("bank")))}
    assert got == {("l1", "b1"), ("l4", "b1"), ("l1", "b4"), ("l4", "b4"), ("l2", "b5")}


def test_days_come_once_the_watermark_has_passed(stream):
    add, read, run = stream
    add("feed", [("a", "2026-01-05 10:00:00", "100", "IN"), ("b", "2026-01-05 12:00:00", "50.5", "IN"), ("c", "2026-01-05 23:00:00", "7", "OUT")])
    add("feed", [("d", "2026-01-08 00:00:00", "1", "IN")])
    add("feed", [("d2", "2026-01-08 00:30:00", "1", "IN")])  # rows count as late by the watermark of the batch before
    add("feed", [("late", "2026-01-05 13:00:00", "1000", "IN"), ("e", "2026-01-08 01:00:00", "1", "IN")])
    got = {(str(r.day)[:10], r.direction): (r.n, float(r.amount)) for r in run(bank_feed.daily_totals(read("feed")))}
    assert got == {("2026-01-05", "IN"): (2, 150.5), ("2026-01-05", "OUT"): (1, 7.0)}


def test_each_row_is_settled_once(stream):
    add, read, run = stream
    add("ledger", [("l1", "2026-01-05 10:00:00", "100", "IN"), ("l2", "2026-01-05 12:00:00", "100", "IN"), ("l3", "2026-01-05 00:00:00", "7", "OUT")])
    add("bank", [("b1", "2026-01-06 10:00:00", "100", "IN"), ("b2", "2026-01-06 09:00:00", "100", "OUT"), ("b3", "2026-01-05 00:00:00", "8", "IN")])
    add("bank", [("b4", "2026-01-07 10:00:00", "100.00", "IN"), ("b5", "2026-01-07 11:00:00", "100", "IN")])
    for day in (20, 21, 22):  # the watermark moves on, and what waits is given up
        add("ledger", [(f"x{day}", f"2026-01-{day} 00:00:00", str(day), "IN")])
        add("bank", [(f"y{day}", f"2026-01-{day} 00:00:00", str(day), "IN")])
    got = sorted((r.ledger_id or "", r.bank_id or "", r.status) for r in run(bank_feed.settle_feed(read("ledger"), read("bank"))))
    assert [g for g in got if g[2] == "MATCHED" and g[0][0] == "l"] == [("l1", "b1", "MATCHED"), ("l2", "b4", "MATCHED")]
    assert {g for g in got if g[2] != "MATCHED"} == {("l3", "", "UNMATCHED_MISSING_IN_TARGET"), ("", "b2", "UNMATCHED_MISSING_IN_SOURCE"), ("", "b3", "UNMATCHED_MISSING_IN_SOURCE"), ("", "b5", "UNMATCHED_MISSING_IN_SOURCE")}
    assert {g[:2] for g in got if g[0].startswith("x")} == {(f"x{d}", f"y{d}") for d in (20, 21, 22)}
