"""An extension: a live bank feed against a stream of ledger entries, by an interval join or with each row consumed once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def match_feed(ledger: DataFrame, feed: DataFrame, days: int = 3, lateness: str = "1 day") -> DataFrame:
    """Pairs of equal amount and direction whose times lie within the window. Both streams: id, ts, amount, direction.

    State is bounded by the window and the watermark; a pair is given as soon as its second row arrives.
    """
    a = ledger.select(F.col("id").alias("ledger_id"), F.col("ts").alias("ledger_ts"), "amount", "direction").withWatermark("ledger_ts", lateness)
    b = feed.select(F.col("id").alias("bank_id"), F.col("ts").alias("bank_ts"), F.col("amount").alias("b_amount"), F.col("direction").alias("b_direction")).withWatermark("bank_ts", lateness)
    near = F.expr(f"bank_ts BETWEEN ledger_ts - INTERVAL {int(days)} DAYS AND ledger_ts + INTERVAL {int(days)} DAYS")
    return a.join(b, (F.col("amount") == F.col("b_amount")) & (F.col("direction") == F.col("b_direction")) & near).select("ledger_id", "bank_id", "amount", "direction", "ledger_ts", "bank_ts")


def daily_totals(feed: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Totals by day and direction; a day is given once the watermark has passed it."""
    return feed.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select(F.col("window.start").alias("day"), "direction", "n", "amount")


_SETTLED = "ledger_id string, bank_id string, amount decimal(28,6), direction string, status string"
_WAITING = "sides array<string>, ids array<string>, times array<bigint>"


def settle_feed(ledger: DataFrame, feed: DataFrame, days: int = 3, lateness: str = "1 day") -> DataFrame:
    """Each row of both streams once: MATCHED with the earliest waiting row of the other side, or, once the watermark has
    passed its window, UNMATCHED_MISSING_IN_TARGET (ledger) or UNMATCHED_MISSING_IN_SOURCE (bank).

    Both streams: id, ts, amount, direction. State is kept by amount and direction: the rows that still wait, of which the
    watermark leaves those of one window. Rows of a trigger are taken in the order of ts, then id.
    """
    window = days * 86_400_000
    lone = {"L": "UNMATCHED_MISSING_IN_TARGET", "B": "UNMATCHED_MISSING_IN_SOURCE"}
    side = lambda df, name: df.select("id", "ts", F.col("amount").cast("decimal(28,6)").alias("amount"), "direction", F.lit(name).alias("side"))
    both = side(ledger, "L").unionByName(side(feed, "B")).withWatermark("ts", lateness)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        out = []
        came = pd.concat(list(frames)) if not state.hasTimedOut else pd.DataFrame({"side": [], "id": [], "ts": []})
        for s, i, t in sorted(zip(came["side"], came["id"], (int(x.value // 1_000_000) for x in came["ts"]), strict=True), key=lambda r: (r[2], r[1])):
            other = min((w for w in waiting if w[0] != s and abs(w[2] - t) <= window), key=lambda w: (w[2], w[1]), default=None)
            if other is None:
                waiting.append((s, i, t))
            else:
                waiting.remove(other)
                out.append((i, other[1], "MATCHED") if s == "L" else (other[1], i, "MATCHED"))
        now = state.getCurrentWatermarkMs()
        for w in [w for w in waiting if w[2] + window < now]:
            waiting.remove(w)
            out.append((w[1], None, lone["L"]) if w[0] == "L" else (None, w[1], lone["B"]))
        if waiting:
            state.update(tuple(map(list, zip(*waiting, strict=True))))
            state.setTimeoutTimestamp(max(min(w[2] for w in waiting) + window + 1, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"ledger_id": [o[0] for o in out], "bank_id": [o[1] for o in out], "amount": [key[0]] * len(out), "direction": [key[1]] * len(out), "status": [o[2] for o in out]})

    return both.groupBy("amount", "direction").applyInPandasWithState(run, _SETTLED, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
