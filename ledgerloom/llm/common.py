"""Helpers that the corpus operators share: shared-folder tables, size-checked joins, column hygiene."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialise, settle

__all__ = ["free_name", "join_hot", "join_small", "keep_first", "materialise", "parquet", "renamed", "row_key", "settle", "slices", "small", "unit_hash"]

#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 100_000
#: Copies of each small-side row when a join is salted instead.
SALTS = 16


def join_small(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that has one row per key. It is counted: up to limit rows are broadcast.

    Beyond that both sides are salted, so that a key with a third of the rows is dealt to SALTS tasks; the right side's copies
    go by a sort-merge join, by hint, as Spark would judge them by the written table, a small part of their size, and broadcast them.
    right should be cheap to compute twice (or materialised); spread is a per-row value of left.
    """
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*keys, "__salt"], how).drop("__salt")


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left", share: int = 1000) -> DataFrame:
    """Join many rows per key with one row per key that knows how many there are (weight).

    Keys with more than 1/share of all rows number share at most, so they are broadcast; only the others are shuffled.
    Both sides should be materialised; the right side's other columns come along.
    """
    payload = [c for c in right.columns if c not in (key, weight)]
    many = right.where(F.col(weight) * share > total).select(key, F.struct(*payload).alias("__hot"))
    if not many.limit(1).count():
        return left.join(right.select(key, *payload), key, how).select(*left.columns, *payload)
    marked = left.join(F.broadcast(many), key, "left")
    hot = marked.where("__hot IS NOT NULL").select(*left.columns, *[F.col(f"__hot.{c}").alias(c) for c in payload])
    return hot.unionByName(marked.where("__hot IS NULL").drop("__hot").join(right.select(key, *payload), key, how).select(*left.columns, *payload))


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores added until no column has it (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def renamed(columns: list[str]) -> tuple[list[Column], list[Column]]:
    """Projections that set a table's columns apart as in0, in1, ... (own names then can't clash), and back."""
    return [F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(columns)], [F.col(f"in{i}").alias(c) for i, c in enumerate(columns)]


def row_key(id_col: Column, text_col: Column) -> Column:
    """The same for rows of the same id and text alone."""
    known = lambda c: F.when(c.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), c))
    return F.unhex(F.md5(F.concat(known(id_col.cast("string")), F.lit(":"), known(text_col.cast("string"))).cast("binary")))


def small(df: DataFrame) -> DataFrame:
    """df (narrow rows), to be broadcast if it was counted and has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group: that of least doc_id, then of least key; rows without an id come last.

    rows (materialised) has doc_id, key (see row_key) and root, a group's name, for every row of docs. Rows are told apart
    by id and text, so that different texts under one id are different rows; of repeated rows one stays.
    """
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialise(first.select("root", F.col("f.key").alias("stays")), "groups")
    of = materialise(rows.join(small(first), "root").groupBy("key", "stays").count(), "members")
    gone, again = of.where("key <> stays").select("key"), of.where("key = stays AND count > 1").select("key")
    apart, back = renamed(docs.columns)
    rest = docs.select(*apart, row_key(F.col(id_col), F.col(text_col)).alias("key")).join(small(gone), "key", "left_anti")
    if again.limit(1).count():
        marked = rest.join(small(again.withColumn("again", F.lit(True))), "key", "left")
        rest = marked.where("again IS NULL").unionByName(marked.where("again").dropDuplicates(["key"]))
    return rest.select(*back)


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) with 52 bits, the same in any engine with MD5: the first 13 hex digits over 16^13."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts, so that only a few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
