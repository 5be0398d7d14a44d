"""Exact token counts: one histogram of encoded lengths answers totals, quantiles and truncated totals for any limit.

Null or empty text: length 0. Repeated rows each count. Empty table: empty histogram, zero or null answers. Other
columns are ignored. The histogram has a row for each distinct length, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, slices
from ledgerloom.llm.encoding import encoder, tokenizer_path

#: Lengths whose suffix sums are made together.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, encoded_length of every row."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            lengths = [len(encode(t or "")) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "encoded_length"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, encoded_length bigint")


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """encoded_length, n_docs; counts are summed in each task before the shuffle."""
    return encoded_lengths(docs, path).groupBy("encoded_length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds, for the context limit L = encoded_length of each row:

    docs_at_least, tokens_at_least (documents of L tokens or more), docs_within and share_within (documents of at most L),
    truncated_total (tokens that remain if every document is cut to L), total_docs, total_tokens, and permille: the
    thousandths p of which L is the quantile, the least length within which p/1000 of the documents lie.
    Sums run inside blocks of lengths and over the few block totals, so no task sees more than a block of lengths. The
    histogram should be written, as it is read twice.
    """
    h = histogram.withColumn("block", F.floor(F.col("encoded_length") / BLOCK).cast("bigint")).withColumn("tokens", F.col("encoded_length") * F.col("n_docs"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("encoded_length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h.join(blocks, "block").select(
        "encoded_length",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("later_tokens")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    within = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    first, last = (F.floor(x * 1000 / F.col("total_docs")).cast("int") for x in (within - F.col("n_docs"), within))
    return out.select(
        "*",
        within.alias("docs_within"),
        (within / F.col("total_docs")).alias("share_within"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("encoded_length") * F.col("docs_at_least")).alias("truncated_total"),
        F.when(last > first, F.sequence(first + 1, last)).otherwise(F.array().cast("array<int>")).alias("permille"),
    )


def every_limit(histogram: DataFrame) -> DataFrame:
    """suffix_sums() of every context limit from 0 to the longest document, lengths that no document has included."""
    h = materialise(histogram, "histogram")  # else every text would be encoded twice
    longest = h.agg(F.max("encoded_length")).first()[0]
    limits = h.sparkSession.range(0, 0 if longest is None else longest + 1).withColumnRenamed("id", "encoded_length")
    return suffix_sums(limits.join(h, "encoded_length", "left").select("encoded_length", F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs")))


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, truncated_total, docs_cut of each asked limit, from the suffix sums of every limit."""
    spark = histogram.sparkSession
    sums = materialise(every_limit(histogram), "limits")
    top = sums.agg(F.max("encoded_length").alias("top"), F.coalesce(F.max("total_tokens"), F.lit(0)).alias("all"))
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit bigint").join(F.broadcast(top))  # one row
    cut = (F.col("total_docs") - F.col("docs_within")).alias("docs_cut")
    found = asked.join(sums.select("encoded_length", "truncated_total", cut), F.col("context_limit") == F.col("encoded_length"), "left")
    return found.select("context_limit", F.coalesce("truncated_total", "all").alias("truncated_total"), F.coalesce("docs_cut", F.lit(0)).alias("docs_cut"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The least length within which at least each share of the documents lies."""
    sums, spark = suffix_sums(materialise(histogram, "histogram")), histogram.sparkSession
    asked = [F.min(F.when(F.col("share_within") >= q, F.col("encoded_length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    row = sums.agg(*asked).first()
    return spark.createDataFrame([(float(q), row[i]) for i, q in enumerate(shares)], "share double, encoded_length bigint")
