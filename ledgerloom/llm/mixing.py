"""Mixing sources to target weights by Poisson replication.

A source whose target share of the mixture is w and which holds s characters is to be read w * budget / s times. Each
document draws its number of copies from a Poisson distribution with that mean: a uniform number is made from a hash of
seed and document, and the distribution function is inverted by comparing it with a table of cumulative probabilities.
A rate above MEAN is taken apart: the sum of independent draws of equal means, none above MEAN, has the same distribution.
Copies are exploded and dealt to partitions by a second hash, sorted by it inside each: a global shuffle.

The draw of a document depends on nothing but seed, doc_id, text digest and the source's rate, so a lost task repeats it.

Null source: a source of its own. Null or empty text: length 0; a source without any characters has rate 1. Null doc_id:
drawn and placed by the text alone. Repeated rows: each is drawn alike. Empty table: no rows. Extra columns are carried
along, whatever their names: what is added stands in one struct, whose name gets underscores until it is free.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free_name, join_small, materialise, renamed, unit_hash

SEED = 20
#: The highest mean of one draw, and the end of its table: a draw of that mean goes beyond with a probability below 2^-52.
MEAN = 16.0
TAIL = 64
#: Copies that are numbered in one array.
COPIES = 1 << 16


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None, max_rate: float | None = None, temperature: float = 0.0) -> DataFrame:
    """source, n_docs, n_chars, weight, rate. Weights are relative; sources that they don't name get none.

    Without weights a source's weight is its number of characters to the power of temperature: 0 gives every source the
    same, 1 leaves their shares as they are. budget is in characters and is the whole corpus unless given. There is no
    limit of a rate unless max_rate asks for one; a source above it then misses its weight, and the mixture its budget.
    """
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("n_chars"))
    sizes = materialise(sizes, "sources")
    if weights is not None:
        table = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "name string, given double")
        sizes = sizes.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")), "left").withColumn("weight", F.coalesce("given", F.lit(0.0))).drop("name", "given")
    else:
        sizes = sizes.withColumn("weight", F.lit(1.0) if temperature == 0 else F.pow(F.col("n_chars").cast("double"), F.lit(float(temperature))))
    total = sizes.agg(F.sum("weight").alias("w"), F.sum("n_chars").alias("c")).first()
    whole = float(budget if budget is not None else total["c"] or 0)
    share = F.col("weight") / F.lit(float(total["w"] or 1.0))
    due = share * F.lit(whole) / F.col("n_chars")
    rate = F.when(F.col("n_chars") > 0, due if max_rate is None else F.least(due, F.lit(float(max_rate)))).otherwise(F.lit(1.0))
    return sizes.withColumn("rate", rate)


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TAIL - 1, X Poisson with this mean."""
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["p"] * rate / k)).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TAIL - 1)), start, step, lambda s: s["sums"])


def _drawn(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """The columns of docs, set apart, with doc_id, md5 (of the text), rate and copies: the number of cumulative probabilities that the
    document's uniform numbers reach. The first draw's number is made from seed and document, others' from theirs too."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN)).cast("bigint")
    table = rates.select(F.coalesce("source", F.lit("\0")).alias("source"), "rate", draws.alias("draws"), cumulative(F.col("rate") / draws).alias("sums"))
    document = F.col("doc_id"), F.col("md5")
    keyed = docs.select(*renamed(docs.columns)[0], F.col("doc_id"), F.coalesce("source", F.lit("\0")).alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    joined = join_small(keyed.withColumn("u", unit_hash(*document, seed=seed)), table, ["source"], F.col("u"), "inner")
    reached = lambda u: F.aggregate("sums", F.lit(0).cast("bigint"), lambda n, p: n + (u >= p).cast("bigint"))
    further = F.aggregate(F.sequence(F.lit(2).cast("bigint"), F.col("draws")), F.lit(0).cast("bigint"), lambda n, i: n + reached(unit_hash(*document, i, seed=seed)))
    copies = reached(F.col("u")) + F.when(F.col("draws") > 1, further).otherwise(F.lit(0))
    return joined.withColumn("copies", copies).drop("source", "u", "draws", "sums")


def poisson_copies(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with a struct "drawn": rate and copies."""
    return _drawn(docs, rates, seed).select(*renamed(docs.columns)[1], F.struct("rate", "copies").alias(free_name(docs.columns, "drawn")))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None, seed: int = SEED, partitions: int | None = None, max_rate: float | None = None, temperature: float = 0.0) -> DataFrame:
    """The mixture: a row per copy, in global random order, with a struct "mixed": rate, copies, copy (from 1), order_key."""
    drawn = _drawn(docs, source_rates(docs, weights, budget, max_rate, temperature), seed).where("copies > 0")
    blocks = drawn.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES).cast("bigint"))))
    copied = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES + 1, F.least("copies", (F.col("block") + 1) * COPIES))))
    keyed = copied.withColumn("order_key", unit_hash(F.col("doc_id"), F.col("md5"), F.col("copy"), seed=seed + 1))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.drop("doc_id", "md5", "block").repartition(n, F.xxhash64("order_key")).sortWithinPartitions("order_key")
    return dealt.select(*renamed(docs.columns)[1], F.struct("rate", "copies", "copy", "order_key").alias(free_name(docs.columns, "mixed")))
