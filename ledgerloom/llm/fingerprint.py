"""Order MinHash fingerprints of texts, sensitive to edit distance, in DataFrame expressions alone.

A text's words give k-mers; the n-th occurrence of a k-mer counts as an element of its own. For each of SKETCHES random
orders the TAKE least elements are chosen, kept in the order in which they stand in the text, and their k-mers hashed
together: one entry of the fingerprint. Two texts agree in an entry about as often as they share both k-mers and their
order, so moved blocks count, unlike with plain MinHash.

The orders are rotations of one 64-bit hash: order j counts upwards from j * 2^58, and wraps around. So all of them are
read from one sorted array: SKETCHES marks are sorted in among the elements, and each mark's successors are its choice.
Hash and place share one long (the place takes as many low bits as the text needs, 20 at least), so that Spark sorts
plain long arrays. Everything stays within a row: nothing is exploded or shuffled for a fingerprint.

Null or empty text (no words): the fingerprint EMPTY; two such are alike, and unlike any other. Fewer words than k: the
whole sequence is the one k-mer. A single element: chosen twice. Repeated rows: equal fingerprints. Empty table: no rows.
Null doc_ids come last and are dealt by their texts' hashes. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise

K = 5
TAKE = 2
SKETCHES = 64
DIGITS = 8
EMPTY = "0" * (SKETCHES * DIGITS)
#: Ranges of doc_id that hold neighbours together, for each shuffle partition.
RANGES_PER_PARTITION = 4


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def kmer_hashes(w: Column, k: int = K) -> Column:
    """A 64-bit hash of each run of k words, in text order."""
    n = F.size(w)
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    runs = lambda h: F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.aggregate(hashed, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)))).otherwise(_let(hashed, runs))


def _packed(h: Column, bits: Column) -> Column:
    """(element hash with its low bits replaced by place + 1) for every occurrence-numbered k-mer; order is immaterial.

    First occurrences keep their k-mer's hash. Where k-mers repeat, hashes and places are sorted together, and every run of
    one hash numbers its members by their distance from the run's start.
    """
    low = _shift(F.lit(1).cast("bigint"), bits) - 1
    pack = lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint") + 1)
    plain = F.transform(h, pack)
    n = F.size(h)

    def numbered(s: Column) -> Column:
        head = lambda i: F.get(s, i).bitwiseAND(F.bitwise_not(low))
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (head(i) != head(i - 1)))

        def runs(first: Column) -> Column:
            def run(start: Column, r: Column) -> Column:
                end = F.coalesce(F.get(first, r + 1), n) - 1

                def element(i: Column) -> Column:
                    place = (F.get(s, i).bitwiseAND(low) - 1).cast("int")
                    return F.when(i == start, F.get(s, i)).otherwise(pack(F.xxhash64(F.get(h, place), i - start), place))

                return F.transform(F.sequence(start, end), element)

            return F.flatten(F.transform(first, run))

        return _let(starts, runs)

    return F.when(F.size(F.array_distinct(h)) == n, plain).otherwise(_let(F.sort_array(plain), numbered))


def order_minhash(text: Column, k: int = K) -> Column:
    """The fingerprint of a text: SKETCHES entries of DIGITS hex digits."""
    marks = F.array(*[F.lit((j - SKETCHES // 2) << 58) for j in range(SKETCHES)])

    def sketch(h: Column) -> Column:
        n = F.size(h)
        bits = F.greatest(F.lit(20), F.ceil(F.log2(n + 2)).cast("int"))
        low = _shift(F.lit(1).cast("bigint"), bits) - 1

        def choose(s: Column) -> Column:
            """s: the sorted elements and, among them, the marks (those with no place)."""
            elements = F.filter(s, lambda x: x.bitwiseAND(low) != 0)
            at = F.filter(F.sequence(F.lit(0), n + SKETCHES - 1), lambda i: F.get(s, i).bitwiseAND(low) == 0)

            def entries(e: Column) -> Column:
                place = lambda i: (F.get(e, F.pmod(i, n)).bitwiseAND(low) - 1).cast("int")

                def entry(i: Column, j: Column) -> Column:
                    chosen = F.sort_array(F.array(*[place(i - j + t) for t in range(TAKE)]))
                    folded = F.xxhash64(*[F.get(h, F.get(chosen, F.lit(t))) for t in range(TAKE)])
                    return F.lower(F.lpad(F.hex(folded.bitwiseAND(F.lit(0xFFFFFFFF))), DIGITS, "0"))

                return F.array_join(F.transform(at, entry), "")

            return _let(elements, entries)

        return F.when(n == 0, F.lit(EMPTY)).otherwise(_let(F.sort_array(F.concat(_packed(h, bits), marks)), choose))

    return _let(words(text), lambda w: _let(kmer_hashes(w, k), sketch))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal entries, 0 to 1."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), F.lit(0), lambda n, i: n + (F.substr(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, i * DIGITS + 1, F.lit(DIGITS))).cast("int"))
    either = (a == F.lit(EMPTY)) | (b == F.lit(EMPTY))
    return F.when(either, (a == b).cast("double")).otherwise(same / F.lit(float(SKETCHES)))


def _ranges(docs: DataFrame, spark: SparkSession) -> Column:
    """The number of a row's range of doc_id, by a two-step search in quantiles; rows without one: ranges below 0 by hash."""
    n = max(2, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    side = max(1, math.isqrt(len(cuts)))
    parts = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    under = lambda values: F.size(F.filter(values, lambda c: c < F.col("doc_id")))
    longs = lambda values: F.array(*[F.lit(c).cast("bigint") for c in values])
    if not cuts:
        known = F.lit(0)
    else:
        part = F.greatest(under(longs([p[0] for p in parts])) - 1, F.lit(0))  # the last part that starts below
        known = part * side + under(F.get(F.array(*[longs(p) for p in parts]), part))
    hashed = F.lit(-1) - (F.shiftright(F.xxhash64("text"), 52) + 2048).cast("int")
    return F.when(F.col("doc_id").isNull(), hashed).otherwise(known.cast("int"))


def edit(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) characters replaced by the following text's first as many, or all of it."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, next_fingerprint, edited, where next is the following row, doc_id descending, and the
    first after the last.

    Rows are dealt by ranges of doc_id, so one shuffle of the texts brings neighbours together; only the first and the
    last row of each range are joined, a bounded number of rows. Equal ids are ordered by text digest; null ids come last.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = base.withColumn("range", _ranges(base, docs.sparkSession)).withColumn("fingerprint", order_minhash(F.col("text")))
    w = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text"))
    near = keyed.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(w)).withColumn("head", F.row_number().over(w) == 1)
    last = F.col("next").isNull()
    near = materialise(
        near.select(
            "doc_id",
            "range",
            F.length("text").cast("bigint").alias("n_chars"),
            "fingerprint",
            F.col("next.fingerprint").alias("next_fingerprint"),
            F.when(~last, edit(F.col("text"), F.col("next.text"))).alias("edited"),
            F.when(last, F.col("text")).alias("last_text"),
            F.when(F.col("head"), F.struct("text", "fingerprint")).alias("first"),
        ),
        "neighbours",
    )
    heads = near.where("first IS NOT NULL").select("range", "first")
    every = Window.orderBy(F.col("range").desc())  # over one row a range
    below = heads.select("range").select("range", F.coalesce(F.lead("range").over(every), F.first("range").over(every)).alias("below"))
    links = below.join(heads.withColumnRenamed("range", "below"), "below").select("range", F.col("first").alias("following"))
    cols = ["doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited"]
    ends = near.where("last_text IS NOT NULL").drop("next_fingerprint", "edited").join(links, "range")
    ends = ends.withColumn("next_fingerprint", F.col("following.fingerprint")).withColumn("edited", edit(F.col("last_text"), F.col("following.text")))
    return near.where("last_text IS NULL").select(*cols).unionByName(ends.select(*cols))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, edited, edited_fingerprint, near_edited, near_next."""
    out = edited_texts(docs).withColumn("edited_fingerprint", order_minhash(F.col("edited")))
    return out.select("doc_id", "n_chars", "fingerprint", "edited", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
