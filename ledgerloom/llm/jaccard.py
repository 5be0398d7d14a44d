"""Near copies by shingle similarity: all pairs of documents whose sets of word shingles have a Jaccard index of 0.8 or more.

SimHash first: fingerprints of the same shingles are searched by multi-index hashing (simhash.links), and of the pairs
within its distance those that the whole sets confirm are links. But similar documents often differ in more bits than a
search by segments reaches (11 and 17 of 64 for the two pairs of the smallest table), so a second search completes it and
none is missed: if the shingles are put in one order that holds for the whole table, then of a set of n the first
n - ceil(0.8 n) + 1 share one with those of each similar set.
Equi-joins on these prefixes fetch the pairs, of a shingle those alone that have as many shingles left after it, on either
side, as they must share: the shorter set is then asked for by its first ninth, not its first fifth. Of each pair the number
of shared shingles and the last place of one bound what both sets can share; where that is enough, the whole sets decide.
The order has common shingles last, the more common the later, so that passages that many documents hold fetch nothing
unless they are nearly all of a document. How common a shingle is may be estimated from a sample: any order gives the same links.

Documents with one set count as one node. Where very many nodes share a prefix shingle, rounds first compare all of them
with some of them; then only pairs that aren't yet in one component are compared.

Null or empty text (no words): the empty set, one node. Null doc_id: represents a group only if it has no other. Repeated
rows: one stays. Empty table: no rows. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import keep_first, materialise, row_key, settle, slices, small
from ledgerloom.llm.simhash import components, fingerprint_of, shingle_hashes
from ledgerloom.llm.simhash import links as fingerprint_links

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
#: Documents that hold a shingle beyond which it goes to the end of the order, and the most shingles that do.
COMMON, MOST_COMMON = 10, 200_000
#: Nodes with one prefix shingle beyond which they are first compared with some of them, and how many at least, by rounds.
#: Rounds only spare the last join pairs, few against those that they spare: it finds what they leave.
CROWDED, HEADS = 100, (4, 32)
#: Beyond so many pairs of the last join one in SHARE is verified first, SHARES times: only pairs that these leave in two
#: components are verified after them. All links that join components are found either way.
MANY_PAIRS, SHARE, SHARES = 5_000, 8, 3


def _set_of(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle).view("i8"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def common_shingles(docs: DataFrame, rows: int, shingle: int = SHINGLE, common: int = COMMON, text_col: str = "text") -> np.ndarray:
    """Shingles in over `common` different texts or so, the least common first."""
    part = min(16, max(1, rows // 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_set_of(t, shingle) for t in batch.column(0).to_pylist()]))], ["hash"])

    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).distinct()
    counts = some.mapInArrow(run, "hash bigint").groupBy("hash").count()
    many = counts.where((F.col("count") * part > common) & (F.col("count") >= min(part, 2))).orderBy(F.desc("count"), "hash").limit(MOST_COMMON).toArrow()
    return many.column("hash").to_numpy()[::-1].astype("i8")


def shingle_sets(docs: DataFrame, last: np.ndarray, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the row), node (a hash of the set), n, fp (its SimHash), prefix of every row: the shingles, in the
    order that has those of `last` last, of which a similar set holds one in its own prefix. The whole sets aren't kept."""
    up, down = similar
    by = np.argsort(last)
    known, rank = last[by], by.astype("i4")

    def prefix(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        late = known[at] == h if len(known) else np.zeros(len(h), bool)
        ordered = np.concatenate([h[~late], h[late][np.argsort(rank[at[late]])]]) if late.any() else h
        return ordered[: len(h) + (-up * len(h) // down) + 1 if len(h) else 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_set_of(t, shingle) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], "u8").view("i8")
            fps = np.array([fingerprint_of(s) for s in sets], "u8").view("i8")
            heads = [prefix(s) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(h) for h in heads])].astype("i4")), pa.array(np.concatenate(heads)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(s) for s in sets], "int32"), pa.array(fps), lists], ["doc_id", "key", "node", "n", "fp", "prefix"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, key binary, node bigint, n int, fp bigint, prefix array<bigint>")


#: Whole sets (node, hashes) of the nodes asked for (node, distinct).
Whole = Callable[[DataFrame], DataFrame]


def whole_sets(docs: DataFrame, rows: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> Whole:
    """Sets are made again from one text of each node that is asked for: far fewer than there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_set_of(t, shingle) for t in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype("i4")), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "hashes"])

    def of(asked: DataFrame) -> DataFrame:
        keys = materialise(rows.join(small(asked), "node").groupBy("node").agg(F.min("key").alias("key")), "asked")
        texts = _keyed(docs, id_col, text_col).join(small(keys), "key").select("node", "text").dropDuplicates(["node"])
        return texts.mapInArrow(run, "node bigint, hashes array<bigint>")

    return of


def _verified(pairs: DataFrame, whole: Whole, similar: tuple[int, int]) -> DataFrame:
    """src, dst of those pairs (src, dst; materialised) whose sets are similar."""
    if not pairs.limit(1).count():
        return pairs

    def build() -> DataFrame:
        asked = materialise(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
        held = materialise(whole(asked), "held")
        both = pairs.join(held.select(F.col("node").alias("src"), F.col("hashes").alias("a")), "src").join(held.select(F.col("node").alias("dst"), F.col("hashes").alias("b")), "dst")
        shared = F.size(F.array_intersect("a", "b"))
        return both.where(shared * similar[1] >= (F.size("a") + F.size("b") - shared) * similar[0]).select("src", "dst")

    return settle(build, "similar")


def _possible(met: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """src, dst of those pairs a, b that may be similar; met holds a row for each shingle that both have early enough.

    Shared shingles before the last of these are among them, so both can share no more than these and what follows it.
    """
    up, down = similar
    each = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("pos_a").alias("i"), F.max("pos_b").alias("j"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    most = F.col("c") + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j")) - 1
    return each.where(most * (up + down) >= (F.col("n_a") + F.col("n_b")) * up).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def simhash_links(sets: DataFrame, whole: Whole, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """src, dst: similar nodes that multi-index hashing of their fingerprints finds. One node stands for a fingerprint; the
    others that have it are compared with that one."""
    nodes = materialise(sets.select("node", "fp").distinct(), "fingerprints")
    heads = materialise(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    head = lambda fp, name: heads.select(F.col("fp").alias(fp), F.col("head").alias(name))
    far = fingerprint_links(heads.select("fp")).join(head("src", "a"), "src").join(head("dst", "b"), "dst").select("a", "b")
    same = nodes.join(heads.where("n > 1"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = far.unionByName(same).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return _verified(materialise(pairs, "pairs"), whole, similar)


def links(sets: DataFrame, whole: Whole, similar: tuple[int, int] = SIMILAR, crowded: int = CROWDED) -> DataFrame:
    """src, dst: links that join the same components as all pairs of similar nodes do."""
    up, down = similar
    every = sets.select("node", "n", F.posexplode("prefix").alias("pos", "hash"))
    w = Window.partitionBy("hash")
    met = every.select("*", F.min("node").over(w).alias("low"), F.max("node").over(w).alias("high")).where("low <> high").select("node", "n", "hash", "pos").distinct()
    shared = materialise(met, "shared")
    near = (F.col("n_a") * down >= F.col("n_b") * up) & (F.col("n_b") * down >= F.col("n_a") * up)
    # at its first shared shingle a similar pair has as many left on either side as it must share
    least = F.floor(((F.col("n_a") + F.col("n_b")) * up + up + down - 1) / (up + down))
    within = (F.col("pos_a") + least <= F.col("n_a")) & (F.col("pos_b") + least <= F.col("n_b"))
    found = simhash_links(sets, whole, similar)

    def place(of: DataFrame) -> DataFrame:
        """of, with each node's root so far. found becomes a link from each node to its root, which joins the same."""
        nonlocal found
        roots = materialise(components(found), "roots")
        found = roots.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst"))
        return materialise(of.join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")

    hot = materialise(shared.groupBy("hash").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowded), "crowds")
    crowd = hot.limit(1).count() > 0
    crowds = materialise(shared.join(small(hot), "hash"), "crowded") if crowd else hot
    for r, heads_each in enumerate(HEADS if crowd else ()):
        rows_of = place(crowds)
        one_in = F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("size") / heads_each, F.lit(1.0))))).cast("bigint")  # so that shingles of one group have the same heads
        heads = rows_of.where(F.pmod(F.xxhash64(F.lit(r), "node"), one_in) == 0).select("hash", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "root")])
        heads = materialise(heads, "heads")
        met = rows_of.select("hash", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "root")]).join(small(heads), "hash").where((F.col("root_a") != F.col("root_b")) & near & within)
        asked = materialise(met.select(F.least("node_a", "node_b").alias("src"), F.greatest("node_a", "node_b").alias("dst")).distinct(), "asked")
        if not asked.limit(1).count():
            break
        found = found.unionByName(_verified(asked, whole, similar))
    placed = place(shared)
    # One shuffle by shingle serves both sides: of a shingle's nodes those outside its largest component ask all others.
    dealt, at = placed.repartition(F.col("hash")), Window.partitionBy("hash")
    dealt = dealt.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("hash", "root")))
    dealt = dealt.withColumns({"main": F.max(F.struct("size", "root")).over(at)["root"], "low": F.min("root").over(at), "high": F.max("root").over(at)}).where("low <> high")
    names = lambda x: [F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "pos", "root")]]
    ours, theirs = dealt.select("hash", "main", *names("a")).where("root_a <> main"), dealt.select("hash", *names("b"))
    met = ours.join(theirs, "hash").where((F.col("root_a") != F.col("root_b")) & near & within & ((F.col("a") < F.col("b")) | (F.col("root_b") == F.col("main"))))
    low = F.col("a") < F.col("b")  # a pair is seen from either side, as its shingles have different largest components
    of = lambda x, y: [F.when(low, F.col(f"{p}{x}")).otherwise(F.col(f"{p}{y}")).alias(f"{p}{x}") for p in ("", "n_", "pos_")]
    met = met.select(*of("a", "b"), *of("b", "a"))
    pairs = materialise(_possible(met, similar), "pairs")
    for r in range(SHARES):  # of very many pairs a part first: what it joins needs no others
        if pairs.count() <= MANY_PAIRS:
            break
        mine = F.pmod(F.xxhash64(F.lit(r), "src", "dst"), F.lit(SHARE)) == 0
        found = found.unionByName(_verified(materialise(pairs.where(mine), "some-pairs"), whole, similar))
        roots = materialise(components(found), "roots")
        root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))  # noqa: E731,B023
        left = pairs.where(~mine).join(small(root("src")), "src", "left").join(small(root("dst")), "dst", "left")
        pairs = materialise(left.where(F.coalesce("root_src", "src") != F.coalesce("root_dst", "dst")).select("src", "dst"), "pairs")
    return found.unionByName(_verified(pairs, whole, similar))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, common: int = COMMON, crowded: int = CROWDED) -> DataFrame:
    """doc_id, key (see row_key), root (the same for all rows that links join)."""
    last = common_shingles(docs, docs.count(), shingle, common)
    sets = materialise(shingle_sets(docs, last, shingle, similar), "shingle-sets")
    rows = sets.select("doc_id", "key", "node")
    roots = settle(lambda: components(links(sets, whole_sets(docs, rows, shingle), similar, crowded)), "roots")
    return rows.join(small(roots), "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, **options) -> DataFrame:
    """docs, all columns, with one row of each group of near copies: that of least doc_id (see keep_first)."""
    return keep_first(docs, settle(lambda: near_copies(docs, shingle, similar, **options), "near-copies"))
