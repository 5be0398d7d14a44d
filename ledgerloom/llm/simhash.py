"""SimHash near-duplicate components by multi-index hashing.

A fingerprint is 64 bits wide and is cut into two segments. Fingerprints within distance 3 differ by at most one bit in
one segment at least (3 bits over 2 segments). So each distinct fingerprint enumerates the Hamming ball of radius one
around each segment, fetches the matches from the segment's table by an equi-join, and verifies the whole distance.
Of two keys that differ in one bit one has it set: it alone probes, with that bit cleared.

Documents with one fingerprint count as one node, so copies are never expanded into pairs. Very large buckets are not
joined: see _dense(). Components come from contraction rounds over written tables, the last links (at most FEW_LINKS, by
count) from one task; no link reaches the driver.

Null or empty text (no words): fingerprint zero, linked like any other. Null doc_id: kept, not a candidate for a
component's id unless it has no other. Repeated rows: same component. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import join_hot, keep_first, materialise, row_key, slices

DISTANCE = 3
SHINGLE = 3
SEED = 42
SEGMENT_BITS = 32
#: Fingerprints that share a segment key beyond which the bucket is taken apart by single differences (see _dense).
DENSE_BUCKET = 2_000
#: So many links, and no more, are joined in one task: contraction goes on until that few are left.
FEW_LINKS = 100_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle of the ASCII-lower-cased text; bytes.split() splits at exactly 20 and 09-0D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([digest(join(words), SEED)], "<u8")
    return np.fromiter((digest(join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)), "<u8", len(words) - shingle + 1)


def fingerprint_of(h: np.ndarray, block: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, "i8")
    for at in range(0, len(h), block):
        ones += np.unpackbits(h[at : at + block].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE, block: int = 1 << 16) -> int:
    """Of the shingle hashes, repeats included."""
    return fingerprint_of(shingle_hashes(text, shingle), block)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; keyed: and the row's key (see row_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(0).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], [*batch.schema.names[1:], "fp"])

    key = [row_key(F.col(id_col), F.col(text_col)).alias("key")] if keyed else []
    return docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), *key).mapInArrow(run, f"doc_id bigint, {'key binary, ' if keyed else ''}fp bigint")


def _segment(fp: Column, s: int) -> Column:
    return F.shiftrightunsigned(fp, SEGMENT_BITS * s).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, distance: int = DISTANCE, dense: int = DENSE_BUCKET) -> DataFrame:
    """src, dst: links that join the same components as all pairs of distinct fingerprints within the distance do."""
    if distance > 3:
        raise ValueError("two segments of radius one hold distances up to 3")
    table = nodes.select("fp", F.posexplode(F.array(_segment(F.col("fp"), 0), _segment(F.col("fp"), 1))).alias("s", "key"))
    sizes = table.groupBy("s", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
    hot = materialise(sizes.select("s", "key"), "dense-buckets")
    crowded = hot.limit(1).count() > 0
    sparse = table.join(hot, ["s", "key"], "left_anti") if crowded else table
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: F.getbit(F.col("key"), i) == 1)
    ball = F.concat(F.array(F.col("key")), F.transform(set_bits, lambda i: F.col("key") - F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    probes = table.select(F.col("fp").alias("src"), "s", F.explode(ball).alias("key"))
    found = probes.join(sparse.withColumnRenamed("fp", "dst"), ["s", "key"]).where((_distance("src", "dst") <= distance) & (F.col("src") != F.col("dst")))
    out = found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return out.unionByName(_dense(nodes, table, hot, distance)) if crowded else out


def _dense(nodes: DataFrame, table: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """Links to the members of dense buckets, without pairing a bucket with itself.

    Each fingerprint whose segment is in, or one bit off, a dense bucket asks the table of whole fingerprints for every
    neighbour within the distance whose bits differ in at most one place in that segment: an equi-join on 64 bits, whose
    work is the number of askers times a constant, not the square of the bucket.
    """
    near = F.concat(F.array(F.col("key")), F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    around = table.select("fp", "s", F.col("key").alias("own"), F.explode(near).alias("key"))
    askers = around.join(hot, ["s", "key"]).select("fp", "s", "key", (F.col("key") != F.col("own")).cast("int").alias("used"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.left_shift(np.uint64(1), np.arange(SEGMENT_BITS, dtype="u8"))
        masks = [np.zeros(1, "u8"), one]
        for _ in range(2, distance + 1):
            more = np.bitwise_or.outer(masks[-1], one).ravel()
            masks.append(np.unique(more[np.bitwise_count(more) == len(masks)]))
        balls = [np.concatenate(masks[: r + 1]) for r in range(distance + 1)]
        for batch in batches:
            for fp, s, key, used in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.array(fp, "i8").view("u8")
                own = np.uint64(SEGMENT_BITS * s)
                other = np.uint64(SEGMENT_BITS * (1 - s))
                base = (x & ~(np.uint64((1 << SEGMENT_BITS) - 1) << own)) | (np.uint64(key) << own)
                asked = (base ^ (balls[distance - used] << other)).view("i8")
                asked = asked[asked != fp]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), fp, "i8")), pa.array(asked)], ["src", "dst"])

    asked = askers.mapInArrow(run, "src bigint, dst bigint")
    found = asked.join(nodes.select(F.col("fp").alias("dst")), "dst", "left_semi")
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _hub_sizes(edges: DataFrame, total: int, least: int = 1_000_000) -> tuple[int, DataFrame] | None:
    """How many edges there are and each node's degree, where a node has over 1/1000 of very many edges."""
    if total < least:
        return None
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    degrees = materialise(degrees, "degrees")
    return (total, degrees) if degrees.where(F.col("n") * 1000 > total).limit(1).count() else None


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root (the least node that links reach) of the links src, dst."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, "int64"), pa.array([top(x) for x in nodes], "int64")], ["node", "root"])


def components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """node, root of every node that has a link. Each round every node moves to the neighbour of least random rank.

    Random ranks make chains shrink by a constant factor a round. Edges are contracted and written until few are left,
    which one task joins; the rounds' maps are then composed from the last to the first.
    """
    edges, maps = materialise(edges, "links"), []
    while left := edges.count():
        if left <= few:
            maps.append(materialise(edges.select("src", "dst").coalesce(1).mapInArrow(_joined, "node bigint, root bigint"), "joined"))
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("r"), c.alias("to"))  # noqa: E731,B023
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        best = both.groupBy("src").agg(F.min(rank(F.col("dst"))).alias("best"))
        step = materialise(best.select(F.col("src").alias("node"), F.least("best", rank(F.col("src")))["to"].alias("root")), "contraction")
        maps.append(step)
        if round_sizes := _hub_sizes(edges, left):  # a hub's edges meet its new root by a broadcast
            total, degrees = round_sizes
            weighed = materialise(step.join(degrees, "node").select("node", "root", "n"), "weighed")
            end = lambda name, to: weighed.select(F.col("node").alias(name), F.col("root").alias(to), "n")  # noqa: E731,B023
            moved = join_hot(materialise(join_hot(edges, end("src", "a"), "src", "n", total, "inner"), "half"), end("dst", "b"), "dst", "n", total, "inner")
        else:
            moved = edges.join(step.select(F.col("node").alias("src"), F.col("root").alias("a")), "src").join(step.select(F.col("node").alias("dst"), F.col("root").alias("b")), "dst")
        edges = materialise(moved.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "links")
    if not maps:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    out = maps[-1]
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, dense: int = DENSE_BUCKET, keyed: bool = False) -> DataFrame:
    """doc_id, fp (long), component_id (the least doc_id that links reach), root (a fingerprint, the component's name);
    keyed: and the row's key."""
    prints = materialise(fingerprints(docs, shingle, keyed=keyed), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), distance, dense)).select(F.col("node").alias("fp"), "root")
    joined = materialise(nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "roots")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    members = joined.agg(F.count(F.lit(1))).first()[0]
    groups = materialise(join_hot(joined, materialise(least, "least"), "root", "members", members, "inner").select("fp", "n", "component_id", "root"), "groups")
    return join_hot(prints, groups, "fp", "n", prints.count(), "inner")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """docs, all columns, with one row of each component: that of least doc_id (see keep_first)."""
    return keep_first(docs, materialise(near_duplicates(docs, distance, shingle, keyed=True).select("doc_id", "key", "root"), "near-copies"))
