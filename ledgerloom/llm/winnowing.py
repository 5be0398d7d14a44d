"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words is one window. Texts are turned into
hashes of K consecutive words, of which the least in every stretch of W is kept (of equal ones the last). With
K + W - 1 = WINDOW every shared span of WINDOW words has a kept hash in common, at the same place. So kept hashes of
documents and items are joined; each match is extended to the windows that hold it, and these are joined with the items'
windows as text: what is reported is equal word by word, whatever the hashes do. Where items are shorter, W follows the
shortest; items of under K words have hashes of their whole length beside the others.

A bitmap of fixed size (BITS) of the items' hashes goes to the tasks and drops what can't match before it leaves them:
at any size of the benchmark the result is the same, a full bitmap only drops less. Equal texts are worked on once; only
texts that may be hit are carried along. Items found are listed per combination of windows' item sets, not per document.

Null, empty and wordless texts and items: no words, never hit. Very long texts: whole, in memory one at a time. Items
without an id are searched for but not listed. Items of one id count once, whatever their texts. Repeated documents: a row
each. Null doc_ids: like others. Empty tables: no rows, or nothing is hit. All columns of the documents are kept; the
results are in one struct column, whose name gets underscores where it is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import free_name, join_small, materialise, renamed, settle, slices

WINDOW = 10
K = 5
#: Size of the bitmap of the items' hashes: 512 KB, whatever the benchmark's size.
BITS = 1 << 22
#: Bytes of text whose words are hashed together; one text may be longer.
BLOCK = 1 << 20
_IN_WORD = np.zeros(256, bool)
for _from, _to in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):  # after lower-casing; letters beyond ASCII are bytes from 80 on
    _IN_WORD[_from : _to + 1] = True
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]
#: (words of a hash, hashes of which one is kept)
Plan = list[tuple[int, int]]


def plan(lengths: list[int], window: int = WINDOW, k: int = K) -> Plan:
    """What to hash so that every window of these lengths (window itself and those of shorter items) has a kept hash."""
    long = [n for n in lengths if n >= k]
    return ([(k, min(long) - k + 1)] if long else []) + [(n, 1) for n in sorted(set(lengths)) if n < k]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(_IN_WORD[raw], prepend=False, append=False))
    return edges[::2], edges[1::2]


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial of each word's bytes, from sums over all bytes."""
    if len(_powers[0]) <= len(raw):
        size = max(BLOCK, len(raw)) + 1
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    sums = np.zeros(len(raw) + 1, "u8")
    np.cumsum((raw.astype("u8") + np.uint64(1)) * _powers[0][: len(raw)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _powers[1][starts])


def _kept(words: np.ndarray, text_of: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the kept hashes of k words: the last of the least in each stretch of w within one text."""
    n = len(words) - k + 1
    if n < w:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = h * _BASE + words[j : j + n]
    h = _mixed(h)
    stretches = n - w + 1
    least, at = h[:stretches].copy(), np.arange(stretches)
    for j in range(1, w):
        lower = h[j : j + stretches] <= least
        least = np.where(lower, h[j : j + stretches], least)
        at[lower] = np.flatnonzero(lower) + j
    at = at[text_of[:stretches] == text_of[w + k - 2 :]]
    at = at[np.diff(at, prepend=-1) > 0]
    return at, h[at]


def winnowed(texts: list[bytes], what: Plan) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text's number, its words, its kept hashes) of each text; the texts are lower-cased bytes."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end]) + 1
            end += 1
        raw = np.frombuffer(b" ".join(texts[at:end]), "u1")
        starts, ends = _word_spans(raw)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[at:end]])
        text_of = np.searchsorted(first, starts, side="right") - 1
        words = _word_hashes(raw, starts, ends)
        n_words = np.bincount(text_of, minlength=end - at)
        places, values = zip(*[_kept(words, text_of, k, w) for k, w in what], strict=True) if what else ((np.zeros(0, "i8"),), (np.zeros(0, "u8"),))
        of, values = text_of[np.concatenate(places)], np.concatenate(values)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(end - at + 1))
        for i in range(end - at):
            yield at + i, int(n_words[i]), values[order[cuts[i] : cuts[i + 1]]]
        at = end


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _split(raw: bytes) -> list[bytes]:
    starts, ends = _word_spans(np.frombuffer(raw, "u1"))
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (id as text), window (its words, lower-cased, joined by blanks), k (how many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _split(_lowered(text))
                k = min(window, len(words))
                found = [b" ".join(words[i : i + k]).decode("utf-8", "surrogatepass") for i in range(len(words) - k + 1)] if k else []
                for part in range(0, len(found), 10_000):
                    some = found[part : part + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([k] * len(some), pa.int32())], ["item", "window", "k"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "item string, window string, k int")


def _hashes(windows: DataFrame, what: Plan) -> DataFrame:
    """h: the distinct kept hashes of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            found = [h for _, _, h in winnowed([_lowered(t) for t in batch.column(0).to_pylist()], what)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view("i8"))], ["h"])

    return windows.select("window").mapInArrow(run, "h bigint").distinct()


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """BITS bits, set where a hash falls; BITS / 64 longs at most come to the driver."""
    at = hashes.select(F.col("h").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("bit")).select(F.shiftright("bit", 6).alias("i"), F.expr("shiftleft(1L, bit & 63)").alias("bits"))
    out = np.zeros(BITS // 64, "i8")
    for r in at.groupBy("i").agg(F.bit_or("bits").alias("bits")).collect():
        out[r.i] = r.bits
    return out.view("u1")


def _prints(docs: DataFrame, what: Plan, bits: np.ndarray, text_at: int) -> DataFrame:
    """docs (columns in0, in1, ...), their words' number, the kept hashes that the bitmap knows; the text stays under the name found where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text_at).to_pylist()
            counts, found, texts_found = [], [], []
            for i, n, h in winnowed([_lowered(t) for t in texts], what):
                slot = (h & np.uint64(BITS - 1)).astype("i8")
                known = np.unique(h[(bits[slot >> 3] >> (slot & 7).astype("u1")) & 1 == 1]).view("i8")
                counts.append(n)
                found.append(known)
                texts_found.append(texts[i] if len(known) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(texts_found, pa.string())], [*batch.schema.names, "n_words", "hashes", "found"]
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL("n_words bigint, hashes array<bigint>, found string").fields]))


def _around(texts: DataFrame, what: Plan, lengths: list[int], k: int) -> DataFrame:
    """key, start, k, window: the windows of the given lengths that hold a matched hash (array hashes) of the text found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for key, text, hashes in zip(batch.column("key").to_pylist(), batch.column("found").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                raw = _lowered(text)
                part = np.frombuffer(raw, "u1")
                starts, ends = _word_spans(part)
                words, known = _word_hashes(part, starts, ends), np.array(hashes, "i8").view("u8")
                split = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                rows: list[tuple[int, int]] = []
                for width, w in what:
                    at, h = _kept(words, np.zeros(len(words), "i8"), width, w)
                    at = at[np.isin(h, known)]
                    for n in lengths if len(at) else ():
                        if n >= k if width == k else n == width:
                            begins = np.unique((at[:, None] - np.arange(n - width + 1)).ravel())
                            rows += [(s, n) for s in begins[(begins >= 0) & (begins <= len(words) - n)].tolist()]
                for some in (rows[i : i + 10_000] for i in range(0, len(rows), 10_000)):
                    windows = [b" ".join(split[s : s + n]).decode("utf-8", "surrogatepass") for s, n in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(some), pa.binary()), pa.array([s for s, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64()), pa.array(windows, pa.string())], ["key", "start", "k", "window"]
                    )

    return texts.select("key", "found", "hashes").mapInArrow(run, "key binary, start bigint, k bigint, window string")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "leak"
) -> DataFrame:
    """docs, all columns, and a struct: n_words, n_hit (words in any occurrence of an item's window), spans (of hit words: start, end) and items (ids as text, sorted)."""
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and window")

    def build() -> DataFrame:
        windows = materialise(item_windows(items, window, item_id, item_text), "windows")
        lengths = sorted(r.k for r in windows.select("k").distinct().collect())  # window of them at most
        what = plan(lengths, window, k)
        sets = windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
        sets = materialise(sets.withColumn("set", F.unhex(F.md5(F.to_json("items").cast("binary")))), "sets")
        hashes = materialise(_hashes(sets, what), "hashes")
        apart, back = renamed(docs.columns)
        at = docs.columns.index(text_col)
        keyed = docs.select(*apart).withColumn("key", F.unhex(F.sha2(F.coalesce(F.col(f"in{at}"), F.lit("")), 256)))
        prints = materialise(_prints(keyed, what, _bitmap(hashes), at), "prints")

        may = prints.where("found IS NOT NULL")
        meet = join_small(may.select("key", F.explode("hashes").alias("h")), hashes, ["h"], F.col("key"), "left_semi")
        matched = materialise(meet.groupBy("key").agg(F.collect_set("h").alias("hashes")), "matched")
        texts = join_small(may.select("key", "found"), matched.select("key"), ["key"], F.col("found"), "left_semi").groupBy("key").agg(F.first("found").alias("found"))
        around = _around(texts.join(matched, "key"), what, lengths, k)
        hits = materialise(join_small(around, sets.select("window", "set"), ["window"], F.struct("key", "start"), "inner").select("key", "start", (F.col("start") + F.col("k")).alias("end"), "set"), "hits")

        by = Window.partitionBy("key").orderBy("start", "end")
        before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
        islands = hits.select("key", "start", "end", F.coalesce(F.col("start") > before, F.lit(True)).cast("int").alias("opens")).withColumn("island", F.sum("opens").over(by))
        spans = islands.groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        spans = spans.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
        combined = materialise(hits.groupBy("key").agg(F.sort_array(F.collect_set("set")).alias("sets")), "combined")
        listed = combined.select("sets").distinct().select("sets", F.explode("sets").alias("set")).join(sets.groupBy("set").agg(F.first("items").alias("items")), "set")
        listed = listed.select("sets", F.explode("items").alias("item")).groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("items"))
        found = materialise(spans.join(combined, "key").join(listed, "sets", "left").select("key", "n_hit", "spans", "items"), "found")

        none = F.array().cast("array<struct<start: bigint, end: bigint>>")
        struct = F.struct("n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        rows = join_small(prints.drop("hashes", "found"), found, ["key"], F.struct(*[c for c in keyed.columns if c in ("in0", "key")], "n_words"))
        return rows.select(*back, struct.alias(free_name(docs.columns, name)))

    return settle(build, "contamination")


def keep_clean(docs: DataFrame, items: DataFrame, **how: str) -> DataFrame:
    """docs without those that hold a window of an item."""
    name = free_name(docs.columns, "leak")
    return contamination(docs, items, **how).where(F.col(f"{name}.n_hit") == 0).select(*docs.columns)
