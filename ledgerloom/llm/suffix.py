"""Repeated byte strings by column-wise multi-document suffix construction.

Every byte that lies in a string of at least `length` bytes which also starts anywhere else is found, exactly; and in the
same pass, for a shorter `passage`, the runs of repeated strings of at least that many bytes.

1. Candidates. Each window of `passage` bytes owns one anchor: its leftmost ANCHOR-byte string of least hash. Equal
   windows own equal anchors at equal places, so only anchors that occur twice can lie in a repeated window. Anchors are
   counted over all documents (partial sums first), and only documents that have a repeated one are read further.
2. Construction. Around each repeated anchor a piece is cut that holds the windows which own it, aligned at the anchor.
   The pieces that share anchors meet in a task and form a collection whose suffix order is built column by column, from
   right to left: each round inserts one symbol of every piece by a stable distribution of the column that the present
   order permutes (the collection's Burrows-Wheeler column), and updates the common prefixes of neighbours. The columns
   are read strictly in sequence. Two neighbours with a common prefix of `length` bytes or more are a repeated string, and
   so are those of `passage` bytes for the shorter runs.
3. Anchors with very many places (CROWDED; places, not documents, are counted) aren't gathered in a task: their windows are
   counted by a 128-bit hash, with partial sums, and hot windows meet their counts by a broadcast.
4. Exact copies need no suffixes: every byte of a copied text of at least `length` bytes is repeated. One copy goes on, to
   be found by others.

The external files of the published method are replaced by written Spark tables between the steps and by bounded blocks
of columns in a task's memory: a round per text position over one global file can't be dealt to tasks.

Null or empty text: no bytes. Null doc_id: kept, null in the result. Repeated rows are copies of each other. Empty table:
no rows. Other columns are ignored by repeated_spans() and carried along by without_repeats(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import join_hot, materialise, renamed, settle, slices

LENGTH = 400
#: Windows of a text that are hashed together; texts of any length are taken in such steps.
STEP = 1 << 22
#: Pieces of one block of columns, and places of an anchor beyond which its windows are counted by hash instead.
BLOCK_PIECES = 20_000
CROWDED = 20_000
#: A passage has over this many words; 51 words of two letters on average and the blanks between them have 152 bytes.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 152
#: Odd multipliers of the rolling hashes and of the finaliser.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Stands beyond a piece's ends; UTF-8 never has this byte.
PAD = 0xFF


def anchor_length(length: int) -> int:
    return max(1, (length * 48) // 100)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, "u8"), np.full(n, inverse, "u8")
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def window_hashes(b: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A mixed rolling hash of b[i : i + width] for every i."""
    n = len(b)
    up, down = _powers(base, max(1 << 12, 1 << (n - 1).bit_length()))
    sums = np.zeros(n + 1, "u8")
    np.cumsum((b.astype("u8") + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[width:] - sums[: n + 1 - width]) * down[: n + 1 - width]
    for m in MIX:
        h ^= h >> np.uint64(32)
        h *= np.uint64(m)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i, from running minima of blocks in both directions."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def self_repeats(b: np.ndarray, starts: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray | None, list[tuple[int, int]]]:
    """Windows that equal an earlier one of the same text at a short period, and the spans these two cover. starts and
    hashes are those of the text's anchors.

    Only texts whose anchors crowd (long runs of a repeated unit) are looked at; it saves work and changes no result, as
    the earlier window stays a candidate.
    """
    n = len(b)
    gaps = np.diff(starts)
    gaps = gaps[(hashes[1:] == hashes[:-1]) & (gaps < length)]
    if len(gaps) < 16 or len(starts) * length < 8 * n:
        return None, []
    periods, counts = np.unique(gaps, return_counts=True)
    later, spans = np.zeros(n - length + 1, bool), []
    for q in periods[np.argsort(-counts, kind="stable")][:64].tolist():
        if n < length + q:
            continue
        same = np.zeros(n - q + 1, "i8")
        np.cumsum(b[:-q] == b[q:], out=same[1:])
        hit = np.flatnonzero(same[length:] - same[:-length] == length)  # the windows at hit and hit + q are equal
        if len(hit):
            later[hit + q] = True
            cut = np.flatnonzero(np.diff(hit) > 1)
            spans += [(int(s), int(e) + q + length) for s, e in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]], strict=True)]
    return later, spans


def anchors(b: np.ndarray, length: int = LENGTH, passage: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """hash, place, first and last start of the windows (of passage bytes) that own it, for each anchor of a text; the
    self-repeated spans by length and by passage."""
    passage = passage or length
    k, n = anchor_length(passage), len(b)
    none = np.zeros(0, "i8")
    if n < passage:
        return none.view("u8"), none, none, none, [], []
    width, found = passage - k + 1, []
    for at in range(0, n - passage + 1, STEP):
        h = window_hashes(b[at : at + STEP + passage - 1], k)
        places = np.arange(len(h), dtype="u8")
        low = np.uint64((1 << 24) - 1)
        own = (sliding_min((h & ~low) | places, width) & low).astype("i8")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        found.append((h[own[first]], own[first] + at, first + at, np.r_[first[1:], len(own)] - 1 + at))
    hashes, place, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    later, shorter = self_repeats(b, place, hashes, passage)
    spans = shorter
    if later is not None and length > passage:  # a start is dropped only if its longer window, where there is one, repeats too
        later_long, spans = self_repeats(b, place, hashes, length) if n >= length else (None, [])
        fits = max(0, n - length + 1)
        later[:fits] &= later_long if later_long is not None else False
    if later is not None:
        fresh = np.r_[0, np.cumsum(~later)]
        keep = fresh[hi + 1] > fresh[lo]
        hashes, place, lo, hi = hashes[keep], place[keep], lo[keep], hi[keep]
    return hashes, place, lo, hi, spans, shorter


def repeated_windows(columns: np.ndarray, lengths: tuple[int, ...], starts: int) -> list[np.ndarray]:
    """For each length, which windows of which pieces also occur in another piece of the block.

    columns[d] holds the symbols of all pieces at column d. order is the suffix order of the pieces from the present
    column on, common[i] the common prefix (capped) of the pieces at order[i - 1] and order[i].
    """
    width, n = columns.shape
    hits = [np.zeros((n, starts), bool) for _ in lengths]
    order, common = np.arange(n), np.zeros(n + 1, "i2")
    for d in range(width - 1, -1, -1):
        symbols = columns[d][order]
        moved = np.argsort(symbols, kind="stable")
        symbols = symbols[moved]
        least = np.minimum.reduceat(common, moved + 1)[:-1] + 1
        least[symbols[1:] != symbols[:-1]] = 0
        common[1:n] = np.minimum(least, max(lengths))
        order = order[moved]
        if d < starts:
            for found, length in zip(hits, lengths, strict=True):
                pairs = np.flatnonzero(common[:n] >= length)
                found[order[pairs], d] = True
                found[order[pairs - 1], d] = True
    return hits


def _runs(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first and last column of every run of hits."""
    edge = np.zeros((hits.shape[0], hits.shape[1] + 2), "i1")
    edge[:, 1:-1] = hits
    change = np.diff(edge, axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - 1


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _profile(length: int, passage: int):
    names = ["rid", "sha", "n_bytes", "n_words", "hashes", "counts", "looped"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text or b""
                hashes, *_, spans, shorter = anchors(np.frombuffer(raw, "u1"), length, passage)
                found, times = np.unique(hashes, return_counts=True)
                rows.append((rid, hashlib.sha256(raw).digest(), len(raw), len(raw.split()), found.view("i8"), times.astype("i4"), bool(spans or shorter)))
            yield _batch(names, types, rows)

    return run


def _pieces(length: int, passage: int):
    reach = passage - anchor_length(passage)
    names, types = ["hash", "no", "base", "lo", "owned", "piece"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for no, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("no", "text", "wanted")), strict=True):
                if not wanted:
                    continue
                hashes, place, lo, hi, _, _ = anchors(np.frombuffer(text, "u1"), length, passage)
                for i in np.flatnonzero(np.isin(hashes.view("i8"), np.array(wanted, "i8"))).tolist():
                    rows.append((int(hashes[i : i + 1].view("i8")[0]), no, int(place[i]) - reach, int(lo[i]), int(hi[i] - lo[i]), text[lo[i] : hi[i] + length]))
                    if len(rows) > 20_000:
                        yield _batch(names, types, rows)
                        rows = []
            yield _batch(names, types, rows)

    return run


PIECE_SCHEMA = "hash bigint, no bigint, base bigint, lo bigint, owned int, piece binary"
HIT_SCHEMA = "no bigint, level int, start bigint, end bigint"


def _construct(length: int, passage: int, block: int):
    """Input rows sorted by anchor; a block holds whole anchors."""
    reach = passage - anchor_length(passage)
    lengths = (length,) if length == passage else (length, passage)

    def solve(no: list[int], base: list[int], lo: list[int], owned: list[int], pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        n, width = len(pieces), reach + length
        grid = np.full((n, width), PAD, "u1")
        at = np.array(lo, "i8") - np.array(base, "i8")
        for i, (piece, a) in enumerate(zip(pieces, at.tolist(), strict=True)):
            grid[i, a : a + len(piece)] = np.frombuffer(piece, "u1")
        sizes = np.array([len(p) for p in pieces])
        column = np.arange(reach + 1)
        for level, hits in enumerate(repeated_windows(np.ascontiguousarray(grid.T), lengths, reach + 1)):
            last = at + np.minimum(np.array(owned), sizes - lengths[level])  # no window with padding
            row, first, final = _runs(hits & (column >= at[:, None]) & (column <= last[:, None]))
            start = np.array(base, "i8")[row]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(no, "i8")[row]), pa.array(np.full(len(row), level, "i4")), pa.array(start + first), pa.array(start + final + lengths[level])], ["no", "level", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        last = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("hash", "no", "base", "lo", "owned", "piece")]
            for h, *row in zip(*cols, strict=True):
                if h != last and len(held[0]) >= block:
                    yield from solve(*held)
                    held = [[], [], [], [], []]
                last = h
                for to, x in zip(held, row, strict=True):
                    to.append(x)
        if len(held[0]) > 1:
            yield from solve(*held)

    return run


def _windows(length: int, passage: int):
    """For crowded anchors: two hashes of every window of a piece."""
    lengths = (length,) if length == passage else (length, passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, lo, owned, piece in zip(*(batch.column(c).to_pylist() for c in ("no", "lo", "owned", "piece")), strict=True):
                for level, size in enumerate(lengths):
                    if len(piece) < size:
                        continue
                    b = np.frombuffer(piece[: owned + size], "u1")
                    x, y = (window_hashes(b, size, base).view("i8") for base in BASES)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), no, "i8")), pa.array(np.full(len(x), level, "i4")), pa.array(np.full(len(x), lo, "i8")), pa.array(np.arange(len(x)) + lo), pa.array(x), pa.array(y)], ["no", "level", "lo", "at", "a", "b"])

    return run


def is_passage(raw: bytes, span: tuple[int, int], length: int = LENGTH) -> bool:
    return span[1] - span[0] >= length or len(raw[span[0] : span[1]].split()) > PASSAGE_WORDS


def _cut(length: int, passage: int):
    names = ["no", "spans", "passages", "kept_sha"]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [{"start": s, "end": e} for s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for no, text, found in zip(*(batch.column(c).to_pylist() for c in ("no", "text", "found")), strict=True):
                *_, own, shorter = anchors(np.frombuffer(text, "u1"), length, passage)
                of = lambda level: [(x["start"], x["end"]) for x in found or () if x["level"] == level]  # noqa: E731,B023
                spans = merge_spans(own + of(0))
                passages = [x for x in merge_spans(shorter + of(1) + spans) if is_passage(text, x, length)] if length > passage else spans
                rows.append((no, as_rows(spans), as_rows(passages), hashlib.sha256(without(text, spans)).digest()))
            yield _batch(names, [pa.int64(), spans_type, spans_type, pa.binary()], rows)

    return run


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


SPANS = "array<struct<start:bigint,end:bigint>>"


def _known(docs: DataFrame, length: int, passage: int, crowded: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """profile (written): rid, sha, n_bytes of every row; known: sha, copies, n_words, twin, spans, passages, kept_sha of the texts
    in which anything is repeated."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("rid"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    profile = materialise(texts.mapInArrow(_profile(length, passage), "rid bigint, sha binary, n_bytes bigint, n_words bigint, hashes array<bigint>, counts array<int>, looped boolean"), "profile")

    firsts = [F.first(c).alias(c) for c in ("n_bytes", "n_words", "hashes", "counts", "looped")]
    contents = materialise(profile.where(F.col("n_bytes") >= passage).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min_by("rid", F.coalesce("rid", F.lit(-(1 << 63)))).alias("rid"), *firsts).withColumn("no", F.monotonically_increasing_id()), "contents")
    places = contents.select("no", F.explode(F.arrays_zip("hashes", "counts")).alias("p")).select("no", F.col("p.hashes").alias("hash"), F.col("p.counts").alias("k"))
    shared = materialise(places.groupBy("hash").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("texts")).where("n > 1"), "shared")
    total = shared.agg(F.sum("texts")).first()[0] or 0
    met = join_hot(places, shared.select("hash", "texts", (F.col("n") > crowded).alias("many")), "hash", "texts", total, "inner")
    wanted = met.groupBy("no").agg(F.collect_list(F.struct("hash", "many")).alias("w"))
    chosen = contents.select("no", "sha", "rid", "looped").join(wanted, "no", "left").where("looped OR w IS NOT NULL")
    key = lambda: F.concat(F.col("sha"), F.coalesce(F.col("rid").cast("string"), F.lit("~")).cast("binary")).alias("key")
    chosen = chosen.select("no", key(), F.expr("transform(filter(w, x -> NOT x.many), x -> x.hash)").alias("wanted"), F.expr("transform(filter(w, x -> x.many), x -> x.hash)").alias("crowd"))
    keyed = texts.withColumn("sha", F.unhex(F.sha2("text", 256))).select("text", key())
    read = materialise(keyed.join(chosen, "key").dropDuplicates(["key"]).select("no", "text", "wanted", "crowd"), "candidates")

    pieces = read.select("no", "text", "wanted").mapInArrow(_pieces(length, passage), PIECE_SCHEMA)
    found = pieces.repartition(F.col("hash")).sortWithinPartitions("hash").mapInArrow(_construct(length, passage, block), HIT_SCHEMA)
    crowd = read.where(F.size("crowd") > 0)
    if crowd.limit(1).count():
        windows = crowd.select("no", "text", F.col("crowd").alias("wanted")).mapInArrow(_pieces(length, passage), PIECE_SCHEMA).mapInArrow(_windows(length, passage), "no bigint, level int, lo bigint, at bigint, a bigint, b bigint")
        windows = materialise(windows.select("no", "level", "lo", "at", F.struct("level", "a", "b").alias("window")), "windows")
        twice = materialise(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("again", F.lit(True)), "twice")
        again = join_hot(windows, twice, "window", "n", windows.count(), "inner")
        runs = again.groupBy("no", "level", "lo").agg(F.array_sort(F.collect_set("at")).alias("ats"))  # of one piece
        first = F.filter("ats", lambda x, i: (i == 0) | (F.get("ats", i - 1) != x - 1))
        last = F.filter("ats", lambda x, i: (i == F.size("ats") - 1) | (F.get("ats", i + 1) != x + 1))
        runs = runs.select("no", "level", F.explode(F.arrays_zip(first.alias("s"), last.alias("e"))).alias("r"))
        size = F.when(F.col("level") == 0, F.lit(length)).otherwise(F.lit(passage))
        found = found.unionByName(runs.select("no", "level", F.col("r.s").alias("start"), (F.col("r.e") + size).alias("end")))
    grouped = found.groupBy("no").agg(F.collect_list(F.struct("level", "start", "end")).alias("found"))
    cut = materialise(read.select("no", "text").join(grouped, "no", "left").mapInArrow(_cut(length, passage), f"no bigint, spans {SPANS}, passages {SPANS}, kept_sha binary"), "spans")

    none = F.lit(None)
    twins = contents.where("copies > 1").select("sha", "copies", "n_words", F.lit(True).alias("twin"), none.cast(SPANS).alias("spans"), none.cast(SPANS).alias("passages"), none.cast("binary").alias("kept_sha"))
    single = contents.where("copies = 1").select("no", "sha", "copies", "n_words").join(cut.where("size(spans) > 0 OR size(passages) > 0"), "no").select("sha", "copies", "n_words", F.lit(False).alias("twin"), "spans", "passages", "kept_sha")
    return profile.select("rid", "sha", "n_bytes"), twins.unionByName(single)


def _whole(n_bytes: Column) -> Column:
    return F.array(F.struct(F.lit(0).cast("bigint").alias("start"), n_bytes.alias("end")))


def _spans(length: int) -> tuple[Column, Column]:
    """spans and passages of a row with n_bytes and, where its text is known, n_words, twin, spans, passages."""
    nothing = F.array().cast(SPANS)
    spans = F.when(F.col("twin") & (F.col("n_bytes") >= length), _whole(F.col("n_bytes"))).otherwise(F.coalesce("spans", nothing))
    wordy = F.col("twin") & ((F.col("n_bytes") >= length) | (F.col("n_words") > PASSAGE_WORDS))
    return spans, F.when(wordy, _whole(F.col("n_bytes"))).otherwise(F.coalesce("passages", nothing))


def repeated_spans(docs: DataFrame, length: int = LENGTH, passage: int | None = None, crowded: int = CROWDED, block: int = BLOCK_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, sha (of the text's bytes), spans (the maximal repeated runs, in bytes), kept_sha (of the rest), and
    passages (the runs of repeated strings of passage bytes that have over PASSAGE_WORDS words or length bytes)."""
    profile, known = _known(docs, length, passage or length, crowded, block, id_col, text_col)
    joined = join_hot(profile, materialise(known, "known"), "sha", "copies", profile.count())
    spans, passages = _spans(length)
    return joined.select(
        F.col("rid").alias("doc_id"),
        "n_bytes",
        "sha",
        spans.alias("spans"),
        passages.alias("passages"),
        F.when(F.col("twin") & (F.col("n_bytes") >= length), F.unhex(F.sha2(F.lit(b""), 256))).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE_BYTES, crowded: int = CROWDED, block: int = BLOCK_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the passages cut out of the text (bytes that no longer form a character go too), and
    __found: struct(n_bytes, spans, passages, kept_sha), or null where nothing of the text is repeated."""
    known = settle(lambda: _known(docs, length, passage, crowded, block, id_col, text_col)[1], "known")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    apart, back = renamed(docs.columns)
    keyed = docs.select(*apart, F.unhex(F.sha2(raw, 256)).alias("sha"), F.octet_length(raw).cast("bigint").alias("n_bytes"))
    total = docs.count()
    joined = join_hot(keyed, known, "sha", "copies", total)
    spans, passages = _spans(length)
    joined = joined.withColumn("kept_sha", F.when(F.col("twin") & (F.col("n_bytes") >= length), F.unhex(F.sha2(F.lit(b""), 256))).otherwise(F.coalesce("kept_sha", "sha")))
    ready = joined.select(*back, F.when(F.col("twin").isNotNull(), F.struct("n_bytes", spans.alias("spans"), passages.alias("passages"), "kept_sha")).alias("__found"))
    place, names, schema = docs.columns.index(text_col), [*docs.columns, "__found"], ready.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, found = batch.column(place), batch.column(len(names) - 1)
            if found.null_count < batch.num_rows:
                cut = [t if f is None or not f["passages"] else without(t.encode("utf-8", "surrogatepass"), [(x["start"], x["end"]) for x in f["passages"]]).decode("utf-8", "ignore") for t, f in zip(texts.to_pylist(), found.to_pylist(), strict=True)]
                texts = pa.array(cut, texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == place else batch.column(i) for i in range(len(names))], names=names)

    return ready.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE_BYTES, **options) -> DataFrame:
    """docs with the repeated passages cut out of the text."""
    cut = without_repeats(docs, length, passage, **options)
    return cut.drop("__found")
