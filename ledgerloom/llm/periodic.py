"""Periodic runs of words: stretches that repeat one block of words three times and more.

A run is a stretch with smallest period q of at least max(MIN_LENGTH, REPEATS * q) words that no neighbouring word extends.
It is found by block matching. For each scale b (8, 16, 32, ...) the document is cut into aligned blocks of b words; they
go into an Aho-Corasick automaton whose keys are sequences of word numbers, which is searched across the document. A block
that occurs again at a distance of the scale (under 16 for b = 8, else from b to 2b - 1) seeds an exact extension to both
sides. A run of period q holds at least 2b - 1 words that recur q words later, at the largest b <= max(q, 8), and so a
whole aligned block: no run is missed. Blocks with a word that doesn't recur within the distance can't match and are not
searched; neither are stretches away from blocks. A stretch whose smallest period divides the distance is the run of that period.

Each document is worked on alone, in Arrow batches: nothing is shuffled, and a task that is lost is run again by itself.
Memory follows the longest text: its word numbers and its vocabulary, not its words as objects.

Null, empty and blank texts: no words, no run. Very long texts are taken whole. Null ids: kept, never edited by repeat_tail.
Repeated rows: a result each. Empty table: no rows. All columns of the input are kept under their names; the results
are in one struct column, whose name gets underscores where it is taken.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm.common import free_name, renamed, slices

MIN_LENGTH = 24
REPEATS = 3
#: The least scale; it serves all distances under 16.
LEAST_BLOCK = 8
#: Bytes of text that are split into words at a time.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
RUN = "struct<start: bigint, length: bigint, period: bigint>"
_ARROW = pa.struct([("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])


def numbered_words(raw: bytes, piece: int = PIECE) -> tuple[np.ndarray, list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ as numbers, and the vocabulary in the order of these; split() cuts at exactly those bytes."""
    seen: dict[bytes, int] = {}
    numbers, at = array("i"), 0
    while at < len(raw):
        cut = _GAP.search(raw, at + piece)
        end = cut.start() if cut else len(raw)
        numbers.extend([seen.setdefault(w, len(seen)) for w in raw[at:end].split()])
        at = end
    return np.frombuffer(numbers, "i4") if numbers else np.zeros(0, "i4"), list(seen)


def repeat_tail(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """Every tenth document by hash, from a word on, as repeats of one block: planted runs of known places."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return words[np.where(i < a, i, a + (i - a) % p)]


def _next_gap(words: np.ndarray) -> np.ndarray:
    """Words from each one to the next that is equal; longer than the text where there is none."""
    gaps = np.full(len(words), len(words) + 1)
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    gaps[order[:-1][same]] = np.diff(order)[same]
    return gaps


def _reach(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and from j on (to the right or, with step -1, to the left) are pairwise equal; i < j."""
    most, done, size = (len(words) - j if step > 0 else i + 1), 0, 32
    while done < most:
        n = min(size, most - done)
        if step > 0:
            differ = words[i + done : i + done + n] != words[j + done : j + done + n]
        else:
            differ = (words[i - done - n + 1 : i - done + 1] != words[j - done - n + 1 : j - done + 1])[::-1]
        if (k := int(differ.argmax())) or differ[0]:
            return done + k
        done += n
        size *= 2
    return done


def _occurrences(words: np.ndarray, blocks: np.ndarray, b: int) -> Iterator[tuple[int, int]]:
    """(block's place, place of an equal stretch after it within 2b - 1 words), by an automaton over word numbers."""
    find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for x in blocks.tolist():
        key = tuple(words[x : x + b].tolist())
        if key in find:
            find.get(key).append(x)
        else:
            find.add_word(key, [x])
    find.make_automaton()
    starts = blocks[np.r_[True, np.diff(blocks) > 3 * b]]  # of stretches that blocks and their distances cover
    ends = np.r_[blocks[np.flatnonzero(np.diff(blocks) > 3 * b)], blocks[-1:]] + 3 * b
    for lo, hi in zip(starts.tolist(), np.minimum(ends, len(words)).tolist(), strict=True):
        for last, places in find.iter(tuple(words[lo:hi].tolist())):
            y = lo + last - b + 1
            k = bisect_left(places, y) - 1
            while k >= 0 and places[k] > y - 2 * b:
                yield places[k], y
                k -= 1


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    min_length and repeats may be raised from 24 and 3; for less the blocks would be too long.
    """
    if min_length < MIN_LENGTH or repeats < REPEATS:
        raise ValueError(f"runs of under {MIN_LENGTH} words or {REPEATS} periods aren't sought")
    n, b = len(words), LEAST_BLOCK
    if n < min_length:
        return []
    gaps = _next_gap(words)
    stretches: dict[tuple[int, int], int] = {}
    inside = np.zeros(n, "i8")  # the end of a run that covers a word; its period is at most the scale's
    while b * (1 if b == LEAST_BLOCK else repeats) <= n:
        x = np.arange(0, n - b + 1, b)
        near = np.maximum.reduceat(gaps[: len(x) * b], x) < 2 * b
        x = x[near & (inside[x] < np.minimum(x + 3 * b, n))]
        found: dict[int, int] = {}  # by distance, how far its last stretch goes
        fresh: list[tuple[int, int]] = []
        for i, j in _occurrences(words, x, b) if len(x) else ():
            q = j - i
            if (q < b and b > LEAST_BLOCK) or found.get(q, -1) > i:
                continue
            start, end = i - _reach(words, i - 1, j - 1, -1) if i else 0, i + _reach(words, i, j, 1)
            found[q] = end
            if end - start + q >= max(min_length, repeats * q):
                at = (start, end + q)
                stretches[at] = min(stretches.get(at, q), q)
                fresh.append(at)
        for start, end in fresh:
            inside[start:end] = np.maximum(inside[start:end], end)
        b *= 2
    return sorted((s, e - s, q) for (s, e), q in stretches.items())


def collapsed(words: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those go that a run contains after its first period."""
    edges = np.zeros(len(words) + 1, "i8")
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def _worked(text: str | None, doc_id: int | None, edit: bool) -> dict:
    words, vocabulary = numbered_words((text or "").encode("utf-8", "surrogatepass"))
    words = repeat_tail(words, doc_id) if edit else words
    runs = find_runs(words)
    kept = b" ".join([vocabulary[w] for w in words[collapsed(words, runs)].tolist()])
    return {"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": kept.decode("utf-8", "surrogatepass")}


def periodic_runs(docs: DataFrame, edit: bool = False, id_col: str = "doc_id", text_col: str = "text", name: str = "periodic") -> DataFrame:
    """docs, all columns, and a struct: runs (array of start, length, period, in words) and the text with each run cut to one period.

    edit: look into the texts as repeat_tail() makes them.
    """
    apart, back = renamed(docs.columns)
    plain = docs.select(*apart)
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [_worked(t, i, edit) for t, i in zip(batch.column(text_at).to_pylist(), batch.column(id_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], [*batch.schema.names, "made"])

    made = StructType([*plain.schema.fields, *StructType.fromDDL(f"made struct<runs: array<{RUN}>, collapsed: string>").fields])
    return plain.mapInArrow(run, made).select(*back, F.col("made").alias(free_name(docs.columns, name)))


def digests(docs: DataFrame, edit: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, n_runs, the run of most repeats (start, length, period, exponent_milli), digests of the runs and of the collapsed text.

    Most repeats: the greatest length / period, compared exactly; ties go to the least start, then the least period.
    """
    found = periodic_runs(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), edit)
    runs = F.col("periodic.runs")
    best = F.reduce(runs, F.lit(None).cast(RUN), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("periodic.collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.*", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
