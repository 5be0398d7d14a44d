"""Text quality: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

Every text becomes a row of numbers (shares of character classes, words, repeats, lines). Each number is binned at
quantiles; boosting goes round the features in turn and fits a tree of three leaves to the present residuals of each,
so that all trees of a feature add up to one lookup table. The strongest pairs of features then get two-way tables in the
same manner. A score is the logistic of a sum of table entries: numpy looks bins up and adds, a batch at a time.

The tables are learned on the driver from at most MAX_LABELLED rows (those of least hash of doc_id), a documented bound;
every document is scored. doc_id, lang, source and the labels are never inputs of a score.

Null or empty text: scored as an empty text. Null doc_id: scored; never learned from. Several labels of one document:
their mean, rounded down at a tie. No usable labels: one constant score. Repeated rows: the same score. Empty table: no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices

#: Bound of the rows that the tables are learned from.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
FOLDS = 5

FEATURES = ("log_bytes", "upper", "digits", "blanks", "line_ends", "stops", "shouts", "symbols", "bars", "beyond_ascii", "entropy", "word_length", "capitalised", "distinct_words", "doubled", "top_word", "distinct_pairs", "distinct_lines", "short_lines", "sentence_length")

_CLASSES = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digits": b"0123456789", "blanks": b" \t\n\r", "line_ends": b"\n", "stops": b".,;:", "shouts": b"!?", "symbols": b"#$%&*@^~<>\\/_=+{}[]", "bars": b"|", "beyond_ascii": bytes(range(128, 256))}
_MEMBER = np.array([[b in chars for b in range(256)] for chars in _CLASSES.values()], "f8").T


def features(raw: bytes | None) -> list[float]:
    """One row of FEATURES for a text's UTF-8 bytes."""
    raw = raw or b""
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    share = dict(zip(_CLASSES, (counts @ _MEMBER) / n, strict=True))
    seen = counts[counts > 0] / n
    letters = max(1e-9, share["upper"] + share["lower"] + share["beyond_ascii"])
    words = raw.split()
    m = max(1, len(words))
    tally = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(len(raw))),
        share["upper"] / letters,
        share["digits"],
        share["blanks"],
        share["line_ends"],
        share["stops"],
        share["shouts"],
        share["symbols"],
        share["bars"],
        share["beyond_ascii"],
        float(-(seen * np.log2(seen)).sum()),
        len(raw) / m,
        sum(65 <= w[0] <= 90 for w in words) / m,
        len(tally) / m,
        sum(map(eq, words, words[1:])) / m,
        max(tally.values(), default=0) / m,
        len(set(zip(words, words[1:], strict=False))) / m,
        len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 40 for x in lines) / max(1, len(lines)),
        m / max(1, raw.count(b".")),
    ]


def feature_rows(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], "f8").reshape(len(texts), len(FEATURES))


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for a, b, _ in self.pairs for j in (a, b)}
        for a, b, table in self.pairs:
            z += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best place to cut a run of bins, and its gain."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _three_leaves(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps of a tree with up to three leaves over one feature's bins."""
    parts = [(0, len(g))]
    for _ in range(2):
        gain, k, at = max(((*_cut(g[s:e], h[s:e], ridge), i) for i, (s, e) in enumerate(parts)), key=lambda t: t[0])[0:3]
        if gain <= 1e-9:
            break
        s, e = parts.pop(at)
        parts += [(s, s + k), (s + k, e)]
    out = np.zeros(len(g))
    for s, e in parts:
        out[s:e] = g[s:e].sum() / (h[s:e].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree of one cut in each of two features: four leaves; its gain and Newton steps."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gt, ht = gc[-1, -1], hc[-1, -1]
    g00, h00 = gc[:-1, :-1], hc[:-1, :-1]
    g01, h01 = gc[:-1, -1:] - g00, hc[:-1, -1:] - h00
    g10, h10 = gc[-1:, :-1] - g00, hc[-1:, :-1] - h00
    g11, h11 = gt - g00 - g01 - g10, ht - h00 - h01 - h10
    gain = g00**2 / (h00 + ridge) + g01**2 / (h01 + ridge) + g10**2 / (h10 + ridge) + g11**2 / (h11 + ridge) - gt**2 / (ht + ridge)
    out = np.zeros_like(g)
    if not gain.size:
        return 0.0, out
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    for part, (a, b) in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), ((g00, h00), (g01, h01), (g10, h10), (g11, h11)), strict=True):
        out[part] = a[i, j] / (b[i, j] + ridge)
    return float(gain[i, j]), out


def _edges(x: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles of either class, so that a rare class gets as fine bins as a common one."""
    return np.unique([np.quantile(x[y == c], np.linspace(0, 1, bins // 2 + 1)) for c in (0, 1)])


def learn(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, pairs: int = 8, bins: int = 64, coarse: int = 12, rate: float = 0.08, ridge: float = 2.0) -> AdditiveModel:
    """Boost lookup tables for the features, then for the strongest pairs."""
    n = len(y)
    prior = (y.sum() + 1) / (n + 2)
    model = AdditiveModel(float(np.log(prior / (1 - prior))))
    if n == 0 or y.min() == y.max():
        return model
    model.edges = [_edges(x[:, j], y, bins) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(n, model.intercept)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(rounds):
        for j, b in enumerate(at):
            g, h = slope()
            size = len(model.tables[j])
            step = rate * _three_leaves(np.bincount(b, g, size), np.bincount(b, h, size), ridge)
            model.tables[j] += step
            z += step[b]
    model.pair_edges = [_edges(x[:, j], y, coarse) for j in range(x.shape[1])]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slope()
        cell, size = wide[a] * shape[b] + wide[b], shape[a] * shape[b]
        return np.bincount(cell, g, size).reshape(shape[a], shape[b]), np.bincount(cell, h, size).reshape(shape[a], shape[b])

    strength = sorted(((_quadrants(*grids(a, b), ridge)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), key=lambda t: (-t[0], t[1:]))
    chosen = [(a, b, np.zeros((shape[a], shape[b]))) for gain, a, b in strength[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, table in chosen:
            step = rate * _quadrants(*grids(a, b), ridge)[1]
            table += step
            z += step[wide[a], wide[b]]
    model.pairs = chosen
    return model


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from: CRC-32 of the id's decimal text, modulo FOLDS, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the learning rows, collected: at most `most` of them."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = feature_rows(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y int, x array<double>")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most)  # a doc_id may have many rows
    got = sorted((r["doc_id"], r["y"], tuple(r["x"])) for r in rows.collect())
    return np.array([g[2] for g in got], "f8").reshape(len(got), len(FEATURES)), np.array([g[1] for g in got], "f8")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> AdditiveModel:
    return learn(*labelled_sample(docs, labels, most))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(feature_rows(batch.column(1).to_pylist())))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs, fit(docs, labels, most))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold."""
    model = fit(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(model.score(feature_rows(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
