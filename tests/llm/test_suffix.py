import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import suffix
from ledgerloom.llm.queries import op8_suffix_dedup


def brute_spans(texts, length):
    """Maximal runs of bytes that a window covers which starts at two places or more."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        edge = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(covered[:-1]) > 0).astype(int), 0]))
        out.append([tuple(x) for x in edge.reshape(-1, 2).tolist()])
    return out


def texts(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcd") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    made = []
    for _ in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        made.append("".join(parts))
    unit = "xy "
    return [*made, unit * 60, unit * 25 + "tail", "ab" * 14 + "!" + "ab" * 15, "é" * 40, made[0], made[1], "", None]


@pytest.mark.parametrize(("seed", "crowded", "block"), [(1, 20_000, 20_000), (2, 20_000, 3), (3, 2, 20_000)])
def test_against_brute_force(spark, seed, crowded, block):
    docs = texts(seed)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in suffix.repeated_spans(df, 25, crowded=crowded, block=block).collect()}
    raw = [(t or "").encode() for t in docs]
    for i, want in enumerate(brute_spans(raw, 25)):
        assert [(s.start, s.end) for s in rows[i].spans] == want, i
        assert bytes(rows[i].kept_sha) == hashlib.sha256(suffix.without(raw[i], want)).digest()
        assert rows[i].n_bytes == len(raw[i])


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    raw, want = [t for _, t in docs], {}
    for (i, t), spans, short in zip(docs, brute_spans(raw, 400), brute_spans(raw, suffix.PASSAGE_BYTES), strict=True):
        left = suffix.without(t, [s for s in short if suffix.is_passage(t, s)]).decode("utf-8", "ignore")
        want[i] = (len(t), sum(e - s for s, e in spans), len(spans), hashlib.sha256(suffix.without(t, spans)).hexdigest(), left)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text or "") for r in op8_suffix_dedup(spark, small).collect()}
    assert got == want


@pytest.mark.parametrize(("seed", "crowded"), [(4, 20_000), (5, 2)])
def test_shorter_passages_against_brute_force(spark, seed, crowded, monkeypatch):
    monkeypatch.setattr(suffix, "PASSAGE_WORDS", 3)
    docs = texts(seed)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in suffix.repeated_spans(df, 40, 20, crowded=crowded).collect()}
    cut = {r.doc_id: r.text for r in suffix.remove_repeats(df, 40, 20, crowded=crowded).collect()}
    raw = [(t or "").encode() for t in docs]
    for i, (long, short) in enumerate(zip(brute_spans(raw, 40), brute_spans(raw, 20), strict=True)):
        assert [(s.start, s.end) for s in rows[i].spans] == long, i
        want = [(s, e) for s, e in short if e - s >= 40 or len(raw[i][s:e].split()) > 3]
        assert [(s.start, s.end) for s in rows[i].passages] == want, i
        assert (cut[i] or "").encode() == suffix.without(raw[i], want).decode("utf-8", "ignore").encode()


def test_many_places_of_one_passage_in_one_text(spark):
    """The places of an anchor are counted, not the documents that hold it: these are never gathered in one block."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(40))
    text = "".join(passage + "".join(rng.choice("ijklmnop") for _ in range(25)) for _ in range(3000))
    df = spark.createDataFrame([(1, text), (2, "plain words only")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in suffix.repeated_spans(df, 30, crowded=100).collect()}
    assert [(s.start, s.end) for s in rows[1].spans] == brute_spans([text.encode()], 30)[0]
    assert len(rows[1].spans) == 3000 and rows[2].spans == []


def test_columns_one_symbol_a_round():
    pieces = [b"abcabcabc", b"zbcabcabz", b"abcabcabd", b"qqqqqqqqq"]
    hits = suffix.repeated_windows(np.array([list(p) for p in pieces], "u1").T.copy(), (5,), 5)[0]
    want = [[any(p[d : d + 5] == q[d : d + 5] for j, q in enumerate(pieces) if j != i) for d in range(5)] for i, p in enumerate(pieces)]
    assert hits.tolist() == want


def test_long_texts_take_several_steps(monkeypatch):
    rng = np.random.default_rng(0)
    b = rng.integers(97, 101, 5000, dtype="u1")
    whole = suffix.anchors(b, 50)
    monkeypatch.setattr(suffix, "STEP", 700)
    parts = suffix.anchors(b, 50)
    windows = lambda a: sorted((int(p), int(x)) for p, lo, hi in zip(a[1], a[2], a[3], strict=True) for x in range(lo, hi + 1))
    assert windows(parts) == windows(whole)


def test_tricky_rows(tricky, nothing):
    rows = suffix.repeated_spans(tricky, 30).collect()
    assert len(rows) == tricky.count()
    by = {r.doc_id: r for r in rows}
    assert [(s.start, s.end) for s in by[1].spans] == [(0, by[1].n_bytes)] and by[3].n_bytes == 0 and not by[10].spans[1:]
    assert suffix.repeated_spans(nothing).count() == 0
    cut = suffix.remove_repeats(tricky, 30)
    assert cut.columns == tricky.columns and cut.count() == tricky.count()
    assert {r.doc_id: r.text for r in cut.collect()}[6] == "word"
