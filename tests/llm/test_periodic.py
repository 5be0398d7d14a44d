import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from ledgerloom.llm import periodic
from ledgerloom.llm.queries import op12_periodic_runs


def brute_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_runs(words, least=24, repeats=3):
    """Every stretch in which words q apart are equal, for every q; of one stretch's periods the smallest."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, repeats * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = brute_words(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, milli, sha256(told.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_runs_of_random_words():
    rng = random.Random(4)
    seen = 0
    for _ in range(1500):
        words, kinds = [], rng.choice((1, 2, 3, 5, 50))
        while len(words) < rng.choice((10, 30, 60, 150, 400)):
            block = [rng.randrange(kinds) for _ in range(rng.randint(1, 40))]
            words += (block * rng.randint(1, 9))[: rng.randint(1, 200)] if rng.random() < 0.4 else block
        want = brute_runs(words)
        seen += len(want)
        assert periodic.find_runs(np.array(words, "i4")) == want
    assert seen > 500


def test_lengths_and_repeats_at_the_limits():
    for q in (1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100):
        least = max(24, 3 * q)
        for length in (least - 1, least, least + 1, 7 * q + 5):
            for before in (0, 1, 13):
                words = [*range(1000, 1000 + before), *(i % q for i in range(length)), 5000, 5001]
                assert periodic.find_runs(np.array(words, "i4")) == brute_runs(words), (q, length, before)


def test_more_asked_for_and_less():
    words = np.array([i % 4 for i in range(40)], "i4")
    assert periodic.find_runs(words, min_length=40, repeats=10) == [(0, 40, 4)]
    assert periodic.find_runs(words, min_length=41) == periodic.find_runs(words, repeats=11) == []
    with pytest.raises(ValueError):
        periodic.find_runs(words, repeats=2)


def test_one_word_and_two_words_are_quick():
    assert periodic.find_runs(np.zeros(300_000, "i4")) == [(0, 300_000, 1)]
    assert periodic.find_runs(np.arange(300_000, dtype="i4") % 2) == [(0, 300_000, 2)]


def test_words_in_pieces():
    raw = "été a\tb\x0bc  d\x1fe f\r\n".encode() * 50
    numbers, vocabulary = periodic.numbered_words(raw, piece=7)
    assert [vocabulary[i] for i in numbers] == [w.encode() for w in brute_words(raw.decode())]


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = op12_periodic_runs(spark, small)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert in_order(got.collect()) == in_order(brute_row(*d) for d in docs)


def test_tricky_rows(tricky, nothing):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    assert in_order(periodic.digests(tricky).collect()) == in_order(brute_row(*r) for r in rows)
    assert periodic.digests(nothing).collect() == []
    found = periodic.periodic_runs(tricky.withColumnRenamed("score", "periodic"))
    assert found.columns[-1] == "periodic_" and len(found.columns) == len(tricky.columns) + 1
    of = {r.doc_id: r.periodic_ for r in found.collect()}
    assert [tuple(r) for r in of[8].runs] == [(0, 500, 1)] and of[8].collapsed == "as"
    assert [tuple(r) for r in of[10].runs] == [(0, 8000, 997)]
