import random
import re
from hashlib import sha256

import numpy as np
import pytest

from ledgerloom.llm import winnowing
from ledgerloom.llm.queries import op11_winnowing_decontamination

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_split(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    """(doc_id, words, hit words, items, spans of hit words)."""
    windows = {}
    for item, text in items:
        words = brute_split(text)
        k = min(10, len(words))
        for j in range(len(words) - k + 1) if k else ():
            windows.setdefault(tuple(words[j : j + k]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, found = brute_split(text), set(), set()
        for k in {len(w) for w in windows}:
            for j in range(len(words) - k + 1):
                if (w := tuple(words[j : j + k])) in windows:
                    hit |= set(range(j, j + k))
                    found |= windows[w]
        out.append((doc, len(words), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def rows(found):
    out = found.collect()
    assert all(r.leak.n_hit == sum(s.end - s.start for s in r.leak.spans) for r in out)
    return sorted(((r.doc_id, r.leak.n_words, r.leak.n_hit, r.leak["items"]) for r in out), key=repr)


@pytest.mark.parametrize("shortest", [10, 7, 5, 3, 1])
def test_random_texts_against_brute_force(spark, shortest):
    rng = random.Random(shortest)
    words = [f"w{i}" for i in range(12)] + ["É", "東京"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(shortest, 25)))) for i in range(8)]
    items += [(None, "w1 w2 " * 8), (99, None), (98, ".."), (97, ""), (3, "w3 " * 12)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            cut = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(cut))
            parts.append("-".join(cut[a : a + rng.randint(1, 20)]).upper() if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))))
        docs.append((i, " . ".join(parts)))
    docs += [(None, items[0][1]), (5, None), (5, ""), (6, items[1][1]), (6, items[1][1])]
    found = winnowing.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    want = brute(docs, items)
    assert rows(found) == want and any(w[2] for w in want)


def test_every_shared_span_of_ten_words_has_a_common_hash():
    rng = random.Random(1)
    for _ in range(300):
        span = [f"{rng.randrange(6)}" for _ in range(10)]
        texts = [" ".join([*(f"{rng.randrange(6)}" for _ in range(rng.randrange(20))), *span, *(f"{rng.randrange(6)}" for _ in range(rng.randrange(20)))]).encode() for _ in range(2)]
        a, b = (set(h.tolist()) for _, _, h in winnowing.winnowed(texts, winnowing.plan([10])))
        one = {h for _, _, x in winnowing.winnowed([" ".join(span).encode()], winnowing.plan([10])) for h in x.tolist()}
        assert len(one) == 1 and one <= a & b


def test_texts_of_one_block_keep_apart():
    texts = [b"a b c d e", b"", b"f g h i j k l m n", b"x" * 3_000_000, b"a b c d e"]
    alone = [next(winnowing.winnowed([t], [(5, 1), (2, 1)])) for t in texts]
    for (_, n, h), (_, m, x) in zip(winnowing.winnowed(texts, [(5, 1), (2, 1)]), alone, strict=True):
        assert n == m and np.array_equal(np.sort(h), np.sort(x))


def test_a_full_bitmap_changes_nothing(spark, small, monkeypatch):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = rows(winnowing.contamination(docs, items))
    monkeypatch.setattr(winnowing, "_bitmap", lambda hashes: np.full(winnowing.BITS // 8, 255, "u1"))
    assert rows(winnowing.contamination(docs, items)) == want


def test_query_against_brute_force(spark, small):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(f"{i}_id", "text").collect()] for t, i in (("documents", "doc"), ("benchmark", "item")))
    want = [(d, n, hit, len(found), sha256(",".join(found).encode()).hexdigest(), hit > 0) for d, n, hit, found in brute(docs, items)]
    got = op11_winnowing_decontamination(spark, small)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr) and any(w[5] for w in want)


def test_tricky_rows(spark, tricky, nothing):
    items = spark.createDataFrame([(1, "the QUICK brown fox: jumps over the lazy dog again and again"), (2, "word"), (3, "as as"), (3, "naïve café")], "item_id bigint, text string")
    docs, bench = [(r.doc_id, r.text) for r in tricky.collect()], [tuple(r) for r in items.collect()]
    found = winnowing.contamination(tricky.withColumnRenamed("score", "leak"), items)
    assert found.columns[-1] == "leak_"
    assert rows(winnowing.contamination(tricky, items)) == brute(docs, bench)
    assert winnowing.contamination(nothing, items).collect() == []
    assert {r.leak.n_hit for r in winnowing.contamination(tricky, items.limit(0)).collect()} == {0}
    clean = winnowing.keep_clean(tricky, items)
    assert clean.columns == tricky.columns and clean.count() == sum(1 for w in brute(docs, bench) if not w[2])
