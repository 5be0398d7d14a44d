import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.queries import op7_simhash_near_dedup


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=3):
    """Least id that links reach, by union-find over all pairs."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if a < b and (x ^ y).bit_count() <= distance:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i, _ in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("dense", [2000, 1])
def test_links_and_components(spark, dense):
    rng = random.Random(5)
    prints = []
    for c in range(12):
        at = rng.getrandbits(64)
        for _ in range(12):
            prints.append((len(prints), at))
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 4))):
                at ^= 1 << b
            if rng.random() < 0.3:
                at = prints[-1][1]
    prints += [(len(prints), 0), (len(prints) + 1, 7), (len(prints) + 2, 15)]
    df = spark.createDataFrame([(i, signed(x)) for i, x in prints], "doc_id bigint, fp bigint")
    nodes = df.select("fp").distinct()
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, dense=dense)).collect()}
    want = brute_components(prints)
    groups = {}
    for i, x in prints:
        groups.setdefault(roots.get(signed(x), signed(x)), set()).add(i)
    expected = {}
    for i, r in want.items():
        expected.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("few", (0, 50, 1000))
def test_long_chain(spark, few):
    edges = spark.range(1, 200).selectExpr("id - 1 AS src", "id AS dst")
    roots = simhash.components(edges, few)
    assert roots.count() == 200 and roots.select("root").distinct().count() == 1


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute_components(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash_near_dedup(spark, small).collect()}
    assert got == {i: (f"{x:016x}", want[i]) for i, x in docs}


def test_tricky_rows(tricky, nothing):
    rows = simhash.near_duplicates(tricky).collect()
    assert len(rows) == tricky.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by[1] == by[2] and {x[1] for x in by[3] | by[4] | by[5]} == {3} and {x[0] for x in by[3]} == {0}
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one(tricky):
    kept = simhash.keep_one(tricky)
    assert kept.columns == tricky.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 6, 7, 8, 9, 10]
    assert kept.where(F.col("doc_id").isNull()).count() == 1


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (None, b), (None, "alone"), (None, "alone")], "doc_id bigint, text string")
    assert sorted(simhash.keep_one(docs).collect(), key=str) == sorted([(1, a), (2, b), (None, "alone")], key=str)


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(simhash._hub_sizes, "__defaults__", (1,))
    edges = spark.range(1, 3000).selectExpr("0L AS src", "id AS dst").unionAll(spark.range(5000, 5003).selectExpr("id AS src", "id + 1 AS dst"))
    roots = simhash.components(edges, few=0)
    assert roots.count() == 3004 and roots.select("root").distinct().count() == 2


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i}" for i in range(3000))
    assert simhash.fingerprint(text, block=100) == brute_fingerprint(text) == simhash.fingerprint(text)
    assert isinstance(np.uint64(simhash.fingerprint(text)), np.uint64)
