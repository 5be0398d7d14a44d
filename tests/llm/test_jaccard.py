import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import jaccard


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_groups(ids, texts):
    """Sets of ids that pairs of a Jaccard index of 0.8 join, by comparing all."""
    sets, root = brute_sets(texts), list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), set()).add(x)
    return sorted(map(sorted, groups.values()))


def found_groups(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.root, set()).add(r.doc_id)
    return sorted(map(sorted, groups.values()))


def edited(words, rng, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("common, crowded, many", [(100, 200, 5000), (3, 4, 0), (0, 1, 0)])
def test_links_against_all_pairs(spark, common, crowded, many, monkeypatch):
    monkeypatch.setattr(jaccard, "MANY_PAIRS", many)
    rng = random.Random(3)
    line = [f"line{i}" for i in range(60)]
    texts = []
    for _ in range(6):  # near copies, from sure to just under the limit, some with a passage that all hold
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((4, 9, 80, 300)))]
        texts += [" ".join(edited(base, rng, rng.choice((0, 0.005, 0.02, 0.025, 0.03))) + line * rng.choice((0, 1))) for _ in range(15)]
    texts += [" ".join(line), " ".join(line[:-1]), "", None, "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_groups(range(len(texts)), texts)
    assert 10 < len(want) < len(texts) - 10
    assert found_groups(jaccard.near_copies(docs, common=common, crowded=crowded)) == want


def test_rows_of_the_join_follow_the_documents(spark, monkeypatch):
    """Documents of 14 words of their own and one passage that all hold (similarity 0.77): none meets another."""
    met = []
    possible = jaccard._possible
    monkeypatch.setattr(jaccard, "_possible", lambda rows, similar: (met.append(rows.count()), possible(rows, similar))[1])
    passage = " ".join(f"p{i}" for i in range(100))
    for n in (150, 300):
        docs = spark.range(n).select("id", F.concat(F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(14)]), F.lit(" " + passage)).alias("text")).withColumnRenamed("id", "doc_id")
        assert jaccard.keep_one(docs).count() == n
    assert met == [0, 0]


def test_stage_finds_the_near_copies_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute_groups([r.doc_id for r in rows], [r.text for r in rows])
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect())
    assert kept == sorted(g[0] for g in want) and 56 not in kept


def test_rows_that_share_an_id(spark, tricky, nothing):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b), (None, b), (None, "alone"), (None, "alone"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(jaccard.keep_one(docs).collect(), key=str) == sorted([(1, a), (2, b), (None, "alone"), (4, None)], key=str)
    kept = jaccard.keep_one(tricky)
    assert kept.columns == tricky.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9, 10]
    assert jaccard.keep_one(nothing).count() == 0
