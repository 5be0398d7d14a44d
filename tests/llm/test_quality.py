import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality
from ledgerloom.llm.queries import op6_quality_gam


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op6_quality_gam(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good = [p for y, p in unseen if y == 1]
    bad = [p for y, p in unseen if y == 0]
    assert np.mean(good) > 0.95 and (not bad or np.mean(bad) < 0.5)


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype("f8")  # no feature alone tells anything
    model = quality.learn(x, y)
    fresh = rng.random((1000, x.shape[1]))
    assert (3, 7) in {(a, b) for a, b, _ in model.pairs}
    assert np.mean((model.score(fresh) > 0.5) == ((fresh[:, 3] > 0.5) ^ (fresh[:, 7] > 0.5))) > 0.95


@pytest.mark.parametrize("y", [np.zeros(0), np.ones(5)])
def test_one_class_gives_a_constant(y):
    model = quality.learn(np.zeros((len(y), len(quality.FEATURES))), y)
    assert len(set(model.score(np.random.default_rng(1).random((4, len(quality.FEATURES)))))) == 1


def test_tricky_rows(spark, tricky, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 0), (8, 0, 1), (10, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(tricky, labels).collect()
    assert len(rows) == tricky.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(nothing, labels).count() == 0
    assert quality.classify(tricky, labels.limit(0)).count() == tricky.count()
    kept = quality.keep_good(tricky, labels)
    assert kept.columns == tricky.columns


def test_query_against_brute_force(spark, small):
    """Scores again from the fitted tables, row by row in plain Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    place = lambda edges, v: sum(e <= v for e in edges.tolist())
    got = {r.doc_id: r.score for r in op6_quality_gam(spark, small).collect()}
    for r in docs.collect():
        x = quality.features((r.text or "").encode())
        z = model.intercept + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
        z += sum(t[place(model.pair_edges[a], x[a]), place(model.pair_edges[b], x[b])] for a, b, t in model.pairs)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.range(200).selectExpr("id % 2 + 1 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    x, y = quality.labelled_sample(docs, labels, 50)
    assert len(x) == len(y) <= 50


def test_features_are_finite():
    for raw in (None, b"", b"   ", b"a", b"\n\n", "é".encode() * 10):
        assert np.isfinite(quality.features(raw)).all()
