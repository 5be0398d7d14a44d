import hashlib
import math
from collections import Counter

from ledgerloom.llm import mixing


def brute_copies(doc_id, text, rate):
    key = f"{mixing.SEED}:{'~' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"
    u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13
    p = total = math.exp(-rate)
    n = 0
    while u >= total and n < mixing.TAIL:
        n += 1
        p *= rate / n
        total += p
    return n


def test_draws_invert_the_distribution(tricky):
    rates = mixing.source_rates(tricky)
    by = {r.source: r.rate for r in rates.collect()}
    want = Counter()
    for r in tricky.collect():
        want[(r.doc_id, r.text)] += brute_copies(r.doc_id, r.text, by[r.source])
    got = Counter((r.doc_id, r.text) for r in mixing.mix(tricky).collect())
    assert got == +want


def test_shares_come_out(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "repeat('a', 100) AS text", "if(id % 10 < 7, 'big', if(id % 10 < 9, 'mid', 'low')) AS source", "1L AS n_chars")
    mixed = mixing.mix(docs, {"big": 1, "mid": 1, "low": 2})
    n = Counter(r.source for r in mixed.select("source").collect())
    total = sum(n.values())
    assert abs(total / 20000 - 1) < 0.03 and abs(n["big"] / total - 0.25) < 0.02 and abs(n["low"] / total - 0.5) < 0.02
    assert mixing.mix(docs, {"big": 1}).where("source <> 'big'").count() == 0
    assert sorted(mixed.collect()) == sorted(mixing.mix(docs, {"big": 1, "mid": 1, "low": 2}, partitions=3).collect())


def test_order_is_global(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    ids = [r.doc_id for r in mixing.mix(docs, partitions=2).collect()]
    assert abs(sum(ids[: len(ids) // 2]) / max(1, len(ids) // 2) - 1000) < 100


def test_edges(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    tiny = spark.createDataFrame([(1, "a" * 10_000, "x"), (2, "b", "y")], "doc_id bigint, text string, source string")
    assert {r.source: r.rate for r in mixing.source_rates(tiny).collect()}["y"] == 10_001 / 2
    assert {r.source: r.rate for r in mixing.source_rates(tiny, max_rate=16).collect()}["y"] == 16
    assert {r.source: round(r.rate, 9) for r in mixing.source_rates(tiny, temperature=1.0).collect()} == {"x": 1.0, "y": 1.0}
    blank = spark.createDataFrame([(1, "", "x"), (2, None, "x")], "doc_id bigint, text string, source string")
    assert {r.rate for r in mixing.source_rates(blank).collect()} == {1.0}


def test_tiny_sources_reach_their_weight(spark):
    docs = spark.range(20100).selectExpr("id AS doc_id", "repeat('a', 100) AS text", "if(id < 20000, 'big', 'tiny') AS source")
    mixed = mixing.mix(docs).groupBy("doc_id", "source", "mixed.copies").agg({"mixed.copy": "count"}).toDF("doc_id", "source", "copies", "n").collect()
    tiny = [r.copies for r in mixed if r.source == "tiny"]
    assert all(r.copies == r.n for r in mixed) and len(tiny) == 100
    mean = sum(tiny) / 100  # due: 100.5, both mean and variance
    assert abs(mean - 100.5) < 4 and 50 < sum((x - mean) ** 2 for x in tiny) / 99 < 175
    assert abs(sum(r.n for r in mixed) / 20100 - 1) < 0.03
    capped = mixing.mix(docs, max_rate=80).where("source = 'tiny'").count()
    assert abs(capped - 8000) < 400


def test_many_copies_of_one_document(spark):
    docs = spark.createDataFrame([(1, "a" * 300_000, "x"), (2, "b", "y")], "doc_id bigint, text string, source string")
    n, last, kinds = mixing.mix(docs).where("doc_id = 2").selectExpr("count(*)", "max(mixed.copy)", "count(DISTINCT mixed.copy)").first()
    assert n == last == kinds and abs(n - 150_000) < 2000


def test_clashing_names_and_rows_without_id(spark):
    docs = spark.createDataFrame([(None, f"t{i}", "s", 1.5, 7, 8, "o", 9) for i in range(4000)], "doc_id bigint, text string, source string, rate double, copies int, copy int, order_key string, mixed int")
    out = mixing.mix(docs, partitions=8)
    assert out.columns == [*docs.columns, "mixed_"]
    rows = out.selectExpr("rate", "copies", "copy", "order_key", "mixed", "spark_partition_id() AS p").collect()
    assert {tuple(r)[:5] for r in rows} == {(1.5, 7, 8, "o", 9)}
    assert max(Counter(r.p for r in rows).values()) < len(rows) / 4
