"""Datasets' plain digests: what they are made of, and how often digests are moved for them."""

import hashlib
import random

from pyspark.sql import functions as F

from ledgerloom.operators import intake, ordering, sessions
from ledgerloom.plans.model import Session, Source


def fp(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def plain(rows):
    """n_records and digest by source, front to back; nulls are counted and have no text."""
    mine = {s: [f for x, f in rows if x == s] for s, _ in rows}
    return {s: (len(fps), hashlib.sha256("".join(f"{f};" for f in sorted(f for f in fps if f is not None)).encode()).hexdigest()) for s, fps in mine.items()}


def found(df):
    return {r.source_id: (r.n_records, r.fingerprint) for r in df.collect()}


def test_digests_are_shuffled_twice_and_never_written(spark, monkeypatch):
    monkeypatch.setattr(intake, "materialise", None)
    rows = [("a", fp(i % 900)) for i in range(2500)] + [("b", fp(i)) for i in range(7)] + [("one", fp(1))] * 12000
    frame = spark.createDataFrame(rows, "source_id string, fp string").withColumn("fp", F.unhex("fp"))
    made = intake.content_fingerprints(frame)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    assert made.columns == ["source_id", "n_records", "fingerprint"] and found(made) == plain(rows)


def test_odd_digests(spark):
    rows = [("a", None), ("a", fp(1)), ("a", None), ("none", None), ("text", "xx"), ("text", ""), ("text", "Z;é"), ("text", None), ("text", "xx")]
    assert found(intake.content_fingerprints(spark.createDataFrame(rows, "source_id string, fp string"))) == plain(rows)
    packed = spark.createDataFrame(rows[:4], "source_id string, fp string").withColumn("fp", F.unhex("fp"))
    assert found(intake.content_fingerprints(packed)) == plain(rows[:4])
    assert intake.content_fingerprints(packed.limit(0)).collect() == []


def test_contents_are_what_fingerprints_and_relations_say(spark):
    draw = random.Random(7)
    sets = {s: [fp(draw.randrange(n)) for _ in range(80)] for s, n in (("a", 40), ("b", 300), ("c", 300))}
    sets |= {"part": sets["a"][:9], "copy": sets["a"][::-1], "twice": sets["a"] * 2, "far": [fp("far")]}
    rows = [(s, f) for s, fps in sets.items() for f in fps]
    frame = spark.createDataFrame(rows, "source_id string, fp string")
    want = {(r.a, r.b): r.relation for r in intake.relations(frame).collect()}
    for prints in (frame, frame.withColumn("fp", F.unhex("fp"))):
        fingerprint, related = intake.contents(prints, [*sets, "empty"])
        assert fingerprint == {s: digest for s, (_, digest) in plain(rows).items()}
        assert {(r["a"], r["b"]): r["relation"] for r in related} == want and want["a", "copy"] == "CONTENT_DUPLICATE" and want["a", "twice"] == "SUBSET_DUPLICATE"


def test_records_are_made_once_and_sorted_rows_carry_no_digest(spark, monkeypatch):
    made, kept, write = spark.sparkContext.accumulator(0), [], ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df, label="step": kept.append(df.columns) or write(df, label))

    def told(x):
        made.add(1)
        return x

    none = {c: F.lit(None).cast("string") for c in ("voucher_no", "debit_account", "credit_account", "debit_amount", "credit_amount")}
    rows = lambda n: spark.createDataFrame([(f"{n}{i}", i, f"{n}{i}", "S", f"2026-01-{i + 1:02}", "01", float(i)) for i in range(5)], "id string, pos bigint, doc_no string, series string, date string, partner_tax_id string, total_amount double").withColumns(none).withColumn("doc_no", F.udf(told)("doc_no"))
    records = {"a": rows("a"), "b": rows("b"), "copy": rows("a"), "untyped": rows("c").withColumns({"series": F.lit("T"), "nothing": F.lit(None)})}
    sources = tuple(Source(n, "ledger511", n, path=n) for n in ("a", "b", "copy"))
    out, merged, _ = sessions.merge_logical(Session("s", sources), records)
    got = merged[out.sources[0].id].orderBy("pos").collect()
    assert [r.doc_no for r in got] == [f"{n}{i}" for i in range(5) for n in "ab"] and [r.pos for r in got] == list(range(1, 11))
    assert made.value == 15
    assert kept and all("fp" not in columns for columns in kept)
    assert sessions.written(Session("s", (Source("untyped", "ledger511"),)), records)["untyped"].count() == 5


def test_counters_need_no_merged_rows(spark, monkeypatch):
    from ledgerloom.plans.more_queries import intake_counters

    steps, write = [], ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df, label="step": steps.append(label) or write(df, label))
    monkeypatch.setattr(intake, "materialise", lambda df, label="step": steps.append(label) or write(df, label))
    got = intake_counters(spark, "/root/testdata/sf0.001").first()
    assert (got.physical, got.uniq, got.content_duplicates, got.logical) == (4, 3, 1, 2) and got.required_ids == f"{got.primary_id},other"
    assert steps == []
