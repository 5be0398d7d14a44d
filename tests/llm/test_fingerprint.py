import hashlib
import re
import struct

import xxhash

from ledgerloom.llm import fingerprint
from ledgerloom.llm.queries import op2_order_minhash

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values, kind="<q"):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack(kind, signed(v & MASK)), seed=seed)
    return seed


def brute(text, k=fingerprint.K):
    """The definition, element by element."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    if not words:
        return fingerprint.EMPTY
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    if len(h) < k:
        folded = 0
        for x in h:
            folded = chain([folded, x])
        kmers = [folded]
    else:
        kmers = [chain(h[i : i + k]) for i in range(len(h) - k + 1)]
    n, bits = len(kmers), 20
    while (1 << bits) < n + 2:
        bits += 1
    low, seen, elements = (1 << bits) - 1, {}, []
    for i, x in enumerate(kmers):
        nth = seen.get(x & ~low, 0)
        seen[x & ~low] = nth + 1
        if nth:
            x = xxhash.xxh64_intdigest(struct.pack("<i", nth), seed=chain([x]))
        elements.append((signed((x & ~low & MASK) | (i + 1)), i))
    elements.sort()
    out = []
    for j in range(-32, 32):
        at = next((q for q, (v, _) in enumerate(elements) if v >= j << 58), 0)
        a, b = sorted(elements[(at + t) % n][1] for t in range(2))
        out.append(f"{chain([kmers[a], kmers[b]]) & 0xFFFFFFFF:08x}")
    return "".join(out)


def likeness(a, b):
    if fingerprint.EMPTY in (a, b):
        return float(a == b)
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 512, 8)) / 64


def test_tricky_rows(tricky, nothing):
    rows = tricky.select("doc_id", "text", fingerprint.order_minhash(tricky["text"]).alias("fp")).collect()
    for r in rows:
        assert r.fp == brute(r.text), r.doc_id
    assert fingerprint.fingerprint_edits(nothing).count() == 0
    assert fingerprint.fingerprint_edits(tricky).count() == tricky.count()


def test_one_row_follows_itself(spark):
    row = fingerprint.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")).first()
    assert row.edited == "abcabc" and row.near_next == 1.0


def test_query_against_brute_force(spark, small):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op2_order_minhash(spark, small).collect()}
    assert len(got) == len(docs)
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = brute(text), brute(edited), brute(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b)
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))


def test_order_counts(spark):
    words = [f"w{i}" for i in range(400)]
    blocks = [words[i : i + 100] for i in range(0, 400, 100)]
    moved = sum(reversed(blocks), [])
    df = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(words[:390]))], "a string, b string, c string")
    a, b, c = (fingerprint.order_minhash(df[x]) for x in "abc")
    r = df.select(fingerprint.likeness(a, b).alias("moved"), fingerprint.likeness(a, c).alias("cut")).first()
    assert r.cut > 0.8 and r.moved < 0.6
