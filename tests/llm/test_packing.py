import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import encoding, packing, token_counts
from ledgerloom.llm.queries import op9_best_fit_packing, op10_token_counts


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(encoding.tokenizer_path())


def ids(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "Hello, World!", "it's a'sb 'll don't", "ﬁ x² Ⅷ ½ ΑΣ Σ", "​ \xa0x y\x1cz\x85w", "İI'S", "x́ ́a", "THE!! £$% 'm", "a<|endoftext|>b <|startoftext|>", "word&&& 555-6605 ***", "ªº µ ß ÿ Ÿ", "a" * 3000, "日本語 テスト", "... ,,, a.b.c (d) |e|", "퟿", "don't. can't, 'tis;"])
def test_ids_are_the_tokenizers_own(whole, text):
    encode = encoding.encoder(encoding.tokenizer_path())
    assert np.frombuffer(encode(text), "<u4").tolist() == ids(whole, text)


def check(rows, texts, whole, capacity):
    """Every document whole, pieces cut only where they must be, places gapless, no sequence too long."""
    place = defaultdict(list)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for doc_id, text in texts:
        all_ids = [*ids(whole, text), 1]
        for piece, at in enumerate(range(0, len(all_ids), capacity)):
            part = all_ids[at : at + capacity]
            want.append((doc_id if doc_id is not None else -1, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert got == sorted(want)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(place), math.ceil(sum(w[3] for w in want) / capacity)


def test_tricky_rows(spark, tricky, whole):
    rows = packing.pack_documents(tricky, capacity=512, items_per_task=4).collect()
    check(rows, [(r.doc_id, r.text) for r in tricky.collect()], whole, 512)


def test_empty_table(nothing):
    assert packing.pack_documents(nothing).count() == 0


def test_query_packs_tightly(spark, small, whole):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    used, least = check(op9_best_fit_packing(spark, small).collect(), docs, whole, 4096)
    assert used <= least * 1.03 + 1


def test_tree_of_rounds(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "cast(1 + pmod(id * 7919, 700) AS int) AS length", "id AS ids_crc32")
    rows = packing.pack_pieces(pieces, 1000, items_per_task=100, fan_in=3).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 3000 and max(fill.values()) <= 1000
    assert len(fill) <= math.ceil(sum(fill.values()) / 1000) * 1.02 + 1


def test_pieces_that_never_fit_together(spark):
    pieces = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "600 AS length", "id AS ids_crc32")
    assert packing.pack_pieces(pieces, 1000, items_per_task=50).select("sequence_id").distinct().count() == 500


def test_histogram_answers(spark, tricky, whole):
    lengths = [len(ids(whole, r.text)) for r in tricky.collect()]
    histogram = token_counts.length_histogram(tricky)
    for r in token_counts.suffix_sums(histogram).collect():
        limit = r.encoded_length
        assert r.docs_at_least == sum(x >= limit for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= limit)
        assert r.truncated_total == sum(min(x, limit) for x in lengths)
        assert r.docs_within == sum(x <= limit for x in lengths)
    got = {r.context_limit: (r.truncated_total, r.docs_cut) for r in token_counts.answer_limits(histogram, [0, 5, 100, 10**6]).collect()}
    assert got == {k: (sum(min(x, k) for x in lengths), sum(x > k for x in lengths)) for k in (0, 5, 100, 10**6)}
    assert [r.encoded_length for r in token_counts.quantiles(histogram, [0.5, 1.0]).orderBy("share").collect()] == [sorted(lengths)[math.ceil(len(lengths) / 2) - 1], max(lengths)]


def test_empty_histogram(nothing):
    histogram = token_counts.length_histogram(nothing)
    assert token_counts.suffix_sums(histogram).count() == 0
    assert token_counts.answer_limits(histogram, [7]).first().truncated_total == 0


def test_counts_query(spark, small, whole):
    lengths = [len(ids(whole, r.text)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = op10_token_counts(spark, small).collect()
    assert sum(r.n_docs for r in rows) == len(lengths) and {r.total_tokens for r in rows} == {sum(lengths)}
    assert sorted((r.encoded_length, r.truncated_total) for r in rows) == [(x, sum(min(x, y) for y in lengths)) for x in range(max(lengths) + 1)]
    ordered = sorted(lengths)
    asked = {p: r.encoded_length for r in rows for p in r.permille}
    assert asked == {p: ordered[math.ceil(len(ordered) * p / 1000) - 1] for p in range(1, 1001)}
