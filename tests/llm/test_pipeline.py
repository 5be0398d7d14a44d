
import corpus_pipeline
from ledgerloom.llm import quality, suffix
from test_jaccard import brute_groups
from test_suffix import brute_spans


def test_stages_on_the_smallest_tables(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) in (4, 5) and len(set(names)) == len(names)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        rows = out.collect()
        if name == "quality_classifier":
            model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
            want = {i for i, r in before.items() if model.score(quality.feature_rows([r.text.encode()]))[0] >= 0.3}
            assert {r.doc_id for r in rows} == want and len(want) > 0.7 * len(before)
        elif name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in rows) == sorted(g[0] for g in brute_groups(list(before), [r.text for r in before.values()]))
        elif name == "suffix_array_dedup":
            ids = sorted(before)
            raw = [before[i].text.encode() for i in ids]
            spans = [[x for x in found if suffix.is_passage(t, x)] for t, found in zip(raw, brute_spans(raw, suffix.PASSAGE_BYTES), strict=True)]
            want = {i: suffix.without(t, s).decode("utf-8", "ignore") for i, t, s in zip(ids, raw, spans, strict=True)}
            assert {r.doc_id: r.text for r in rows} == {i: t for i, t in want.items() if t.strip(" ")}
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "source_mixing":
            assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in before.values()}
        else:
            assert {r.doc_id for r in rows} == set(before)
        if name != names[-1]:
            assert out.columns == columns
        docs = out


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_on_tricky_and_empty_tables(spark, tricky, nothing, small):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (tricky, nothing):
            out = stage(spark, docs, small)
            rows = out.collect()
            if docs is nothing:
                assert rows == []
            elif name in ("quality_classifier", "simhash_near_dedup", "suffix_array_dedup"):
                assert {(r.doc_id, r.hash) for r in rows} <= {(r.doc_id, r.hash) for r in docs.collect()}
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            elif docs is tricky:
                assert len(rows) >= docs.count()
