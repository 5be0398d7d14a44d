import random
import re
import zlib
from collections import Counter, defaultdict

from ledgerloom.llm import spelling
from ledgerloom.llm.common import join_small
from ledgerloom.llm.queries import op13_spelling_variants


def brute_words(docs, one_in=199, length=6, least=5):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{w}".encode()) if doc is not None else 1
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += len(w) >= length
    return {w: n for w, n in found.items() if n >= least}


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    """Near words by all pairs that share the word or a deletion; forms and roots one by one."""
    by, near, form = defaultdict(set), defaultdict(set), {}
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[key].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if a != b and is_near(a, b)}
    for w, n in counts.items():
        if near[w] and counts[best := min(near[w], key=lambda x: (-counts[x], x))] >= ratio * n:
            form[w] = best
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return sorted(out)


def grouped(spark, counts):
    return sorted(map(tuple, spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()))


def test_random_words_against_brute_force(spark):
    rng = random.Random(2)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))): rng.choice((5, 24, 25, 125, 126, 700)) for _ in range(300)}
    want = brute(counts)
    assert grouped(spark, counts) == want and sum(w[1] is not None for w in want) > 30


def test_long_chains_ties_and_near_misses(spark):
    chain = {"a" * 6 + "b" * i + "c" * (12 - i): 5 ** (i + 1) for i in range(13)}
    odd = {"different": 50, "differnet": 5, "difeerent": 9, "zebras": 30, "zebraa": 30, "zebra": 6, "abcdef": 10, "bcdefa": 60}
    want = {w[0]: w for w in brute(chain | odd)}
    got = {w[0]: w for w in grouped(spark, chain | odd)}
    assert got == want
    assert got["a" * 6 + "c" * 12][2] == "a" * 6 + "b" * 12
    assert got["zebra"][1] == "zebraa" and got["differnet"][4] == 0 and got["abcdef"][4] == 0


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = op13_spelling_variants(spark, small)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == brute(brute_words(docs))


def test_tricky_rows(spark, tricky, nothing):
    docs = [(r.doc_id, r.text) for r in tricky.collect()]
    counted = spelling.frequent(spelling.thinned(spelling.runs(tricky), one_in=2), min_length=1, min_count=1)
    counts = {r.word: r.n for r in counted.collect()}
    assert counts == {w: n for w, n in brute_words(docs, one_in=2, length=1, least=1).items() if w}
    assert sorted(map(tuple, spelling.group_variants(counted).collect())) == brute(counts)
    assert spelling.group_variants(spelling.frequent(spelling.runs(nothing))).collect() == []


def test_no_python_on_the_data(spark, small):
    words = spelling.frequent(spelling.thinned(spelling.runs(spark.read.parquet(f"{small}/documents.parquet"))))
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_no_table_of_cuts_goes_through_the_driver(spark):
    """A written table of words is far smaller than its cuts, so that Spark would broadcast them unasked."""
    words = spelling.materialise(spark.range(5000).selectExpr("concat('word', id) AS word", "id AS n"), "words")
    plan = spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_no_forms_go_through_the_driver(spark, monkeypatch):
    """Rounds join words with forms, which are as many, and salted copies are SALTS times the table that Spark weighs."""
    plans, write = [], spelling.materialise
    monkeypatch.setattr(spelling, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, label))
    forms = write(spark.range(1, 3000).selectExpr("concat('word', id) AS word", "concat('word', id div 2) AS form"), "forms")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {f"word{i}": "word0" for i in range(1, 3000)}
    assert plans and not any("Broadcast" in p for p in plans) and all("SortMergeJoin" in p for p in plans)
    salted = join_small(forms, forms.selectExpr("word AS form", "form AS next"), ["form"], forms["word"], limit=5)
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
