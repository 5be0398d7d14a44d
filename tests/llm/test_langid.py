import math
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import langid
from ledgerloom.llm.queries import op5_language_id


def test_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = op5_language_id(spark, small).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in pages.collect())
    assert sum(r.lang == r.declared for r in rows) / len(rows) > 0.9
    assert all(0 < r.confidence <= 1 for r in rows)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("en", "the house and the garden with the tree " * 5), ("de", "das Haus und der Garten mit dem Baum ist schön " * 5), (None, "x"), ("en", None)]
    return spark.createDataFrame(rows, "lang string, text string")


def test_evidence(spark, docs):
    page = lambda lang, text: f"<html lang='{lang}'><script>und der das</script><body>{text}</body></html>"
    rows = [(i, f"http://www.a.example.de/{i}", page("de", "der Garten und das Haus mit dem Baum")) for i in range(20)]
    rows += [(100 + i, f"http://b.example.com/{i}", page("en", "the garden and the house with the tree")) for i in range(20)]
    rows += [(900, "http://www.a.example.de/x", page("de", "")), (901, "http://b.example.com/x", None), (902, None, page("", "the tree and the house")), (None, "no address", ""), (903, "HTTPS://user@B.example.com:80/p?q#f", page("en", "garden the"))]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, lang string")
    got = {r.page_id: r for r in langid.identify(pages, docs).collect()}
    assert len(got) == len(rows)
    assert {got[i].lang for i in range(20)} == {"de"} and {got[100 + i].lang for i in range(20)} == {"en"}
    assert got[900].lang == "de" and got[900].text_lang is None and got[901].lang == "en" and got[902].lang == "en"
    assert got[903].host == "b.example.com" and got[902].suffix == ""
    assert all(abs(sum(r.posteriors.values()) - 1) < 1e-9 for r in got.values())
    assert langid.identify(pages.limit(0), docs).count() == 0
    unknown = langid.identify(pages, docs.limit(0)).collect()
    assert len(unknown) == len(rows) and all(r.lang is None and r.confidence is None for r in unknown)


def test_query_against_brute_force(spark, small):
    """Counts, smoothing, priors and fusion again, row by row in plain Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang IS NOT NULL").collect()
    langs = sorted({r.lang for r in docs})
    counts = {x: np.full(langid.BINS, langid.SMOOTH) for x in langs}
    for r in docs:
        for b in langid.trigram_bins((r.text or "").encode()).tolist():
            counts[r.lang][b] += 1
    logs = {x: np.log(c / c.sum()) for x, c in counts.items()}
    seen = []
    for p in spark.read.parquet(f"{small}/pages.parquet").collect():
        body = re.sub(r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>", " ", p.html or "")
        text = re.sub(r"(?s)<[^>]*>|&#?\w+;", " ", body).strip(" ")
        bins = langid.trigram_bins(text.encode())
        score = {x: logs[x][bins].sum() / max(1, len(bins)) * math.sqrt(len(bins)) for x in langs}
        host = (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", p.url or "") or [0, ""])[1].lower()
        lang = (re.search(r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", p.html or "") or [0, ""])[1].lower()
        seen.append((p.page_id, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], lang, score, max(langs, key=lambda x: (score[x], -langs.index(x))) if text else None))

    def given(at):
        values = Counter((r[at], r[6]) for r in seen if r[6])
        kinds = len({r[at] for r in seen})
        return lambda v, x: math.log((values[v, x] + 1) / (sum(n for (_, y), n in values.items() if y == x) + kinds + 1.0))

    markup, address = given(4), given(3)
    every, hosts, domains = (Counter((r[k] if k else "", r[6]) for r in seen if r[6]) for k in (0, 1, 2))
    every = Counter(r[6] for r in seen if r[6])
    sums = lambda c, k: sum(n for (v, _), n in c.items() if v == k)
    want = {}
    for page, host, domain, suffix, lang, score, _ in seen:
        total = {}
        for x in langs:
            overall = (every[x] + 1) / (sum(every.values()) + len(langs))
            share = (domains[domain, x] + langid.DOMAIN_STRENGTH * overall) / (sums(domains, domain) + langid.DOMAIN_STRENGTH)
            prior = (hosts[host, x] + langid.HOST_STRENGTH * share) / (sums(hosts, host) + langid.HOST_STRENGTH)
            total[x] = score[x] + math.log(prior) + markup(lang, x) + address(suffix, x)
        best = max(langs, key=lambda x: total[x])
        want[page] = (best, 1 / sum(math.exp(t - total[best]) for t in total.values()))
    got = {r.page_id: (r.lang, r.confidence) for r in op5_language_id(spark, small).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(v[1] - want[k][1]) < 2e-6 for k, v in got.items())
