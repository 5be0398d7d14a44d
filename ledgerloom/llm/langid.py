"""Language identification of web pages by Bayesian fusion of four kinds of evidence.

1. Text: a byte-trigram model for each language, counted over all labelled documents, gives each page a likelihood. It is
   tempered by the square root of the text's length, as neighbouring trigrams aren't independent.
2. Declared markup language, and 3. address suffix: how often each value goes with each language, by grouped counts over
   all pages under the text's own verdict, smoothed.
4. Host prior: shares of languages by host, smoothed towards those of its domain, smoothed towards those of all pages.

The counts are grouped aggregations; the tables that come back into the job are joined with a checked size. The posterior
is a sum of logarithms in DataFrame expressions.

Null or empty page: no text evidence, the others decide. Null or odd address: host, domain and suffix are empty strings.
No declared language: the value "". Null page_id: kept. Repeated rows: the same verdict; each counts. Empty pages: no
rows. No labelled documents: no language is known, so lang and confidence are null and there are no posteriors. Of more
than MAX_LANGS languages those with the most trigrams are told apart. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import join_small, materialise, slices

#: Hash bins of the trigram model, and pseudo-counts.
BINS = 1 << 15
#: Languages of the model (a bound of its size: languages x BINS numbers go to the driver and to every task).
MAX_LANGS = 256
SMOOTH = 0.5
EVIDENCE_SMOOTH = 1.0
DOMAIN_STRENGTH = 10.0
HOST_STRENGTH = 5.0
#: How long a text counts as fully independent evidence.
TEMPER = 1.0


def trigram_bins(raw: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + raw.lower() + b" ", "u1").astype("u4")
    if len(b) < 3:
        return np.zeros(0, "i8")
    code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype("i8")


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bin, n over all documents that have a language; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = tables.setdefault(lang, np.zeros(BINS, "i8"))
                for at in range(0, len(text), 1 << 20):
                    table += np.bincount(trigram_bins(text[at : at + (1 << 20)]), minlength=BINS)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype("i4")), pa.array(table[at])], ["lang", "bin", "n"])

    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    return usable.mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bin: languages x BINS numbers, whatever the corpus holds."""
    counted = materialise(trigram_counts(docs), "trigrams")
    most = counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    table = counted.join(F.broadcast(most.select("lang")), "lang", "left_semi").toPandas()
    langs = sorted(table["lang"].unique())
    if not langs:
        return [], np.zeros((0, BINS))
    counts = np.full((len(langs), BINS), SMOOTH)
    counts[[langs.index(x) for x in table["lang"]], table["bin"].to_numpy()] += table["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles and navigation go, then all tags and entities."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>", " ")
    return F.regexp_replace(body, r"(?s)<[^>]*>|&#?\w+;", " ")


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """host, domain (its last two labels), suffix (its last label)."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    labels = F.split(host, r"\.")
    return host, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.element_at(labels, -1)


def declared_language(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def text_likelihoods(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, likelihoods (tempered, by language), text_lang (null without text)."""
    host, domain, suffix = address_parts(F.col("url"))
    seen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), declared_language(F.col("html")).alias("declared"), F.trim(page_text(F.col("html"))).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores, best = [], []
            for text in batch.column(5).to_pylist():
                total, n = np.zeros(len(langs)), 0
                for at in range(0, len(text), 1 << 20):
                    bins = trigram_bins(text[at : at + (1 << 20)])
                    total += logs[:, bins].sum(axis=1)
                    n += len(bins)
                mean = total / max(1, n) * np.sqrt(n) * TEMPER if text else total
                scores.append(mean - mean.max())
                best.append(langs[int(np.argmax(mean))] if text else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.list_(pa.float64())), pa.array(best, pa.string())], ["page_id", "host", "domain", "suffix", "declared", "likelihoods", "text_lang"])

    return seen.mapInArrow(run, "page_id bigint, host string, domain string, suffix string, declared string, likelihoods array<double>, text_lang string")


def _by_language(df: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """key, one count for each language, and their sum: partial counts first, so a hot key is no hot task."""
    counts = [F.count_if(F.col("text_lang") == x).alias(f"n{i}") for i, x in enumerate(langs)]
    return df.groupBy(key).agg(*counts, F.count("text_lang").alias("n"))


def _given_language(df: DataFrame, key: str, langs: list[str], name: str) -> DataFrame:
    """log P(key's value | language), smoothed over the values."""
    table = materialise(_by_language(df, key, langs), key)
    sums = table.agg(F.count(F.lit(1)).alias("values"), *[F.sum(f"n{i}").alias(f"s{i}") for i in range(len(langs))]).first()
    values = sums["values"] or 0
    logs = [F.log((F.col(f"n{i}") + EVIDENCE_SMOOTH) / F.lit((sums[f"s{i}"] or 0) + EVIDENCE_SMOOTH * (values + 1.0))) for i in range(len(langs))]
    return table.select(key, F.array(*logs).alias(name))


def host_priors(df: DataFrame, langs: list[str]) -> DataFrame:
    """host, log prior of each language: host counts towards domain counts towards all counts."""
    n = len(langs)
    hosts = materialise(df.groupBy("host", "domain").agg(*[F.count_if(F.col("text_lang") == x).alias(f"n{i}") for i, x in enumerate(langs)], F.count("text_lang").alias("n")), "hosts")
    top = hosts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)], F.sum("n").alias("n")).first()
    overall = [((top[f"n{i}"] or 0) + 1.0) / ((top["n"] or 0) + n) for i in range(n)]
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(n)], F.sum("n").alias("d"))
    shares = [(F.col(f"d{i}") + F.lit(DOMAIN_STRENGTH * overall[i])) / (F.col("d") + DOMAIN_STRENGTH) for i in range(n)]
    priors = [F.log((F.col(f"n{i}") + HOST_STRENGTH * s) / (F.col("n") + HOST_STRENGTH)) for i, s in enumerate(shares)]
    return join_small(hosts, materialise(domains, "domains"), ["domain"], F.col("host"), "inner").select("host", F.array(*priors).alias("prior"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, suffix, declared, text_lang, lang, confidence (the posterior of lang), posteriors."""
    langs, logs = train(docs)
    if not langs:
        host, _, suffix = address_parts(F.col("url"))
        none = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), suffix.alias("suffix"), declared_language(F.col("html")).alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("map<string,double>").alias("posteriors"))
    seen = materialise(text_likelihoods(pages, langs, logs), "pages")
    out = join_small(seen, materialise(host_priors(seen, langs), "priors"), ["host"], F.col("page_id"), "inner")
    for key, name in (("declared", "markup"), ("suffix", "address")):
        out = join_small(out, _given_language(seen, key, langs, name), [key], F.col("page_id"), "inner")
    names = F.array(*[F.lit(x) for x in langs])
    sums = F.transform(F.arrays_zip("likelihoods", "prior", "markup", "address"), lambda e: e["likelihoods"] + e["prior"] + e["markup"] + e["address"])
    fused = out.withColumn("sums", sums).withColumn("best", F.array_max("sums"))
    total = F.aggregate("sums", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("best")))
    return fused.withColumn("total", total).select(
        "page_id",
        "host",
        "suffix",
        "declared",
        "text_lang",
        F.element_at(names, F.array_position("sums", F.col("best")).cast("int")).alias("lang"),
        (1 / F.col("total")).alias("confidence"),
        F.map_from_arrays(names, F.transform("sums", lambda s: F.exp(s - F.col("best")) / F.col("total"))).alias("posteriors"),
    )
