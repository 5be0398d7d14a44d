"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import fingerprint, langid, licenses, media, mixing, packing, periodic, quality, simhash, spelling, suffix, token_counts, winnowing
from ledgerloom.llm.common import parquet


#: Sources are weighted by the square root of their size, between equal shares and shares as they are.
TEMPERATURE = 0.5


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(parquet(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text"), temperature=TEMPERATURE)
    return out.select("doc_id", "source", "n_chars", "mixed.copies", "mixed.copy", F.round("mixed.order_key", 9).alias("order_key"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprint_edits(parquet(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(licenses.documents_as_files(parquet(spark, sf_dir, "documents")))
    return out.select("doc_id", "path", "own_license", "own_score", "license", "how", "inherited_from")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_features(media.media_columns(parquet(spark, sf_dir, "documents")))
    return out.withColumn("feature", F.lower(F.hex("phash"))).drop("phash")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(parquet(spark, sf_dir, "pages"), parquet(spark, sf_dir, "documents"))
    return out.select("page_id", "host", "suffix", "declared", "text_lang", "lang", F.round("confidence", 6).alias("confidence"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(parquet(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals of 400 bytes and more; text is without all repeated passages of over 50 words, which may be shorter."""
    out = suffix.without_repeats(parquet(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    spans = F.coalesce("__found.spans", F.array().cast(suffix.SPANS))
    removed = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    n_bytes = F.coalesce("__found.n_bytes", F.octet_length(raw).cast("bigint"))
    kept = F.coalesce(F.lower(F.hex("__found.kept_sha")), F.sha2(raw, 256))
    return out.select("doc_id", n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size(spans).cast("bigint").alias("n_spans"), kept.alias("kept_sha256"), "text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(parquet(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.every_limit(token_counts.length_histogram(parquet(spark, sf_dir, "documents")))


def op11_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.contamination(parquet(spark, sf_dir, "documents").select("doc_id", "text"), parquet(spark, sf_dir, "benchmark"))
    items = F.col("leak.items")
    return out.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated")
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(parquet(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.frequent(spelling.thinned(spelling.runs(parquet(spark, sf_dir, "documents")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_source_mixing, op2_order_minhash, op3_license_scan, op4_media_columns, op5_language_id, op6_quality_gam, op7_simhash_near_dedup, op8_suffix_dedup, op9_best_fit_packing, op10_token_counts, op11_winnowing_decontamination, op12_periodic_runs, op13_spelling_variants)
}

#: The uniform number of mixing.poisson_copies, in DuckDB.
_UNIT = "CAST(('0x' || substr(md5({seed} || ':' || {text}), 1, 13)) AS BIGINT) / 4503599627370496.0"

_OP1 = f"""
WITH sizes AS (
  SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS chars FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN chars > 0 THEN pow(chars, {TEMPERATURE}) / (SELECT sum(pow(chars, {TEMPERATURE})) FROM sizes) * (SELECT sum(chars) FROM sizes) / chars ELSE 1.0 END AS rate FROM sizes
), draws AS (
  SELECT source, CAST(greatest(1, ceil(rate / {mixing.MEAN})) AS BIGINT) AS draws, rate / greatest(1, ceil(rate / {mixing.MEAN})) AS mean FROM rates
), terms AS (
  SELECT source, k, exp(-mean + k * ln(mean) - list_sum([ln(i) FOR i IN range(1, k + 1)])) AS p FROM draws, range({mixing.TAIL}) t(k) WHERE k > 0
  UNION ALL SELECT source, 0, exp(-mean) FROM draws
), sums AS (
  SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.source, d.n_chars, text_md5,
    len(list_filter(cdf, lambda x: u >= x)) + coalesce(list_sum([len(list_filter(cdf, lambda x: {_UNIT.format(seed=f"'{mixing.SEED}'", text="who || ':' || i")} >= x)) FOR i IN range(2, draws + 1)]), 0) AS copies
  FROM (SELECT *, {_UNIT.format(seed=f"'{mixing.SEED}'", text="who")} AS u FROM (SELECT *, md5(coalesce(text, '')) AS text_md5, coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || md5(coalesce(text, '')) AS who FROM documents)) d
  JOIN sums s ON d.source IS NOT DISTINCT FROM s.source JOIN draws r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, source, n_chars, CAST(copies AS BIGINT) AS copies, CAST(c AS BIGINT) AS copy, text_md5,
  round({_UNIT.format(seed=f"'{mixing.SEED + 1}'", text="coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || text_md5 || ':' || c")}, 9) AS order_key
FROM drawn, LATERAL (SELECT unnest(range(1, CAST(copies AS BIGINT) + 1)) AS c)
"""

_TEMPLATES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(licenses.TEMPLATES.items()))
_OP3 = f"""
WITH templates(license, t) AS (VALUES {_TEMPLATES}),
template_terms AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(t), '{licenses.TERM}')) AS term FROM templates) GROUP BY ALL),
base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_matches(coalesce(text, ''), '{licenses.MARKS}') AS marked,
    coalesce(source, 'unknown') || '/a' || (doc_id // 1024) || '/b' || (doc_id // 64) AS dir
  FROM documents
), shares AS (SELECT doc_id, len(list_filter(found, lambda x: list_contains(vocabulary, x))) >= len(found) * {licenses.FILE_TERMS} AS mostly FROM (SELECT list(DISTINCT term) AS vocabulary FROM template_terms), (SELECT doc_id, regexp_extract_all(lower(text), '{licenses.TERM}') AS found FROM base WHERE marked)),
files AS (SELECT base.*, coalesce(mostly, FALSE) AS is_file FROM base LEFT JOIN shares USING (doc_id)),
headers AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n[ \\t]*\\r?\\n')) AS header FROM files WHERE marked),
lines AS (SELECT doc_id, is_file, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM files WHERE marked),
statements AS (
  SELECT row_number() OVER () AS sid, doc_id, terms FROM (
    SELECT doc_id, regexp_extract_all(lower(line), '{licenses.TERM}') AS terms FROM lines WHERE regexp_matches(line, '{licenses.MARKS}')
    UNION ALL SELECT doc_id, regexp_extract_all(lower(header), '{licenses.TERM}') FROM headers WHERE contains(header, chr(10)) AND regexp_matches(header, '{licenses.MARKS}')
    UNION ALL SELECT doc_id, regexp_extract_all(lower(text), '{licenses.TERM}') FROM files WHERE is_file)
), tf AS (SELECT sid, term, count(*) AS tf FROM (SELECT sid, unnest(terms) AS term FROM statements) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM statements),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM template_terms) LEFT JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term), n),
weighed AS (SELECT sid, term, tf * coalesce(idf, ln(1.0 + n) + 1) AS w FROM tf LEFT JOIN idf USING (term), n),
norms AS (SELECT sid, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY sid),
template_norms AS (SELECT license, sqrt(sum(tf * idf * tf * idf)) AS norm FROM template_terms JOIN idf USING (term) GROUP BY license),
cosines AS (
  SELECT sid, license, round(sum(w * t.tf * idf) / any_value(norms.norm) / any_value(template_norms.norm), 9) AS score
  FROM weighed JOIN template_terms t USING (term) JOIN idf USING (term) JOIN norms USING (sid) JOIN template_norms USING (license) GROUP BY sid, license
), own AS (
  SELECT doc_id, split_part(first(license ORDER BY score DESC, license), '{licenses.LONG_MARK}', 1) AS own_license, round(max(score), 6) AS own_score
  FROM cosines JOIN statements USING (sid) GROUP BY doc_id HAVING max(score) >= {licenses.THRESHOLD}
), holders AS (SELECT dir, first(own_license ORDER BY own_score DESC, own_license) AS inherited FROM files JOIN own USING (doc_id) WHERE is_file GROUP BY dir)
SELECT f.doc_id, f.dir || CASE WHEN is_file THEN '/LICENSE' ELSE '/doc_' || f.doc_id || '.txt' END AS path, own_license, own_score,
  coalesce(own_license, h3.inherited, h2.inherited, h1.inherited) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN coalesce(h3.inherited, h2.inherited, h1.inherited) IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN own_license IS NULL THEN coalesce(h3.dir, h2.dir, h1.dir) END AS inherited_from
FROM files f LEFT JOIN own USING (doc_id)
LEFT JOIN holders h3 ON h3.dir = f.dir
LEFT JOIN holders h2 ON h2.dir = array_to_string(string_split(f.dir, '/')[1:2], '/')
LEFT JOIN holders h1 ON h1.dir = string_split(f.dir, '/')[1]
"""

_LOW = f"translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, words, least({winnowing.WINDOW}, len(words)) AS k FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(words[p:p + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS p FROM i)),
places AS (SELECT row, p, k, array_to_string(words[p:p + k - 1], ' ') AS win FROM (SELECT row, words, k, unnest(range(1, len(words) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows))),
hits AS (SELECT row, p, k, item FROM places JOIN windows USING (win, k)),
hit_words AS (SELECT row, count(DISTINCT w) AS n_hit FROM (SELECT row, unnest(range(p, p + k)) AS w FROM (SELECT DISTINCT row, p, k FROM hits)) GROUP BY row),
found AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits WHERE item IS NOT NULL) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (row) LEFT JOIN found USING (row)
"""

#: CRC-32 by the table of its 256 one-byte remainders, which SQL makes from the polynomial.
_OP13 = f"""
WITH RECURSIVE remainders AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-z\u00C0-\u00FF]+')) AS word FROM documents) GROUP BY ALL),
bytes AS (SELECT *, hex(doc_id || ':' || word) AS x FROM runs),
hashed AS (SELECT *, xor(list_reduce(list_transform(range(len(x) // 2), lambda j: CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, remainders),
thinned AS (SELECT CASE WHEN h % {spelling.THIN} = 0 THEN left(word, CAST(h % len(word) AS INT)) || substr(word, CAST(h % len(word) AS INT) + 2) ELSE word END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM thinned WHERE len(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.MIN_COUNT}),
cuts AS (SELECT word, n, p, left(word, CAST(p AS INT) - 1) || substr(word, CAST(p AS INT) + 1) AS key FROM (SELECT *, unnest(range(1, len(word) + 1)) AS p FROM words)),
longer AS (SELECT DISTINCT a.word, b.word AS near FROM cuts a JOIN words b ON a.key = b.word),
near AS (SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.key = b.key AND a.p = b.p AND a.word <> b.word UNION ALL SELECT word, near FROM longer UNION ALL SELECT near, word FROM longer),
best AS (SELECT near.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS form, max(w.n) AS form_n FROM near JOIN words w ON w.word = near.near GROUP BY near.word),
formed AS (SELECT words.word, CASE WHEN form_n >= {spelling.RATIO} * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.RATIO} * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS here, form AS next FROM formed UNION ALL SELECT ways.word, f.word, f.form FROM ways JOIN formed f ON f.word = ways.next)
SELECT formed.word, form, here AS root, n, n_near, form_n FROM formed JOIN ways ON ways.word = formed.word AND next IS NULL
"""

ORACLE_SQL: dict[str, str] = {"op1_source_mixing": _OP1, "op3_license_scan": _OP3, "op11_winnowing_decontamination": _OP11, "op13_spelling_variants": _OP13}
