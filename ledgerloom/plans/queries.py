"""The registered queries of the reconciliation engine, and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import controls, infer, intake, matching, normalize, report
from ledgerloom.plans import views
from ledgerloom.plans.model import SCENARIOS, Source
from ledgerloom.session import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = views.duck_sql(sql)
        return f

    return add


INVOICE, LEDGER_511 = Source("inv", "e_invoice", "Hóa đơn", "PRIMARY"), Source("led", "ledger511", "Sổ 511")


def revenue_matcher(spark: SparkSession, sf_dir: str) -> matching.Matcher:
    session = SCENARIOS["scenario_revenue_standard"].session("revenue", (INVOICE, LEDGER_511))
    return matching.Matcher(session, {"inv": views.spark_sql(spark, sf_dir, views.INVOICES), "led": views.spark_sql(spark, sf_dir, views.LEDGER)})


def revenue_frames(spark: SparkSession, sf_dir: str) -> matching.Frames:
    """All frames, for queries that read the groups once, or few columns of them: they aren't written."""
    return revenue_matcher(spark, sf_dir).run(write_groups=False)


def revenue_groups(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of the groups, written, for queries that read them more than once or choose rows by a status."""
    return materialise(revenue_frames(spark, sf_dir).groups.select(*columns), "groups")


#: Statuses of the revenue scenario in closed form; no two invoices share a document number there.
REVENUE_SQL = f"""
WITH inv AS MATERIALIZED ({views.INVOICES}), led AS MATERIALIZED ({views.LEDGER}),
pairs AS MATERIALIZED (
  SELECT i.id, i.pretax_amount AS pri, l.id AS sid, l.pos, l.credit_amount AS amt, abs(date_diff('day', CAST(i.date AS DATE), CAST(l.date AS DATE))) AS days
  FROM inv i JOIN led l ON ltrim(i.doc_no, '0') = l.doc_no AND i.series = l.series AND i.partner_tax_id = l.partner_tax_id
  WHERE abs(date_diff('day', CAST(i.date AS DATE), CAST(l.date AS DATE))) <= 18
), sets AS (
  SELECT id, any_value(pri) AS pri, count(*) AS n, sum(amt) AS total, count(*) FILTER (abs(amt - pri) <= 10) AS direct,
    arg_min(amt, pos) FILTER (abs(amt - pri) <= 10) AS d_amt, arg_min(days, pos) FILTER (abs(amt - pri) <= 10) AS d_days, any_value(amt) AS o_amt, any_value(days) AS o_days
  FROM pairs GROUP BY id
), small_sets AS (
  SELECT id, any_value(pri) AS pri, list(amt ORDER BY pos) AS amts, list(days ORDER BY pos) AS days, list(sid ORDER BY pos) AS sids
  FROM pairs SEMI JOIN (SELECT id FROM sets WHERE n BETWEEN 2 AND 12 AND direct = 0) USING (id) GROUP BY id
), subsets AS MATERIALIZED (
  SELECT id, pri, picked, list_sum([amts[i] FOR i IN picked]) AS s, [sids[i] FOR i IN picked] AS sids FROM (
    SELECT *, list_filter(range(1, len(amts) + 1), lambda i: (mask >> (i - 1)) & 1 = 1) AS picked FROM (SELECT *, unnest(range(1, 1 << len(amts))) AS mask FROM small_sets)
  ) WHERE abs(s - pri) <= 10 AND list_max([days[i] FOR i IN picked]) <= 3
), hits AS (SELECT id, count(*) AS n_subsets, min(s) AS subset_sum FROM subsets GROUP BY id
), judged AS (
  SELECT s.*, coalesce(n_subsets, 0) AS n_subsets, subset_sum, CASE WHEN n = 1 THEN o_amt ELSE d_amt END AS t_amt, CASE WHEN n = 1 THEN o_days ELSE d_days END AS t_days
  FROM sets s LEFT JOIN hits USING (id)
), first_pass AS MATERIALIZED (
  SELECT i.id, CASE
    WHEN n IS NULL THEN 'UNMATCHED_MISSING_IN_TARGET'
    WHEN direct = 0 AND n > 12 THEN 'NEEDS_REVIEW'
    WHEN n = 1 OR direct = 1 THEN CASE WHEN t_amt = pri AND t_days <= 3 THEN 'MATCHED_EXACT' WHEN abs(t_amt - pri) <= 10 AND t_days <= 3 THEN 'MATCHED_WITH_TOLERANCE' WHEN abs(t_amt - pri) > 10 THEN 'MISMATCH_AMOUNT' ELSE 'MISMATCH_METADATA' END
    WHEN direct > 1 OR n_subsets > 1 THEN 'AMBIGUOUS_MATCH' WHEN n_subsets = 1 THEN 'MATCHED_AGGREGATE' ELSE 'MISMATCH_AMOUNT' END AS status,
    CASE WHEN n IS NULL THEN i.pretax_amount WHEN direct = 0 AND n > 12 THEN 0 WHEN n = 1 OR direct = 1 THEN pri - t_amt WHEN direct > 1 OR n_subsets > 1 THEN 0 WHEN n_subsets = 1 THEN pri - subset_sum ELSE pri - total END AS variance,
    n, direct, n_subsets, subset_sum, t_amt
  FROM inv i LEFT JOIN judged USING (id) WHERE i.doc_no IS NOT NULL
), chosen AS MATERIALIZED (
  SELECT p.sid FROM pairs p JOIN first_pass f USING (id) JOIN judged j USING (id)
  WHERE (f.status IN ('MATCHED_EXACT', 'MATCHED_WITH_TOLERANCE') AND (j.n = 1 OR abs(p.amt - p.pri) <= 10))
  UNION ALL
  SELECT unnest(sids) FROM subsets SEMI JOIN (SELECT id FROM first_pass WHERE status = 'MATCHED_AGGREGATE') USING (id)
), tax_pairs AS (
  SELECT i.id, i.pretax_amount AS pri, l.id AS sid, l.credit_amount AS amt FROM inv i JOIN (SELECT * FROM led ANTI JOIN (SELECT sid AS id FROM chosen) USING (id)) l ON i.partner_tax_id = l.partner_tax_id
  WHERE i.doc_no IS NULL AND abs(date_diff('day', CAST(i.date AS DATE), CAST(l.date AS DATE))) <= 3 AND abs(l.credit_amount - i.pretax_amount) <= 10
), second_pass AS MATERIALIZED (
  SELECT id, CASE WHEN count(*) > 1 THEN 'AMBIGUOUS_MATCH' WHEN any_value(amt) <> any_value(pri) THEN 'MISMATCH_METADATA' ELSE 'MATCHED_WITH_TOLERANCE' END AS status, CASE WHEN count(*) > 1 THEN 0 ELSE any_value(pri) - any_value(amt) END AS variance FROM tax_pairs GROUP BY id
), taken AS MATERIALIZED (SELECT sid FROM chosen UNION SELECT t.sid FROM tax_pairs t JOIN second_pass s USING (id) WHERE s.status = 'MATCHED_WITH_TOLERANCE'),
groups AS MATERIALIZED (
  SELECT 'grp_match_' || id AS group_id, status, variance AS amount_variance FROM first_pass
  UNION ALL SELECT 'grp_fallback_' || id, status, variance FROM second_pass
  UNION ALL SELECT 'grp_unmatched_prim_' || id, 'UNMATCHED_MISSING_IN_TARGET', pretax_amount FROM inv ANTI JOIN second_pass USING (id) WHERE doc_no IS NULL
  UNION ALL SELECT 'grp_missing_source_' || id, 'UNMATCHED_MISSING_IN_SOURCE', -credit_amount FROM led ANTI JOIN (SELECT sid AS id FROM taken) USING (id)
)
"""


@register(REVENUE_SQL + "SELECT group_id, status, CAST(amount_variance AS DECIMAL(18,2)) AS amount_variance FROM groups")
def reconcile_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of the revenue scenario: all passes and both sweeps."""
    g = revenue_frames(spark, sf_dir).groups
    return g.select("group_id", "status", F.col("amount_variance").cast("decimal(18,2)").alias("amount_variance"))


# ---- slices of the revenue scenario -----------------------------------------------------------------------------


@register(REVENUE_SQL + """SELECT status, count(*) AS n, CAST(sum(amount_variance) AS DECIMAL(18,2)) AS variance, CAST(sum(abs(amount_variance)) AS DECIMAL(18,2)) AS gross FROM groups GROUP BY status""")
def variance_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = revenue_frames(spark, sf_dir).groups
    money = lambda c, n: F.sum(c).cast("decimal(18,2)").alias(n)
    return g.groupBy("status").agg(F.count(F.lit(1)).alias("n"), money("amount_variance", "variance"), money(F.abs("amount_variance"), "gross"))


@register(REVENUE_SQL + """SELECT (SELECT count(*) FROM inv) AS total_source_records, (SELECT count(*) FROM led) AS total_target_records,
 count(*) FILTER (status = 'MATCHED_EXACT') AS exact_matches_count, count(*) FILTER (status = 'MATCHED_WITH_TOLERANCE') AS tolerance_matches_count, count(*) FILTER (status = 'MATCHED_AGGREGATE') AS aggregate_matches_count,
 count(*) FILTER (status LIKE 'MISMATCH%') AS mismatches_count, count(*) FILTER (status = 'UNMATCHED_MISSING_IN_TARGET') AS missing_in_target_count, count(*) FILTER (status = 'UNMATCHED_MISSING_IN_SOURCE') AS missing_in_source_count,
 count(*) FILTER (status = 'AMBIGUOUS_MATCH') AS ambiguous_count, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review_count, CAST(sum(amount_variance) AS DECIMAL(18,2)) AS revenue_variance, CAST(sum(abs(amount_variance)) AS DECIMAL(18,2)) AS total_discrepant_amount FROM groups""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = revenue_frames(spark, sf_dir).summary
    counts = [c for c in s.columns if c.endswith(("_count", "_records")) and c != "duplicates_count"]
    return s.select(*counts, *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("revenue_variance", "total_discrepant_amount")])


@register(REVENUE_SQL + """SELECT id, n, direct AS n_direct, n_subsets, status FROM first_pass WHERE n IS NOT NULL""".replace("n_subsets, status", "CAST(n_subsets AS INTEGER) AS n_subsets, status"))
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates, ambiguity and complexity: how many candidates, direct matches and subset sums each invoice has."""
    m = revenue_matcher(spark, sf_dir)
    known = m.candidate_sets(m.controls[0], m.p, m.s[0])
    status = m.pass_one()[0].select("p_id", "status")
    return known.where("n > 0").join(status, "p_id").select(F.col("p_id").alias("id"), "n", "n_direct", "n_subsets", "status")


@register(REVENUE_SQL + """SELECT 'grp_missing_source_' || id AS group_id, id AS secondary_id, CAST(credit_amount AS DECIMAL(18,2)) AS amount FROM led ANTI JOIN (SELECT sid AS id FROM taken) USING (id)""")
def residual_secondary_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = revenue_groups(spark, sf_dir, "group_id", "status", "secondary_id", "total_target_amount").where("status = 'UNMATCHED_MISSING_IN_SOURCE'")
    return g.select("group_id", "secondary_id", F.col("total_target_amount").cast("decimal(18,2)").alias("amount"))


@register(REVENUE_SQL + """SELECT 'grp_fallback_' || id AS group_id, status, CAST(variance AS DECIMAL(18,2)) AS variance FROM second_pass""")
def taxid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = revenue_frames(spark, sf_dir).groups.where("primary_id IS NOT NULL AND group_id LIKE 'grp_fallback_%'")  # residuals aren't made
    return g.select("group_id", "status", F.col("amount_variance").cast("decimal(18,2)").alias("variance"))


@register(REVENUE_SQL + """SELECT row_number() OVER (ORDER BY date, doc_no, series, group_id COLLATE C) AS stt, group_id FROM (
 SELECT group_id, coalesce(i.date, l.date, '') AS date, coalesce(i.doc_no, l.doc_no, '') AS doc_no, coalesce(i.series, l.series, '') AS series FROM groups g
 LEFT JOIN inv i ON i.id = regexp_extract(group_id, 'inv_.*$') LEFT JOIN led l ON l.id = regexp_extract(group_id, 'led_.*$'))""".replace(" COLLATE C", ""))
def sorted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.sorted_groups(revenue_groups(spark, sf_dir, "group_id", "date", "doc_no", "series")).select("stt", "group_id")


@register(REVENUE_SQL + """SELECT group_id, status FROM groups LEFT JOIN inv i ON i.id = regexp_extract(group_id, 'inv_.*$') LEFT JOIN led l ON l.id = regexp_extract(group_id, 'led_.*$')
 WHERE status = 'MISMATCH_AMOUNT' AND (contains(lower(coalesce(i.doc_no, l.doc_no, '')), '0042') OR contains(lower(group_id), '0042') OR contains(lower(coalesce(i.partner_name, '')), '0042') OR contains(coalesce(i.date, l.date), '0042') OR contains(lower(coalesce(i.series, l.series)), '0042'))""")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = revenue_groups(spark, sf_dir, "group_id", "status", "doc_no", "series", "date", "partner_name", "primary_id", "secondary_id")
    return report.search(groups, "MISMATCH_AMOUNT", "0042").select("group_id", "status")


@register(REVENUE_SQL + """SELECT group_id, status FROM groups ORDER BY group_id LIMIT 50 OFFSET 100""")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page(revenue_groups(spark, sf_dir, "group_id", "status"), [F.col("group_id")], 3, 50)


@register(REVENUE_SQL + """SELECT group_id, status, CASE WHEN group_id LIKE 'grp_missing%' THEN 0 ELSE 1 END AS n_controls FROM groups WHERE status <> 'MATCHED_EXACT'""".replace("AS n_controls", "AS has_control"))
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's sheet of differences: a row per group and control, one for groups without any."""
    rows = report.report_rows(revenue_frames(spark, sf_dir), only_differences=True)
    fallback_without = F.col("control").isNull() & ~F.col("group_id").startswith("grp_missing")
    return rows.select("group_id", "status", F.when(F.col("control").isNull() & ~fallback_without, 0).otherwise(1).alias("has_control"))


# ---- several controls and sources -------------------------------------------------------------------------------

REGISTER = views.INVOICES.replace("concat('inv_'", "concat('reg_'").replace("ELSE 0 END AS DECIMAL(18,2)) AS pretax_amount", "ELSE 0 END + CASE WHEN o_orderkey % 20 = 12 THEN 7 ELSE 0 END AS DECIMAL(18,2)) AS pretax_amount").replace("CAST(round(s.amt * 0.1, 0) AS DECIMAL(18,2)) AS vat_amount", "CAST(round(s.amt * 0.1, 0) + CASE WHEN o_orderkey % 20 = 13 THEN 3 ELSE 0 END AS DECIMAL(18,2)) AS vat_amount").replace("WHERE o_orderkey % 20 <> 8", "WHERE o_orderkey % 20 NOT IN (8, 5, 14)")
SALES = Source("reg", "sales_register", "Bảng kê bán ra")
_MULTI_SQL = f"""
WITH inv AS MATERIALIZED ({views.INVOICES}), reg AS MATERIALIZED ({REGISTER}),
judged AS (SELECT i.id, i.pretax_amount - r.pretax_amount AS rev, i.vat_amount - r.vat_amount AS vat, i.total_amount - r.total_amount AS rec, i.pretax_amount AS p, i.vat_amount AS v, i.total_amount AS t, r.id IS NULL AS missing, i.doc_no FROM inv i LEFT JOIN reg r ON i.doc_no = r.doc_no AND i.series = r.series)
"""


def _multi(spark: SparkSession, sf_dir: str, *more: Source) -> matching.Frames:
    frames = {"inv": views.spark_sql(spark, sf_dir, views.INVOICES), "reg": views.spark_sql(spark, sf_dir, REGISTER), "led": views.spark_sql(spark, sf_dir, views.LEDGER)}
    scenario = SCENARIOS["scenario_invoice_sales_register_ledger511" if more else "scenario_invoice_sales_register"]
    sources = (INVOICE, SALES, *more)
    return matching.reconcile(scenario.session("multi", sources), {s.id: frames[s.id] for s in sources})


@register(_MULTI_SQL + """SELECT 'grp_match_' || id AS group_id, CASE WHEN missing THEN 'UNMATCHED_MISSING_IN_TARGET' WHEN rev = 0 AND vat = 0 AND rec = 0 THEN 'MATCHED_EXACT' ELSE 'MISMATCH_AMOUNT' END AS status,
 CAST(CASE WHEN missing THEN p ELSE rev END AS DECIMAL(18,2)) AS revenue_variance, CAST(CASE WHEN missing THEN v ELSE vat END AS DECIMAL(18,2)) AS vat_variance, CAST(CASE WHEN missing THEN t ELSE rec END AS DECIMAL(18,2)) AS receivable_variance FROM judged WHERE doc_no IS NOT NULL""")
def multi_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three controls on one source; variances by meaning never net."""
    g = _multi(spark, sf_dir).groups.where("group_id LIKE 'grp_match_%'")
    return g.select("group_id", "status", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("revenue_variance", "vat_variance", "receivable_variance")])


@register(_MULTI_SQL.rstrip() + f""", led AS MATERIALIZED ({views.LEDGER}),
lines AS (SELECT i.id, count(l.id) AS n, sum(l.credit_amount) AS s, any_value(i.pretax_amount) AS p, count(l.id) FILTER (l.credit_amount = i.pretax_amount) AS direct, max(abs(date_diff('day', CAST(i.date AS DATE), CAST(l.date AS DATE)))) AS days
  FROM inv i LEFT JOIN led l ON ltrim(i.doc_no, '0') = l.doc_no AND i.series = l.series AND i.partner_tax_id = l.partner_tax_id AND abs(date_diff('day', CAST(i.date AS DATE), CAST(l.date AS DATE))) <= 18 WHERE i.doc_no IS NOT NULL GROUP BY i.id)
SELECT 'grp_match_' || j.id AS group_id, CASE
  WHEN NOT missing AND (rev <> 0 OR vat <> 0 OR rec <> 0) OR (n = 1 AND direct = 0) OR (n > 1 AND direct = 0) THEN 'MISMATCH_AMOUNT'
  WHEN direct = 1 AND days > 3 THEN 'MISMATCH_METADATA' WHEN direct > 1 THEN 'AMBIGUOUS_MATCH'
  WHEN (missing OR n = 0) AND (NOT missing OR n > 0) THEN 'NEEDS_REVIEW' WHEN missing AND n = 0 THEN 'UNMATCHED_MISSING_IN_TARGET' ELSE 'MATCHED_EXACT' END AS status
FROM judged j JOIN lines USING (id) WHERE doc_no IS NOT NULL""")
def tri_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice, register and ledger: one missing while another matches is for review."""
    return _multi(spark, sf_dir, LEDGER_511).groups.where("group_id LIKE 'grp_match_%'").select("group_id", "status")


# ---- bank -------------------------------------------------------------------------------------------------------

BOOK, BANK = Source("b112", "ledger112", "Sổ 112", "PRIMARY"), Source("bank", "bank_statement", "Sao kê")
_BANK_SQL = f"""
WITH book AS MATERIALIZED ({views.BOOK_112}), stmt AS MATERIALIZED ({views.STATEMENT}),
b AS (SELECT *, coalesce(debit_amount, credit_amount) AS amount, CASE WHEN debit_amount <> 0 THEN 'IN' ELSE 'OUT' END AS dir, regexp_replace(lower(coalesce(voucher_no, '')), '[^a-z0-9]', '', 'g') AS ref FROM book),
s AS (SELECT *, coalesce(debit_amount, credit_amount) AS amount, CASE WHEN credit_amount <> 0 THEN 'IN' ELSE 'OUT' END AS dir, coalesce(transaction_number, '') AS ref FROM stmt),
pairs AS (SELECT b.id, s.id AS sid, b.dir = s.dir AS fits, b.ref <> '' AND b.ref = s.ref AS r, lower(replace(coalesce(b.partner_name, ''), ' ', '')) = lower(replace(coalesce(s.counterparty_name, ''), ' ', '')) AND b.partner_name IS NOT NULL AS c, lower(replace(b.description, ' ', '')) = lower(replace(s.description, ' ', '')) AS d
  FROM b JOIN s ON b.amount = s.amount AND abs(date_diff('day', CAST(b.date AS DATE), CAST(s.date AS DATE))) <= 3),
found AS (SELECT id, count(*) FILTER (fits) AS n, count(*) FILTER (NOT fits) AS opposed, count(*) FILTER (fits AND r) AS nr, count(*) FILTER (fits AND c) AS nc, count(*) FILTER (fits AND d) AS nd FROM pairs GROUP BY id)
"""


def bank_matcher(spark: SparkSession, sf_dir: str) -> matching.Matcher:
    session = SCENARIOS["scenario_ledger112_bank_statement"].session("bank", (BOOK, BANK))
    return matching.Matcher(session, {"b112": views.spark_sql(spark, sf_dir, views.BOOK_112), "bank": views.spark_sql(spark, sf_dir, views.STATEMENT)})


@register(_BANK_SQL + """SELECT book.id, CASE WHEN nr = 1 OR nc = 1 OR nd = 1 THEN 'ACCEPTED' WHEN n = 1 THEN 'SUGGESTED' ELSE 'NEEDS_REVIEW' END AS decision,
 CASE WHEN nr = 1 THEN 'UNIQUE_REFERENCE' WHEN nc = 1 THEN 'UNIQUE_COUNTERPARTY' WHEN nd = 1 THEN 'UNIQUE_EXACT_DESCRIPTION' WHEN n = 1 THEN 'SUGGESTED_DIRECTION_AMOUNT_DATE' WHEN n > 1 THEN 'AMBIGUOUS_BANK_CANDIDATES' WHEN opposed > 0 THEN 'DIRECTION_CONFLICT' ELSE 'INSUFFICIENT_BANK_EVIDENCE' END AS reason FROM book LEFT JOIN found USING (id)""")
def bank_evidence_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bank_matcher(spark, sf_dir)
    pairs = m._amount_pairs(m.controls[0], m.p, m.s[0])
    return m.bank_decisions(m.controls[0], m.p, pairs)[0].select(F.col("p_id").alias("id"), "decision", "reason")


@register(_BANK_SQL + """SELECT 'grp_match_' || book.id AS group_id, CASE WHEN nr = 1 OR nc = 1 OR nd = 1 THEN 'MATCHED_EXACT' ELSE 'NEEDS_REVIEW' END AS status FROM book LEFT JOIN found USING (id)""")
def bank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_matcher(spark, sf_dir).run().groups.where("group_id LIKE 'grp_match_%'").select("group_id", "status")


@register(_BANK_SQL + """SELECT id, sid, fits FROM pairs""")
def direction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bank_matcher(spark, sf_dir)
    pairs = m._amount_pairs(m.controls[0], m.p, m.s[0])
    return pairs.select(F.col("p_id").alias("id"), F.col("s_id").alias("sid"), m._same_direction().alias("fits"))


# ---- scalar rules over text made from the tables ------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


_RAW_DOC = "CASE o_orderkey % 6 WHEN 0 THEN lpad(CAST(o_orderkey AS STRING), 9, '0') WHEN 1 THEN concat(' ', CAST(o_orderkey AS STRING), '.00 ') WHEN 2 THEN concat('HD', CAST(o_orderkey AS STRING)) WHEN 3 THEN concat('000', CAST(o_orderkey AS STRING), '.50') WHEN 4 THEN '000' ELSE CAST(o_orderkey AS STRING) END"


@register(f"""SELECT o_orderkey, CASE WHEN t = '' THEN '' WHEN regexp_matches(cut, '^[0-9]*$') THEN coalesce(nullif(ltrim(cut, '0'), ''), '0') ELSE cut END AS doc_key FROM (
 SELECT *, CASE WHEN contains(t, '.') AND ltrim(substr(t, strpos(t, '.') + 1), '0') = '' THEN substr(t, 1, strpos(t, '.') - 1) ELSE t END AS cut FROM (SELECT o_orderkey, trim({_RAW_DOC}) AS t FROM orders))""")
def scalar_doc_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", S.doc_number(F.expr(_RAW_DOC)).alias("doc_key"))


@register("""SELECT c_custkey, regexp_replace('MST: ' || lpad(CAST(c_custkey AS STRING), 10, '0') || '-' || (c_custkey % 7) || ' / vn', '[^0-9-]', '', 'g') AS tax_key FROM customer""")
def scalar_tax_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.concat(F.lit("MST: "), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit("-"), (F.col("c_custkey") % 7).cast("string"), F.lit(" / vn"))
    return c.select("c_custkey", S.tax_number(raw).alias("tax_key"))


_WHOLE = "CAST(o_orderkey * 1234 AS STRING)"
_RAW_AMOUNT = f"CASE o_orderkey % 8 WHEN 0 THEN concat({_WHOLE}, ' VND') WHEN 1 THEN concat('(', {_WHOLE}, ',50)') WHEN 2 THEN concat({_WHOLE}, '.250,75₫') WHEN 3 THEN concat({_WHOLE}, ',250.75') WHEN 4 THEN concat({_WHOLE}, '.125') WHEN 5 THEN concat('-', {_WHOLE}, '.5') WHEN 6 THEN 'N/A' ELSE concat({_WHOLE}, '-') END"


@register("""SELECT o_orderkey, CAST(CASE o_orderkey % 8 WHEN 0 THEN w WHEN 1 THEN -(w + 0.5) WHEN 2 THEN w * 1000 + 250.75 WHEN 3 THEN w * 1000 + 250.75 WHEN 4 THEN w * 1000 + 125 WHEN 5 THEN -(w + 0.5) WHEN 6 THEN NULL ELSE -w END AS DECIMAL(18,2)) AS amount FROM (SELECT o_orderkey, CAST(o_orderkey * 1234 AS DECIMAL(18,2)) AS w FROM orders)""")
def scalar_amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", S.amount(F.expr(_RAW_AMOUNT)).cast("decimal(18,2)").alias("amount"))


_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_DMY = f"concat(substr({_DAY}, 9, 2), '/', substr({_DAY}, 6, 2), '/', substr({_DAY}, 1, 4))"
_RAW_DATE = f"CASE o_orderkey % 5 WHEN 0 THEN {_DAY} WHEN 1 THEN {_DMY} WHEN 2 THEN concat({_DMY}, ' 08:30') WHEN 3 THEN CAST(datediff(o_orderdate, DATE '1899-12-30') AS STRING) ELSE '31/02/2026' END"


@register(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '31/02/2026' ELSE {_DAY} END AS day FROM orders""")
def scalar_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", S.date_text(F.expr(_RAW_DATE)).alias("day"))


@register(f"""SELECT doc_id, md5(translate(lower(text), '{S.MARKED}', '{S.PLAIN}')) AS plain_md5 FROM documents""")
def scalar_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(S.plain_letters(F.col("text"))).alias("plain_md5"))


_STATUS = "CASE o_orderkey % 6 WHEN 0 THEN 'Hóa đơn điều chỉnh' WHEN 1 THEN 'Thay thế' WHEN 2 THEN 'Đã hủy' WHEN 3 THEN 'Hóa đơn mới' WHEN 4 THEN '' ELSE 'Đã cấp mã' END"


@register(f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'ADJUSTED' WHEN 1 THEN 'REPLACED' WHEN 2 THEN 'CANCELLED' WHEN 3 THEN 'STANDARD' WHEN 4 THEN 'UNKNOWN' ELSE 'STANDARD' END AS lifecycle FROM orders""")
def lifecycle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", S.lifecycle(F.expr(_STATUS)).alias("lifecycle"))


# ---- sheets -----------------------------------------------------------------------------------------------------

SHEET_COLUMNS = ("Ngày ct", "Mã ct", "Số ct", "Ký hiệu", "MST người mua", "Tên khách hàng", "Tiền chưa thuế", "Tiền thuế GTGT", "Tổng tiền thanh toán")
_CELLS = f"array({_DMY}, 'HD', lpad(CAST(o_orderkey AS STRING), 7, '0'), '1c26taa', lpad(CAST(o_custkey AS STRING), 10, '0'), CASE o_orderkey % 25 WHEN 3 THEN '' ELSE concat('Khách ', CAST(o_custkey AS STRING)) END, CASE o_orderkey % 25 WHEN 4 THEN '0' ELSE concat(CAST(CAST(o_totalprice AS DECIMAL(18,0)) AS STRING), ' VND') END, CASE WHEN o_orderkey % 25 IN (4, 6) THEN '' ELSE '1.000' END, CASE o_orderkey % 25 WHEN 5 THEN '7.500,25' ELSE '' END)"


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as sheet rows: every 25th a subtotal, others with blanks or without money."""
    o = _orders(spark, sf_dir)
    cells = F.when(F.expr("o_orderkey % 25 = 1"), F.expr("array('', '', 'Tổng cộng', '', '', '', '99', '9', '108')")).when(F.expr("o_orderkey % 25 = 2"), F.expr("array('', ' ', '', '', '', '', '', '', '')")).otherwise(F.expr(_CELLS))
    return o.select(F.lit("inv").alias("source_id"), F.col("o_orderkey").cast("bigint").alias("row_idx"), cells.alias("cells"))


def sheet_source() -> Source:
    return Source("inv", "e_invoice", mapping=infer.map_columns(SHEET_COLUMNS))


_KEPT = "o_orderkey % 25 NOT IN (1, 2, 4) AND o_orderkey >= 1"


@register(f"""SELECT 'inv_row_' || (o_orderkey + 1) AS id, {_DAY} AS date, lpad(CAST(o_orderkey AS STRING), 7, '0') AS doc_no, '1C26TAA' AS series, lpad(CAST(o_custkey AS STRING), 10, '0') AS partner_tax_id,
 CAST(CAST(o_totalprice AS DECIMAL(18,0)) AS DECIMAL(18,2)) AS pretax_amount, CAST(CASE o_orderkey % 25 WHEN 5 THEN 7500.25 WHEN 6 THEN CAST(o_totalprice AS DECIMAL(18,0)) ELSE CAST(o_totalprice AS DECIMAL(18,0)) + 1000 END AS DECIMAL(18,2)) AS total_amount,
 CASE o_orderkey % 25 WHEN 5 THEN 'SOURCE' ELSE 'DERIVED' END AS total_amount_origin FROM orders WHERE {_KEPT}""")
def normalize_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to canonical records: garbage and money filters, dates, amounts, derived totals."""
    r = normalize.canonical(sheet_rows(spark, sf_dir), sheet_source(), SHEET_COLUMNS)
    return r.select("id", "date", "doc_no", "series", "partner_tax_id", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("pretax_amount", "total_amount")], "total_amount_origin")


@register("SELECT o_orderkey AS row_idx, o_orderkey % 25 IN (1, 2) AS garbage FROM orders")
def garbage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_rows(spark, sf_dir).select("row_idx", S.is_garbage_row(F.col("cells")).alias("garbage"))


@register("""SELECT 'c' || (c_custkey % 40) AS source_id, c_custkey % 40 % 7 + 2 AS row_idx FROM customer GROUP BY ALL""")
def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row of forty sheets: titles and blanks above it, data below."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 40).alias("s")).distinct()
    at = F.col("s") % 7 + 2
    rows = c.select(F.concat(F.lit("c"), F.col("s").cast("string")).alias("source_id"), at.alias("at"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("row_idx"))
    cells = F.when(F.col("row_idx") == F.col("at"), F.array(*[F.lit(x) for x in SHEET_COLUMNS])).when(F.col("row_idx") == 0, F.array(F.lit("BẢNG KÊ HÓA ĐƠN"), F.lit(""))).when(F.col("row_idx") < F.col("at"), F.array(F.lit("Kỳ"), F.lit("01/2026"))).otherwise(F.array(F.lit("05/01/2026"), F.lit("HD"), F.lit("7")))
    return infer.header_rows(rows.select("source_id", "row_idx", cells.alias("cells"))).select("source_id", F.col("row_idx").cast("bigint").alias("row_idx"))


@register("""WITH r AS (SELECT s, ord, kind, score, row_number() OVER (PARTITION BY s ORDER BY score DESC, ord) AS r FROM (SELECT DISTINCT p_partkey % 200 AS s FROM part), LATERAL (VALUES (0, 'e_invoice', (s * 7) % 100), (1, 'ledger511', (s * 13) % 90), (2, 'bank_statement', (s * 29) % 70)) t(ord, kind, score)),
t AS (SELECT s, any_value(kind) FILTER (r = 1) AS k, any_value(score) FILTER (r = 1) AS a, any_value(score) FILTER (r = 2) AS b FROM r GROUP BY s)
SELECT 's' || s AS source_id, CASE WHEN a < 40 OR (b >= 40 AND a - b < 10) THEN 'custom' ELSE k END AS kind, CASE WHEN a < 40 THEN 0.35 WHEN b >= 40 AND a - b < 10 THEN 0.45 ELSE least(0.99, greatest(0.6, a / 100.0)) END::DOUBLE AS confidence FROM t""")
def kind_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 200).cast("int").alias("s")).distinct()
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("kind"), ((F.col("s") * m) % n).alias("score")) for i, (k, m, n) in enumerate((("e_invoice", 7, 100), ("ledger511", 13, 90), ("bank_statement", 29, 70)))])
    return infer.kind_score_frame(s.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("source_id"), F.explode(rows).alias("x")).select("source_id", "x.*"))


# ---- intake -----------------------------------------------------------------------------------------------------

_PRINT = "sha256('Ledger511|' || coalesce(doc_no, '') || '|' || series || '|' || date || '|' || partner_tax_id || '|||' || credit_amount || '||' || total_amount)"


def ledger_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = views.spark_sql(spark, sf_dir, views.LEDGER)
    none = F.lit(None).cast("string")
    return led.withColumns({"voucher_no": none, "debit_account": none, "credit_account": none, "debit_amount": F.lit(None).cast("decimal(18,2)")}).withColumn("fp", intake.record_fingerprint("ledger511"))


@register(f"SELECT id, {_PRINT} AS fp FROM ({views.LEDGER})")
def record_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_prints(spark, sf_dir).select("id", "fp")


_PARTS = f"SELECT {_PRINT} AS fp, unnest(CASE WHEN pos // 1000 % 3 = 0 THEN ['m1', 'm12'] WHEN pos // 1000 % 3 = 1 THEN ['m2', 'm12'] ELSE ['m3'] END) AS source_id FROM ({views.LEDGER})"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger in three parts, and the first two together as a fourth dataset."""
    third = F.floor(F.col("pos") / 1000) % 3
    where = F.when(third == 0, F.array(F.lit("m1"), F.lit("m12"))).when(third == 1, F.array(F.lit("m2"), F.lit("m12"))).otherwise(F.array(F.lit("m3")))
    return ledger_prints(spark, sf_dir).drop("source_id").withColumn("source_id", F.explode(where))


@register(f"""WITH p AS ({_PARTS}), c AS (SELECT source_id, fp, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT source_id, fp[1:3] AS b, sum(n) AS n, sha256(string_agg(fp || 'x' || n, ';' ORDER BY fp || 'x' || n)) AS d FROM c GROUP BY ALL)
SELECT source_id, CAST(sum(n) AS BIGINT) AS n_records, sha256(string_agg(b || ':' || d, ';' ORDER BY b || ':' || d)) AS fingerprint FROM b GROUP BY source_id""")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.dataset_fingerprints(_parts(spark, sf_dir).select("source_id", "fp"))


@register(f"""WITH p AS (SELECT DISTINCT * FROM ({_PARTS})), n AS (SELECT source_id, count(*) AS n FROM p GROUP BY source_id)
SELECT x.source_id AS a, y.source_id AS b, count(*) AS shared, any_value(na.n) AS n_a, any_value(nb.n) AS n_b, CASE WHEN count(*) IN (any_value(na.n), any_value(nb.n)) THEN 'SUBSET_DUPLICATE' ELSE 'PARTIAL_OVERLAP' END AS relation
FROM p x JOIN p y ON x.fp = y.fp AND x.source_id < y.source_id JOIN n na ON na.source_id = x.source_id JOIN n nb ON nb.source_id = y.source_id GROUP BY ALL""")
def subset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.relations(_parts(spark, sf_dir).select("source_id", "fp")).drop("ratio")


@register(f"""SELECT id AS old_id, 'log_ledger511_x_rec_' || CASE WHEN n < 100000 THEN lpad(CAST(n AS STRING), 5, '0') ELSE CAST(n AS STRING) END AS id FROM (SELECT id, row_number() OVER (ORDER BY date, coalesce(doc_no, ''), total_amount, {_PRINT}, pos) AS n FROM ({views.LEDGER}))""")
def union_merge_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger_prints(spark, sf_dir).withColumn("source_id", F.lit("part")).withColumn("old_id", F.col("id"))
    return intake.merge_partitions(led, "log_ledger511_x").select("old_id", "id")


# ---- controls ---------------------------------------------------------------------------------------------------

_MASTERS = "SELECT CAST(c_custkey AS STRING) AS id, concat('KH', CAST(c_custkey AS STRING)) AS partner_code, CASE WHEN c_custkey % 9 <> 4 THEN lpad(CAST(CASE WHEN c_custkey % 50 = 1 THEN c_custkey - 1 ELSE c_custkey END AS STRING), 10, '0') END AS partner_tax_id FROM {customer}"
_BUYERS = "SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_custkey AS STRING), 10, '0') END AS partner_tax_id, concat('KH', CAST(o_custkey + CASE WHEN o_orderkey % 30 = 0 THEN 900000 ELSE 0 END AS STRING)) AS partner_code FROM {orders}"


@register(f"SELECT partner_tax_id, count(*) AS n FROM ({_MASTERS}) WHERE partner_tax_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def partner_duplicate_taxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.duplicate_tax_ids(views.spark_sql(spark, sf_dir, _MASTERS))


@register(f"""WITH m AS ({_MASTERS}), o AS ({_BUYERS}), t AS (SELECT partner_tax_id AS k, count(*) AS n FROM m GROUP BY 1), c AS (SELECT partner_code AS k, count(*) AS n FROM m GROUP BY 1)
SELECT id, coalesce(n, 0) AS n, CASE coalesce(n, 0) WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS resolution FROM (SELECT o.id, CASE WHEN o.partner_tax_id IS NOT NULL THEN t.n ELSE c.n END AS n FROM o LEFT JOIN t ON t.k = o.partner_tax_id LEFT JOIN c ON c.k = o.partner_code)""")
def partner_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.identities(views.spark_sql(spark, sf_dir, _BUYERS), views.spark_sql(spark, sf_dir, _MASTERS))


_ANALYSIS = "SELECT p_brand, CAST(p_partkey AS STRING) AS code, CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS vat, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.7 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS cost FROM {lineitem} JOIN {part} ON p_partkey = l_partkey"
_LEVELS = f"""SELECT 'DETAIL' AS row_level, sum(revenue) AS revenue, sum(vat) AS vat, sum(revenue + vat) AS receivable, sum(cost) AS cost, sum(revenue - cost) AS profit FROM ({_ANALYSIS}) a GROUP BY code
UNION ALL SELECT 'GROUP' AS row_level, sum(revenue) AS revenue, sum(vat) AS vat, sum(revenue + vat) AS receivable, sum(cost) AS cost, sum(revenue - cost) AS profit FROM ({_ANALYSIS}) b GROUP BY p_brand"""


@register(f"SELECT 'OK' AS code, CAST(sum(revenue) AS DECIMAL(18,2)) AS revenue, CAST(sum(profit) AS DECIMAL(18,2)) AS profit FROM ({_LEVELS}) WHERE row_level = 'DETAIL'")
def sales_layer_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = controls.sales_layer_control(views.spark_sql(spark, sf_dir, _LEVELS))
    return out.select("code", F.col("revenue").cast("decimal(18,2)").alias("revenue"), F.col("profit").cast("decimal(18,2)").alias("profit"))


_BALANCES = "SELECT *, CAST(sum(coalesce(debit_amount, 0) - coalesce(credit_amount, 0)) OVER (PARTITION BY account ORDER BY pos) + CASE WHEN pos % 97 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS balance FROM (SELECT concat('e', CAST(event_id AS STRING)) AS id, CAST(event_id AS BIGINT) AS pos, CAST(user_id % 20 AS STRING) AS account, CASE WHEN event_id % 2 = 0 THEN CAST(value AS DECIMAL(18,2)) END AS debit_amount, CASE WHEN event_id % 2 = 1 THEN CAST(value AS DECIMAL(18,2)) END AS credit_amount FROM {events}) e"


@register(f"WITH b AS ({_BALANCES}) SELECT account, id, CAST(off AS DECIMAL(18,2)) AS off FROM (SELECT *, balance - lag(balance) OVER (PARTITION BY account ORDER BY pos) - coalesce(debit_amount, 0) + coalesce(credit_amount, 0) AS off FROM b) WHERE off <> 0")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = controls.running_balance_breaks(views.spark_sql(spark, sf_dir, _BALANCES))
    return out.withColumn("off", F.col("off").cast("decimal(18,2)"))


# ---- generated workloads: 100,000 invoices, all exact --------------------------------------------------------------

_N = 100_000


def _generated(spark: SparkSession, prefix: str, register: bool) -> DataFrame:
    """Row i: pretax 1000 i, tax 100 i, total 1100 i, a day of January 2026 by i modulo 28, one of 500 tax numbers."""
    i = F.col("id")
    rows = spark.range(_N).select(
        F.concat(F.lit(prefix), i.cast("string")).alias("id"),
        i.alias("pos"),
        F.lpad(i.cast("string"), 7, "0").alias("doc_no"),
        F.lit("1C26TAA").alias("series"),
        F.concat(F.lit("2026-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")).alias("date"),
        F.concat(F.lit("010"), F.lpad((i % 500).cast("string"), 7, "0")).alias("partner_tax_id"),
        (i * 1000).cast("decimal(18,2)").alias("pretax_amount"),
        (i * 100).cast("decimal(18,2)").alias("vat_amount"),
        (i * 1100).cast("decimal(18,2)").alias("total_amount"),
    )
    return rows if register else rows.withColumn("credit_amount", F.col("pretax_amount"))


@register(f"SELECT 'MATCHED_EXACT' AS status, CAST({_N} AS BIGINT) AS n")
def workload_pairs_100k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One control: invoices and the revenue ledger."""
    session = SCENARIOS["scenario_revenue_standard"].session("pairs", (INVOICE, LEDGER_511), tolerance=1, aggregate=False)
    frames = matching.reconcile(session, {"inv": _generated(spark, "i", True), "led": _generated(spark, "l", False)})
    return frames.groups.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT 'MATCHED_EXACT' AS status, CAST({_N} AS BIGINT) AS n")
def workload_register_100k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three controls on one source."""
    session = SCENARIOS["scenario_invoice_sales_register"].session("register", (INVOICE, SALES))
    frames = matching.reconcile(session, {"inv": _generated(spark, "i", True), "reg": _generated(spark, "r", True)})
    return frames.groups.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register(f"SELECT 'MATCHED_EXACT' AS status, CAST({_N} AS BIGINT) AS n")
def workload_tri_source_100k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four controls on two sources."""
    session = SCENARIOS["scenario_invoice_sales_register_ledger511"].session("tri", (INVOICE, SALES, LEDGER_511))
    frames = matching.reconcile(session, {"inv": _generated(spark, "i", True), "reg": _generated(spark, "r", True), "led": _generated(spark, "l", False)})
    return frames.groups.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
