"""Queries of the built-in scenarios that no other query runs, and what is made of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import matching, report
from ledgerloom.plans import views
from ledgerloom.plans.model import KIND_NAMES, SCENARIOS, SEMANTIC_NAMES, Source
from ledgerloom.plans.queries import register

_HEAD = "o_orderkey AS k, CAST(o_orderkey AS BIGINT) AS pos, CAST(o_orderkey AS STRING) AS doc_no, 'S' AS series, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, lpad(CAST(o_custkey AS STRING), 10, '0') AS partner_tax_id"
_PRETAX = "CAST(round(o_totalprice, 0) AS DECIMAL(18,2))"
_VAT = "CAST(round(o_totalprice / 10, 0) AS DECIMAL(18,2))"
BILLS = f"SELECT concat('i', CAST(o_orderkey AS STRING)) AS id, {_HEAD}, {_PRETAX} AS pretax_amount, {_VAT} AS vat_amount, CAST({_PRETAX} + {_VAT} AS DECIMAL(18,2)) AS total_amount FROM {{orders}}"


def _off(m: int) -> str:
    """What a book differs by, by order key modulo m: 1 by 5, 2 by 1000, else nothing."""
    return f"CASE o_orderkey % {m} WHEN 1 THEN 5 WHEN 2 THEN 1000 ELSE 0 END"


def book(letter: str, m: int, column: str, amount: str) -> str:
    """A book of one entry for each order, but for those whose key m divides."""
    return f"SELECT concat('{letter}', CAST(o_orderkey AS STRING)) AS id, {_HEAD}, CAST({amount} + {_off(m)} AS DECIMAL(18,2)) AS {column} FROM {{orders}} WHERE o_orderkey % {m} <> 0"


SALES, OUTPUT_VAT, RECEIVABLES = book("r", 7, "credit_amount", _PRETAX), book("v", 11, "credit_amount", _VAT), book("d", 13, "debit_amount", f"({_PRETAX} + {_VAT})")
INPUT_VAT = book("n", 7, "debit_amount", _VAT)
CREDITS, PAYMENTS = book("c", 17, "credit_amount", _PRETAX), book("b", 7, "credit_amount", _PRETAX)
_BILL = Source("inv", "e_invoice", KIND_NAMES["e_invoice"], "PRIMARY")


def _run(spark: SparkSession, sf_dir: str, scenario: str, *parts: tuple[Source, str]) -> matching.Frames:
    sources = tuple(s for s, _ in parts)
    return matching.reconcile(SCENARIOS[scenario].session(scenario, sources), {s.id: views.spark_sql(spark, sf_dir, text) for s, text in parts}, write_groups=False)


def _three_books(spark: SparkSession, sf_dir: str) -> matching.Frames:
    books = ((Source("r", "ledger511"), SALES), (Source("v", "ledger3331"), OUTPUT_VAT), (Source("d", "ledger131", role="OPTIONAL"), RECEIVABLES))
    return _run(spark, sf_dir, "scenario_revenue_vat_receivables", (_BILL, BILLS), *books)


def _state(m: int, tolerance: int = 10) -> str:
    return f"CASE WHEN k % {m} = 0 THEN 'missing' WHEN k % {m} = 2 THEN 'off' WHEN k % {m} = 1 THEN '{'near' if tolerance >= 5 else 'off'}' ELSE 'same' END"


def _variance(m: int, amount: str) -> str:
    return f"CAST(CASE WHEN k % {m} = 0 THEN {amount} WHEN k % {m} = 1 THEN -5 WHEN k % {m} = 2 THEN -1000 ELSE 0 END AS DECIMAL(18,2))"


_MONEY = ("revenue_variance", "vat_variance", "receivable_variance")


@register(f"""SELECT id, CASE WHEN 'off' IN (r, v, d) THEN 'MISMATCH_AMOUNT' WHEN 'missing' IN (r, v) THEN 'UNMATCHED_MISSING_IN_TARGET' WHEN d = 'missing' THEN 'MATCHED_WITH_MISSING_SOURCE'
  WHEN r = 'same' AND v = 'same' AND d = 'same' THEN 'MATCHED_EXACT' ELSE 'MATCHED_WITH_TOLERANCE' END AS status, revenue_variance, vat_variance, receivable_variance
FROM (SELECT id, {_state(7)} AS r, {_state(11)} AS v, {_state(13)} AS d, {_variance(7, 'pretax_amount')} AS revenue_variance, {_variance(11, 'vat_amount')} AS vat_variance, {_variance(13, 'total_amount')} AS receivable_variance FROM ({BILLS}))""")
def scenario_three_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, tax and receivables of each invoice, the receivables optional."""
    g = _three_books(spark, sf_dir).groups.where("primary_id IS NOT NULL")
    return g.select(F.col("primary_id").alias("id"), "status", *[F.col(c).cast("decimal(18,2)").alias(c) for c in _MONEY])


_STATUS = "CASE {} WHEN 'off' THEN 'MISMATCH_AMOUNT' WHEN 'missing' THEN 'UNMATCHED_MISSING_IN_TARGET' WHEN 'near' THEN 'MATCHED_WITH_TOLERANCE' ELSE 'MATCHED_EXACT' END"


@register(f"""SELECT id, {_STATUS.format(_state(7))} AS status, {_variance(7, 'vat_amount')} AS vat_variance FROM ({BILLS})
UNION ALL SELECT id, 'UNMATCHED_MISSING_IN_SOURCE', CAST(-debit_amount AS DECIMAL(18,2)) FROM ({INPUT_VAT}) WHERE k % 7 = 2""")
def scenario_input_vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deductible tax: entries that differ too much stay and are shown as missing from the invoices."""
    g = _run(spark, sf_dir, "scenario_input_vat", (_BILL, BILLS), (Source("n", "ledger133"), INPUT_VAT)).groups
    return g.select(F.coalesce("primary_id", "secondary_id").alias("id"), "status", F.col("vat_variance").cast("decimal(18,2)").alias("vat_variance"))


@register(f"""SELECT c.id, CASE WHEN b.id IS NULL THEN 'UNMATCHED_MISSING_IN_TARGET' WHEN b.credit_amount = c.credit_amount THEN 'MATCHED_EXACT' ELSE 'MISMATCH_AMOUNT' END AS status,
  CAST(c.credit_amount - coalesce(b.credit_amount, 0) AS DECIMAL(18,2)) AS other_variance FROM ({CREDITS}) c LEFT JOIN ({PAYMENTS}) b USING (k)""")
def scenario_bank_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts booked for receivables against the bank's statement, by document number, without any tolerance."""
    parts = (Source("c", "ledger131", role="PRIMARY"), CREDITS), (Source("b", "bank_statement"), PAYMENTS)
    g = _run(spark, sf_dir, "scenario_bank_reconciliation", *parts).groups.where("primary_id IS NOT NULL")
    return g.select(F.col("primary_id").alias("id"), "status", F.col("other_variance").cast("decimal(18,2)").alias("other_variance"))


@register(f"SELECT 'grp_match_' || id AS group_id, 'NEEDS_REVIEW' AS status FROM ({BILLS}) UNION ALL SELECT 'grp_missing_source_' || id, 'NEEDS_REVIEW' FROM ({PAYMENTS})")
def scenario_without_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that no rule compares: every record is for review, none is dropped."""
    return _run(spark, sf_dir, "scenario_custom_multi_source", (_BILL, BILLS), (Source("cash", "cash_book"), PAYMENTS)).groups.select("group_id", "status")


_COMPARED = " UNION ALL ".join(f"SELECT '{i}' AS source_id, '{s}' AS semantic, {_STATUS.format(_state(m))} AS status, {_variance(m, a)} AS variance FROM ({BILLS})" for i, s, m, a in (("r", "REVENUE", 7, "pretax_amount"), ("v", "VAT", 11, "vat_amount"), ("d", "RECEIVABLE", 13, "total_amount")))


@register(f"""SELECT source_id, semantic, status, CAST(GROUPING_ID(source_id, semantic, status) AS INT) AS level, count(*) AS n, CAST(sum(variance) AS DECIMAL(18,2)) AS variance, CAST(sum(abs(variance)) AS DECIMAL(18,2)) AS gross
FROM ({_COMPARED}) GROUP BY ROLLUP (source_id, semantic, status)""")
def variance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: variances of the three books by source, semantic and status, with their totals."""
    out = report.variance_rollup(_three_books(spark, sf_dir))
    return out.select("source_id", "semantic", "status", "level", "n", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("variance", "gross")])


@register(f"""SELECT i.id, r.id AS sid, CAST(i.pretax_amount AS DECIMAL(18,2)) AS primary_amount, CAST(r.credit_amount AS DECIMAL(18,2)) AS secondary_amount, '{SEMANTIC_NAMES['REVENUE']}' AS semantic_name, CAST(10 AS INT) AS tolerance, 3 AS days
FROM ({BILLS}) i JOIN ({SALES}) r USING (k) WHERE k % 3 <> 0""")
def rule_pair_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first rule of two kinds compares in given pairs; pairs that lack an amount go."""
    side = lambda text, x: (df := views.spark_sql(spark, sf_dir, text)).select("k", *[F.col(c).alias(x + c) for c in df.columns if c != "k"])
    pairs = side(BILLS, "p_").join(side(SALES, "s_"), "k").withColumn("s_credit_amount", F.when(F.col("k") % 3 != 0, F.col("s_credit_amount")))
    session = SCENARIOS["scenario_revenue_standard"].session("pairs", (_BILL, Source("r", "ledger511")))
    out = matching.pair_amounts(session, pairs, "e_invoice", "ledger511")
    return out.select(F.col("p_id").alias("id"), F.col("s_id").alias("sid"), *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("primary_amount", "secondary_amount")], "semantic_name", F.col("tolerance").cast("int").alias("tolerance"), "days")
