"""Accounting views derived from the star-schema tables, in SQL that Spark and DuckDB both run.

k = order key modulo 20 injects a difference: 0 ledger lines absent, 1 invoice 5 higher, 2 invoice 1000 higher, 3 ledger 10
days later, 4 ledger under another series, 5 no document numbers, 6 another tax number, 7 single lines booked twice,
8 invoice absent, the rest none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES = """
SELECT l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS amt, CAST(l_tax AS DECIMAL(18,2)) AS tax_rate, l_orderkey * 1000 + 2 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos,
  count(*) OVER (PARTITION BY l_orderkey) AS n_lines
FROM {lineitem}
"""

INVOICES = f"""
SELECT concat('inv_', CAST(o_orderkey AS STRING)) AS id, CAST(o_orderkey AS BIGINT) AS pos,
  CASE WHEN o_orderkey % 20 <> 5 THEN lpad(CAST(o_orderkey AS STRING), 8, '0') END AS doc_no, '1C26TAA' AS series,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, lpad(CAST(o_custkey AS STRING), 10, '0') AS partner_tax_id, concat('Khách ', CAST(o_custkey AS STRING)) AS partner_name,
  CAST(s.amt + CASE o_orderkey % 20 WHEN 1 THEN 5 WHEN 2 THEN 1000 ELSE 0 END AS DECIMAL(18,2)) AS pretax_amount,
  CAST(round(s.amt * 0.1, 0) AS DECIMAL(18,2)) AS vat_amount,
  CAST(s.amt + CASE o_orderkey % 20 WHEN 1 THEN 5 WHEN 2 THEN 1000 ELSE 0 END + round(s.amt * 0.1, 0) AS DECIMAL(18,2)) AS total_amount
FROM {{orders}} JOIN (SELECT k, sum(amt) AS amt FROM ({LINES}) l GROUP BY k) s ON o_orderkey = s.k
WHERE o_orderkey % 20 <> 8
"""

LEDGER = f"""
SELECT concat('led_', CAST(l.pos + t.twice AS STRING)) AS id, l.pos + t.twice AS pos,
  CASE WHEN k % 20 <> 5 THEN CAST(k AS STRING) END AS doc_no, CASE WHEN k % 20 = 4 THEN '1C26TBB' ELSE '1C26TAA' END AS series,
  CAST(CAST(CASE WHEN k % 20 = 3 THEN o_orderdate + INTERVAL 10 DAY ELSE o_orderdate END AS DATE) AS STRING) AS date,
  lpad(CAST(CASE WHEN k % 20 = 6 THEN o_custkey + 500000 ELSE o_custkey END AS STRING), 10, '0') AS partner_tax_id,
  CAST(amt AS DECIMAL(18,2)) AS credit_amount, CAST(amt AS DECIMAL(18,2)) AS total_amount
FROM ({LINES}) l JOIN {{orders}} ON o_orderkey = k
JOIN (SELECT 0 AS twice UNION ALL SELECT 1 AS twice) t ON t.twice = 0 OR (k % 20 = 7 AND n_lines = 1)
WHERE k % 20 <> 0
"""

#: A ledger of the bank account and the bank's statement, from events: side by parity, perturbed by event_id modulo 12.
BOOK_112 = """
SELECT concat('b112_', CAST(event_id AS STRING)) AS id, CAST(event_id AS BIGINT) AS pos, CAST(CAST(ts AS DATE) AS STRING) AS date,
  CASE WHEN event_id % 4 = 1 THEN CAST(value * 1000 + event_id * 7919 AS DECIMAL(18,0)) END AS debit_amount,
  CASE WHEN event_id % 4 = 3 THEN CAST(value * 1000 + event_id * 7919 AS DECIMAL(18,0)) END AS credit_amount,
  CASE WHEN event_id % 12 NOT IN (5, 7) THEN concat('REF-', CAST(event_id AS STRING)) END AS voucher_no,
  CASE WHEN event_id % 12 = 7 THEN concat('đối tác ', CAST(user_id AS STRING)) END AS partner_name,
  concat('chuyển khoản ', CAST(event_id AS STRING)) AS description, CAST(0 AS DECIMAL(18,2)) AS total_amount
FROM {events} WHERE event_id % 2 = 1
"""

STATEMENT = """
SELECT concat('bank_', CAST(event_id * 2 + twice AS STRING)) AS id, CAST(event_id * 2 + twice AS BIGINT) AS pos, CAST(CAST(CASE WHEN event_id % 12 = 9 THEN ts + INTERVAL 9 DAY ELSE ts END AS DATE) AS STRING) AS date,
  CASE WHEN (event_id % 4 = 3) <> (event_id % 12 = 3) THEN CAST(value * 1000 + event_id * 7919 AS DECIMAL(18,0)) END AS debit_amount,
  CASE WHEN (event_id % 4 = 1) <> (event_id % 12 = 3) THEN CAST(value * 1000 + event_id * 7919 AS DECIMAL(18,0)) END AS credit_amount,
  CASE WHEN event_id % 12 NOT IN (5, 7) THEN concat('ref', CAST(event_id AS STRING)) END AS transaction_number,
  CASE WHEN event_id % 12 = 7 THEN concat('Đối tác ', CAST(user_id AS STRING)) END AS counterparty_name,
  CASE WHEN event_id % 12 = 5 THEN 'khác' ELSE concat('Chuyển khoản ', CAST(event_id AS STRING)) END AS description, CAST(0 AS DECIMAL(18,2)) AS total_amount
FROM {events} JOIN (SELECT 0 AS twice UNION ALL SELECT 1 AS twice) t ON twice = 0 OR event_id % 12 = 11
WHERE event_id % 2 = 1 AND event_id % 24 <> 1
"""

TABLES = ("orders", "lineitem", "events", "customer", "part", "documents")


def spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def duck_sql(text: str) -> str:
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text
