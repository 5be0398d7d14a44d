"""Reference controls: partner masters, identities across sources, and the layers of a sales analysis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.model import Source
from ledgerloom.session import materialise

# Kinds of sources whose partners are held against a partner master.
IDENTITY_KINDS = ("e_invoice", "sales_register", "ledger511", "ledger112", "ledger131", "ledger133", "ledger3331")
MEASURES = ("revenue", "vat", "receivable", "cost", "profit")


def duplicate_tax_ids(masters: DataFrame) -> DataFrame:
    """partner_tax_id, n of tax numbers that several master rows share."""
    return masters.where("partner_tax_id <> ''").groupBy("partner_tax_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def partner_master_control(masters: DataFrame) -> DataFrame:
    """record_count, duplicates, status."""
    dup = duplicate_tax_ids(masters).agg(F.count(F.lit(1)).alias("duplicates"))
    return masters.agg(F.count(F.lit(1)).alias("record_count")).join(dup).withColumn("status", F.when(F.col("duplicates") > 0, "NEEDS_REVIEW").otherwise("MATCHED_EXACT"))


def identities(records: DataFrame, masters: DataFrame) -> DataFrame:
    """id, resolution (UNIQUE, AMBIGUOUS, NOT_FOUND) and how many master rows there are: by tax number if there is one,
    else by code; never by name. Masters are counted by key first, so each record meets one row."""
    by = lambda c: masters.where(f"{c} <> ''").groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    has_tax = F.coalesce(F.col("partner_tax_id"), F.lit("")) != ""
    keyed = records.select("id", has_tax.alias("by_tax"), F.when(has_tax, F.regexp_replace("partner_tax_id", "[^0-9-]", "")).otherwise(F.nullif(F.col("partner_code"), F.lit(""))).alias("key"))
    found = keyed.where("by_tax").join(by("partner_tax_id"), "key", "left").unionByName(keyed.where("NOT by_tax").join(by("partner_code"), "key", "left"))
    n = F.coalesce("n", F.lit(0))
    return found.select("id", n.alias("n"), F.when(n == 1, "UNIQUE").when(n > 1, "AMBIGUOUS").otherwise("NOT_FOUND").alias("resolution"))


def identity_control(records: DataFrame, masters: DataFrame, sources: Sequence[Source] | None = None) -> DataFrame:
    """record_count, unresolved, status; with a session's sources, of the records of those kinds alone that it holds."""
    if sources is not None:
        records = records.where(F.col("source_id").isin(*[s.id for s in sources if s.kind in IDENTITY_KINDS]))
    r = identities(records, masters).agg(F.count(F.lit(1)).alias("record_count"), F.count_if(F.col("resolution") != "UNIQUE").alias("unresolved"))
    return r.withColumn("status", F.when(F.col("unresolved") == 0, "MATCHED_EXACT").otherwise("NEEDS_REVIEW"))


def level_totals(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("row_level").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES])


def sales_layer_control(analysis: DataFrame) -> DataFrame:
    """One row: the detail layer's totals and a code; null totals wherever the layers don't prove each other."""
    level = lambda lv, m: F.coalesce(F.sum(F.when(F.col("row_level") == lv, F.col(m))), F.lit(0)).alias(f"{lv[0].lower()}_{m}")
    one = analysis.agg(F.count_if(F.col("row_level") == "NEEDS_REVIEW").alias("unclear"), *[level(lv, m) for lv in ("GROUP", "DETAIL") for m in MEASURES])
    equal = reduce(lambda a, b: a & b, [F.col(f"g_{m}") == F.col(f"d_{m}") for m in MEASURES])
    code = F.when(F.col("unclear") > 0, "SALES_ANALYSIS_HIERARCHY_NEEDS_REVIEW").when((F.col("g_revenue") == 0) | (F.col("d_revenue") == 0), "SALES_ANALYSIS_LAYER_MISSING").when(~equal, "SALES_ANALYSIS_GROUP_DETAIL_MISMATCH").otherwise("OK")
    return one.withColumn("code", code).select("code", *[F.when(F.col("code") == "OK", F.col(f"d_{m}")).alias(m) for m in MEASURES])


def running_balance_breaks(entries: DataFrame) -> DataFrame:
    """account, id, off of rows whose balance isn't the one before it plus debit less credit.

    Rows are dealt by ranges of account and place, so that a large account is spread over tasks; each range takes over the
    account's last balance of the range before. Rows of one place go by id.
    """
    stated = entries.where("balance IS NOT NULL").select("account", "pos", "id", "balance", "debit_amount", "credit_amount")
    ranged = materialise(stated.repartitionByRange("account", "pos", "id").withColumn("part", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("account", "part").agg(F.max_by("balance", F.struct("pos", "id")).alias("last"))  # a row a range, and one an account
    carried = ends.select("account", "part", F.lag("last").over(Window.partitionBy("account").orderBy("part")).alias("carried"))
    within = F.lag("balance").over(Window.partitionBy("account", "part").orderBy("pos", "id"))
    rows, moved = ranged.withColumn("before", within).alias("r"), F.coalesce("debit_amount", F.lit(0)) - F.coalesce("credit_amount", F.lit(0))
    joined = rows.join(carried.alias("c"), F.col("r.account").eqNullSafe(F.col("c.account")) & (F.col("r.part") == F.col("c.part")))
    checked = joined.withColumn("off", F.col("balance") - F.coalesce("before", "carried") - moved)
    return checked.where("off <> 0").select("r.account", "id", "off")


def closing_balances(entries: DataFrame, opening: DataFrame) -> DataFrame:
    """account, closing, stated, off: opening balance plus debits less credits against the last balance that is stated."""
    moved = F.coalesce("debit_amount", F.lit(0)) - F.coalesce("credit_amount", F.lit(0))
    sums = entries.groupBy("account").agg(F.sum(moved).alias("moved"), F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("pos"))).alias("stated"))
    closing = F.coalesce("opening", F.lit(0)) + F.col("moved")
    return sums.join(opening.select("account", "opening"), "account", "left").select("account", closing.alias("closing"), "stated", (F.col("stated") - closing).alias("off"))


def reference_summary(control: DataFrame) -> DataFrame:
    """A result's summary for one reference control (a row record_count, status): exactly one row is asked for."""
    n = lambda *s: F.col("status").isin(*s).cast("bigint")
    known = ("MATCHED_EXACT", "AMBIGUOUS_MATCH", "MISMATCH_AMOUNT", "MISMATCH_METADATA")
    one = control.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # a control is one row
    asked = F.when(F.col("rows") == 1, F.col("record_count")).otherwise(F.raise_error(F.lit("REFERENCE_CONTROL: one source and one control are needed")).cast("bigint"))
    return one.select(asked.alias("total_source_records"), n(known[0]).alias("exact_matches_count"), n(known[1]).alias("ambiguous_count"), n(*known[2:]).alias("mismatches_count"), (~F.col("status").isin(*known)).cast("bigint").alias("needs_review_count"))


def duplicate_suspects(records: DataFrame) -> DataFrame:
    """An extension: ids of rows that share source, series, number, date and total with another one."""
    keys = ["source_id", "series", "doc_no", "date", "total_amount"]
    many = records.where("doc_no IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys])
    return records.alias("r").join(many.alias("m"), same).select("r.id", "m.n")
