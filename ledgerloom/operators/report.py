"""Report rows, searches, pages and nested documents from the matcher's flat frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import messages
from ledgerloom.operators.matching import Frames
from ledgerloom.operators.ordering import number_rows

# Display names of statuses.
STATUS_NAMES = {"MATCHED_EXACT": "Khớp hoàn toàn", "MATCHED_WITH_TOLERANCE": "Khớp có dung sai", "MATCHED_AGGREGATE": "Khớp gộp", "MATCHED_WITH_MISSING_SOURCE": "Khớp, thiếu nguồn phụ", "MISMATCH_AMOUNT": "Lệch số tiền", "MISMATCH_METADATA": "Lệch thông tin", "UNMATCHED_MISSING_IN_TARGET": "Thiếu bên đối chiếu", "UNMATCHED_MISSING_IN_SOURCE": "Thiếu bên nguồn chính", "DUPLICATE_SUSPECT": "Nghi trùng lặp", "AMBIGUOUS_MATCH": "Cần kiểm tra (nhiều khả năng)", "NEEDS_REVIEW": "Cần kiểm tra", "NOT_CHECKED": "Chưa kiểm tra"}


def _names(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_NAMES.items() for x in kv]), status)


def report_rows(frames: Frames, only_differences: bool = False) -> DataFrame:
    """A row per group and control, or one per group without any, in report order by number (stt)."""
    g, c = frames.groups, frames.comparisons
    if only_differences:
        g, c = g.where("status <> 'MATCHED_EXACT'"), c.where("status <> 'MATCHED_EXACT'")
    said = frames.discrepancies.where("message IS NOT NULL").groupBy("group_id").agg(F.array_sort(F.collect_set(F.struct("control", "field_name", "message"))).alias("said"))
    c = c.select("group_id", "control", F.col("source_id").alias("compared_with"), "semantic", "expected", "actual", "variance", F.col("status").alias("control_status"))
    # what is said comes by group, so that all three meet by the group alone and no joined row is shuffled again
    own = F.filter("said", lambda d: d["control"] == F.coalesce("control", F.lit(-1)))
    flat = g.join(c, "group_id", "left").join(said, "group_id", "left").withColumn("messages", F.transform(own, lambda d: d["message"]))
    rows = flat.select(
        "group_id", "control", "date", "doc_no", "series", "partner_name", "compared_with", "semantic",
        F.coalesce("expected", "total_source_amount").alias("expected"), F.coalesce("actual", "total_target_amount").alias("actual"), F.coalesce("variance", "amount_variance").alias("variance"),
        "status", F.coalesce("control_status", "status").alias("row_status"), messages.reason(F.col("messages"), _names(F.coalesce("control_status", "status"))).alias("reason"),
    )
    return rows


# Titles of a report sheet's columns.
REPORT_TITLES = {"stt": "STT", "doc_no": "Số chứng từ", "series": "Ký hiệu", "date": "Ngày", "semantic": "Loại đối chiếu", "primary_name": "Nguồn tham chiếu", "compared_with": "Nguồn đối chiếu", "expected": "Giá trị kỳ vọng", "actual": "Giá trị thực tế", "variance": "Chênh lệch", "row_status": "Trạng thái", "reason": "Lý do & Chi tiết sai lệch"}


def report_sheet(frames: Frames, only_differences: bool = False, primary_name: str = "") -> DataFrame:
    """report_rows, numbered in report order, with the columns and titles of a sheet."""
    rows = number_rows(report_rows(frames, only_differences), report_order(), "stt")
    cells = {"doc_no": F.coalesce("doc_no", F.lit("N/A")), "series": F.coalesce("series", F.lit("")), "date": F.coalesce("date", F.lit("")), "primary_name": F.lit(primary_name), "row_status": _names(F.col("row_status"))}
    return rows.select(*[cells.get(c, F.col(c) if c in rows.columns else F.lit("")).alias(title) for c, title in REPORT_TITLES.items()]).orderBy("STT")


# The cards of the overview, by status.
CARDS = (("ALL", None), ("MATCHED_EXACT", "exact_matches_count"), ("MATCHED_WITH_TOLERANCE", "tolerance_matches_count"), ("MATCHED_AGGREGATE", "aggregate_matches_count"), ("MISMATCH_AMOUNT", "mismatches_count"), ("UNMATCHED_MISSING_IN_TARGET", "missing_in_target_count"), ("UNMATCHED_MISSING_IN_SOURCE", "missing_in_source_count"), ("DUPLICATE_SUSPECT", "duplicates_count"), ("AMBIGUOUS_MATCH", "ambiguous_count"), ("NEEDS_REVIEW", "needs_review_count"))


def cards(summary: DataFrame) -> DataFrame:
    """card, value: the overview's counts; the one of reviews only where there are any."""
    every = F.col("total_source_records") + F.col("total_target_records")
    rows = F.array(*[F.struct(F.lit(k).alias("card"), (every if c is None else F.col(c)).cast("bigint").alias("value")) for k, c in CARDS])
    return summary.select(F.explode(rows).alias("r")).select("r.*").where("card <> 'NEEDS_REVIEW' OR value > 0")


def checked_variances(summary: DataFrame, semantics: list[str]) -> DataFrame:
    """semantic, variance: null for a semantic that wasn't checked."""
    named = {"REVENUE": "revenue_variance", "VAT": "vat_variance", "RECEIVABLE": "receivable_variance"}
    rows = F.array(*[F.struct(F.lit(k).alias("semantic"), F.when(F.lit(k in semantics), F.col(c)).alias("variance")) for k, c in named.items()])
    return summary.select(F.explode(rows).alias("r")).select("r.*")


def detail_reasons(frames: Frames, names: dict[str, str]) -> DataFrame:
    """group_id, reason: what a group's row says; names are the secondary sources' titles by id."""
    title = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("source_id")), F.col("source_id"))
    label = messages.comparison_label(F.lit(None).cast("string"), F.col("semantic"), title)
    item = F.struct("control", "status", label.alias("label"), "expected")
    compared = frames.comparisons.groupBy("group_id").agg(F.array_sort(F.collect_list(item)).alias("comparisons"))
    said = frames.discrepancies.where("message IS NOT NULL").groupBy("group_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("control", "field_name", "message"))), lambda d: d["message"]).alias("messages"))
    joined = frames.groups.join(compared, "group_id", "left").join(said, "group_id", "left")
    none = F.array().cast(dict(compared.dtypes)["comparisons"])
    return joined.select("group_id", messages.detail_reason(F.col("status"), F.coalesce("messages", F.array().cast("array<string>")), F.coalesce("comparisons", none), F.col("total_source_amount"), F.col("total_target_amount")).alias("reason"))


def named(column: Column, names: dict[str, str]) -> Column:
    """What a kind, role, semantic or status is called; itself where it has no name."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), column), column)


def variance_rollup(frames: Frames) -> DataFrame:
    """An extension: counts and variances by source, semantic and status, with totals above each level.

    level is 0 for all three, 1 by source and semantic, 3 by source, 7 for everything: a bit for each column summed over.
    """
    c = frames.comparisons.rollup("source_id", "semantic", "status").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.sum("variance").alias("variance"), F.sum(F.abs("variance")).alias("gross"))
    return c.select("source_id", "semantic", "status", F.col("level").cast("int").alias("level"), "n", *[F.coalesce(x, F.lit(0)).cast("decimal(38,6)").alias(x) for x in ("variance", "gross")])


def control_totals(records: DataFrame, columns: tuple[str, ...] = ("pretax_amount", "credit_amount")) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns if c in records.columns])


def report_order() -> list[Column]:
    return [F.coalesce("date", F.lit("")), F.coalesce("doc_no", F.lit("")), F.coalesce("series", F.lit("")), F.col("group_id"), F.coalesce("control", F.lit(-1))]


def search(groups: DataFrame, status: str | None = None, text: str = "", discrepancies: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Groups of a status whose id, number, series, date, partner or records contain the text, case aside; with the matcher's
    other frames, also those whose discrepancies or linked records do."""
    out = groups.where(F.col("status") == status) if status else groups
    if not text.strip():
        return out
    sought = F.lit(text.strip().lower())

    def hit(*columns: str) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), sought), F.lit(False)) for c in columns])

    own = hit("group_id", "doc_no", "series", "date", "partner_name", "primary_id", "secondary_id")
    others = [df.where(hit(*columns)).select("group_id") for df, columns in ((discrepancies, ("message", "source_value", "target_value")), (links, ("s_id",))) if df is not None]
    if not others:
        return out.where(own)
    return out.join(reduce(DataFrame.unionByName, others, out.where(own).select("group_id")), "group_id", "left_semi")


def pages(df: DataFrame, size: int = 50) -> int:
    """How many pages there are; none is one empty page."""
    return max(1, -(-df.count() // size))


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """The number-th page (from 1) of a total order; a number beyond the ends gives the first or the last page."""
    at = 1 if number <= 1 else min(number, pages(df, size))
    return df.orderBy(*order).offset((at - 1) * size).limit(size)


def page_rows(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """page() with row_index, the row's place in the whole order from 1; a page is small, so one window numbers it."""
    number = max(1, min(number, pages(df, size)))
    at = F.row_number().over(Window.orderBy(*order)) + (number - 1) * size
    return page(df, order, number, size).withColumn("row_index", at)


# The overview's titles.
SUMMARY_ROWS = (("Tổng số dòng Nguồn chính", "total_source_records"), ("Tổng số dòng Nguồn đối chiếu", "total_target_records"), ("Số nhóm Khớp hoàn toàn (100%)", "exact_matches_count"), ("Số nhóm Khớp có dung sai", "tolerance_matches_count"), ("Số nhóm Khớp gộp (1-N / N-1)", "aggregate_matches_count"), ("Số nhóm Sai lệch số tiền / thuế", "mismatches_count"), ("Số chứng từ Thiếu bên đối chiếu", "missing_in_target_count"), ("Số chứng từ Thiếu bên nguồn chính", "missing_in_source_count"), ("Số bản ghi Trùng lặp", "duplicates_count"), ("Số nhóm Cần kiểm tra lại (Ambiguous)", "ambiguous_count"), ("Chênh lệch Doanh thu (VND)", "revenue_variance"), ("Chênh lệch Thuế GTGT (VND)", "vat_variance"), ("Chênh lệch Công nợ phải thu (VND)", "receivable_variance"), ("Tổng quy mô sai lệch tuyệt đối (VND)", "total_discrepant_amount"))


def summary_sheet(frames: Frames) -> DataFrame:
    """The report's first sheet: metric, value as text."""
    pairs = [F.struct(F.lit(i).alias("ord"), F.lit(title).alias("metric"), F.col(c).cast("string").alias("value")) for i, (title, c) in enumerate(SUMMARY_ROWS)]
    return frames.summary.select(F.explode(F.array(*pairs)).alias("m")).select("m.*")
