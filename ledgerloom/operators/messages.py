"""Texts that explain differences: of pairs of records, of report rows, of groups. All are Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.plans.model import ACCEPTED, MONEY

# The texts, as reports show them; %s are filled in order.
ROUNDING = "Chênh lệch làm tròn số tiền %s đ (trong ngưỡng dung sai <= %s đ)"
AMOUNT = "Lệch số tiền đối chiếu: Nguồn A (%s) đ vs Nguồn B (%s) đ, chênh lệch %s đ"
TAX = "Khác mã số thuế: Nguồn A [%s] vs Nguồn B [%s]"
DATE = "Lệch ngày lập/chứng từ: %s ngày (vượt ngưỡng cho phép %s ngày)"
NOT_FOUND = "Chứng từ #%s không tìm thấy trong nguồn %s"
NOT_FOUND_OF_THREE = "HIGH: chứng từ #%s không tìm thấy trong nguồn %s của kiểm soát ba nguồn"
SERIES = "%s (Ký hiệu %s)"
PRIMARY_BARE = "Bản ghi nguồn chính thiếu cả số chứng từ và MST - không đủ dữ kiện để đối chiếu tự động"
PRIMARY_LOST = "Chứng từ %s không tìm thấy bản ghi tương ứng trong các nguồn đối chiếu"
PRIMARY_FIELD = "Nguồn chính thiếu giá trị trường '%s' được định nghĩa trong quy tắc '%s'"
PRIMARY_RULE = "Quy tắc '%s' chứa trường '%s' không được hỗ trợ"
ONLY_SECONDARY = "Chứng từ #%s (%s) đ tồn tại trong %s nhưng không có trong nguồn chính"
SECONDARY_FIELD = "Bản ghi phụ thiếu giá trị trường '%s' theo quy tắc '%s'"
SECONDARY_RULE = "Quy tắc '%s' chứa trường phụ '%s' không được hỗ trợ"
NO_RULE = "Không tìm thấy quy tắc đối chiếu cho nguồn phụ '%s' (UNSUPPORTED_RECONCILIATION_RULE)"
NO_NUMBER = "N/A"
MISSING = "Thiếu %s: %s"
MISSING_SOURCE = "Chứng từ phát sinh bên đối chiếu nhưng thiếu bên nguồn chính (%s)."
DUPLICATE = "Nghi ngờ trùng lặp chứng từ trong nguồn dữ liệu."
AMBIGUOUS = "Nhiều chứng từ tiềm năng thỏa mãn điều kiện đối chiếu, cần kiểm tra thủ công."
REVIEW = "Cần rà soát chứng từ"
ALL_MATCHED = "✓ Khớp hoàn toàn tất cả các tiêu chí đã đối chiếu"
UNCHECKED = "%s chưa đối chiếu"
OTHER_SOURCE, MATCHED, PLAIN_MATCH, DONE, AND = "nguồn đối chiếu", "%s khớp", "Khớp", "Đã xử lý", " và "

DISCREPANCY = f"struct<field_name:string,source_value:string,target_value:string,amount_diff:{MONEY},message:string>"


def _text(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *[v.cast("string") for v in values])


def amount_message(a: Column, b: Column, tolerance: Column) -> Column:
    diff = F.abs(a - b)
    vnd = S.grouped_amount
    return F.when(diff == 0, F.lit(None)).when(diff <= tolerance, _text(ROUNDING, vnd(diff), vnd(tolerance))).otherwise(_text(AMOUNT, vnd(a), vnd(b), vnd(diff)))


def date_message(a: Column, b: Column, days: Column) -> Column:
    return _text(DATE, S.days_between(a, b), days)


def pair_discrepancies(amounts: tuple[Column, Column], taxes: tuple[Column, Column], dates: tuple[Column, Column], tolerance: Column, days: Column) -> Column:
    """array<DISCREPANCY> of a pair: amounts that differ, tax numbers that differ as written, dates too far apart."""
    (a, b), (ta, tb), (da, db) = amounts, taxes, dates
    none = F.lit(None)

    def one(name: str, x: Column, y: Column, diff: Column, message: Column) -> Column:
        return F.struct(F.lit(name).alias("field_name"), x.cast("string").alias("source_value"), y.cast("string").alias("target_value"), diff.cast(MONEY).alias("amount_diff"), message.alias("message"))

    money = F.when(a != b, one("amount", S.grouped_amount(a), S.grouped_amount(b), F.abs(a - b), amount_message(a, b, tolerance)))
    tax = F.when((ta != tb) & (ta != "") & (tb != ""), one("partnerTaxId", ta, tb, none, _text(TAX, ta, tb)))
    date = F.when(S.days_between(da, db) > days, one("date", da, db, none, date_message(da, db, days)))
    return F.array_compact(F.array(money, tax, date))


def of_detail(field: Column, source: Column, target: Column, tolerance: Column, days: Column) -> Column:
    """The message of a discrepancy row of the matcher; null for its codes."""
    a, b = source.try_cast(MONEY), target.try_cast(MONEY)
    some = source.isNotNull() & target.isNotNull()
    return F.when((field == "amount") & some, amount_message(a, b, tolerance)).when((field == "partnerTaxId") & some, _text(TAX, source, target)).when((field == "date") & some, date_message(source, target, days))


def left_over(number: Column, bare: Column) -> Column:
    """A primary that no pass has placed; bare: it has neither a number nor a tax number."""
    return F.when(bare, F.lit(PRIMARY_BARE)).otherwise(_text(PRIMARY_LOST, F.coalesce(number, F.lit(NO_NUMBER))))


def field_error(error: Column, missing: str, unknown: str, field: str, rule: str) -> Column:
    """A rule's field that a record lacks, or that isn't known; null without an error. The patterns have %s for both, in their own order."""
    return F.when(error == "FIELD_VALUE_MISSING", F.lit(missing % (field, rule))).when(error == "UNSUPPORTED_RULE_FIELD", F.lit(unknown % (rule, field)))


def only_secondary(number: Column, amount: Column, source: str) -> Column:
    return _text(ONLY_SECONDARY, F.coalesce(number, F.lit(NO_NUMBER)), S.grouped_amount(amount), F.lit(source))


def not_found(number: Column, source: Column, of_three: bool) -> Column:
    """A document that a secondary source lacks; marked HIGH where invoice, register and ledger are held together. Null without a number."""
    return F.when(number.isNotNull(), _text(NOT_FOUND_OF_THREE if of_three else NOT_FOUND, number, source))


def with_series(number: Column, series: Column) -> Column:
    return F.when(number.isNotNull(), _text(SERIES, number, F.coalesce(series, F.lit(""))))


def reason(messages: Column, status_name: Column) -> Column:
    """A report row's reason: its messages, or else what the status is called."""
    return F.coalesce(F.nullif(F.array_join(messages, "; "), F.lit("")), status_name)


def comparison_label(name: Column, semantic: Column, source: Column) -> Column:
    return F.concat(F.coalesce(S.blank_to_null(name), semantic), F.lit(" ↔ "), source)


def detail_reason(status: Column, messages: Column, comparisons: Column, source_total: Column, target_total: Column) -> Column:
    """What a group's row says. comparisons: array of structs status, label, expected; messages: array of strings."""
    open_ones = F.array_distinct(F.transform(F.filter(comparisons, lambda c: c["status"] == "NOT_CHECKED"), lambda c: c["label"]))
    checked = F.filter(comparisons, lambda c: c["status"] != "NOT_CHECKED")
    rest = F.when(F.size(open_ones) > 0, _text(UNCHECKED, F.array_join(open_ones, AND)))
    ended = lambda x: F.concat(x, F.coalesce(F.concat(F.lit("; "), rest), F.lit("")), F.lit("."))
    lacking = F.get(F.filter(comparisons, lambda c: c["status"] == "UNMATCHED_MISSING_IN_TARGET"), F.lit(0))
    missing = ended(_text(MISSING, F.coalesce(lacking["label"], F.lit(OTHER_SOURCE)), S.grouped_amount_local(F.coalesce(lacking["expected"], source_total))))
    said = F.array_join(messages, " • ")
    fits = F.transform(checked, lambda c: F.concat(c["label"], F.lit(" khớp")))
    prefix = F.coalesce(F.nullif(F.array_join(fits, ", "), F.lit("")), F.lit(PLAIN_MATCH))
    return (
        F.when(status == "UNMATCHED_MISSING_IN_TARGET", missing)
        .when(F.size(messages) > 0, F.when(rest.isNotNull(), ended(said)).otherwise(said))
        .when(status == "UNMATCHED_MISSING_IN_SOURCE", _text(MISSING_SOURCE, S.grouped_amount_local(target_total)))
        .when(status == "DUPLICATE_SUSPECT", F.lit(DUPLICATE))
        .when(status == "AMBIGUOUS_MATCH", F.lit(AMBIGUOUS))
        .when(status == "NEEDS_REVIEW", ended(F.lit(REVIEW)))
        .when(status.isin(*ACCEPTED), F.when((F.size(open_ones) == 0) & (F.size(checked) > 0), F.lit(ALL_MATCHED)).otherwise(ended(prefix)))
        .otherwise(ended(F.lit(DONE)))
    )


def by_control(control: Column, values: list[Column]) -> Column:
    """The value of a row's control, by its number."""
    return reduce(lambda w, i: w.when(control == i, values[i]), range(len(values)), F.when(F.lit(False), F.lit(None)))
