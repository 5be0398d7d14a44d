"""Scalar cleaning and comparison rules as Column expressions, on the JVM; those with lambdas are interpreted, not generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,6)"

# Vietnamese letters and their plain forms.
MARKED = "àáạảãâầấậẩẫăằắặẳẵ" + "èéẹẻẽêềếệểễ" + "ìíịỉĩ" + "òóọỏõôồốộổỗơờớợởỡ" + "ùúụủũưừứựửữ" + "ỳýỵỷỹ" + "đ"
PLAIN = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"

# Texts that stand for no amount, and currency marks.
NO_AMOUNT = ("", "-", "N/A", "null", "nil")
CURRENCY = "₫|VND|VNĐ|vnd|usd|USD|đồng"

# Titles of summary rows, in plain letters, and words that mark a company's name.
SUMMARY_TITLES = ("cong", "tong cong", "tong", "tong so", "total", "grand total", "subtotal", "so du dau ky", "phat sinh trong ky", "so phat sinh trong ky", "so du cuoi ky", "cong phat sinh", "tong phat sinh", "cong thang", "cong quy", "cong nam", "luy ke", "so luy ke", "nguoi lap", "nguoi lap bieu", "ke toan truong", "giam doc", "thu truong", "don vi bao cao", "ky tinh thue", "bang ke hoa don", "so chi tiet", "so nhat ky")
COMPANY_WORDS = ("cong ty", "doanh nghiep", "chi nhanh", "hop tac xa")


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def doc_number(x: Column) -> Column:
    """Key of a document number: a tail of '.000' goes, leading zeros of all-digit numbers go."""
    t = F.trim(x)
    cut = F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"^([^.]*)\.0*$", "$1")).otherwise(t)
    stripped = F.coalesce(F.nullif(F.ltrim(cut, F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(t == "", F.lit("")).when(cut.rlike("^[0-9]*$"), stripped).otherwise(cut)


def tax_number(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9-]", "")


def plain_letters(x: Column) -> Column:
    return F.translate(F.lower(x), MARKED, PLAIN)


def token(x: Column) -> Column:
    """Plain letters, digits and blanks, for matching titles."""
    return F.trim(F.regexp_replace(plain_letters(x), r"[^\p{L}\p{N}\s]", ""))


def bank_key(x: Column) -> Column:
    """Letters and digits only, accents kept."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once, so that nested cases don't multiply the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def amount(x: Column) -> Column:
    """Money text of mixed conventions as a decimal, or null."""

    def number(body: Column) -> Column:
        drop = lambda sep: F.replace(body, F.lit(sep), F.lit(""))
        text = (
            F.when(body.rlike(r",.*\.[^,]*$"), drop(","))  # both separators, the last one is the decimal point
            .when(body.rlike(r"\..*,[^.]*$"), F.replace(drop("."), F.lit(","), F.lit(".")))
            .when(body.rlike(r"^[^,]*,([^,]{0,2}|[^,]{4,})$"), F.replace(body, F.lit(","), F.lit(".")))  # one, not before three digits
            .when(body.rlike(r"^[^.]*\.([^.]{0,2}|[^.]{4,})$"), body)
            .otherwise(F.translate(body, ",.", ""))
        )
        return _let(text, lambda t: F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), t.try_cast(MONEY)))

    def signed(bare: Column) -> Column:
        negative = bare.rlike(r"^\(.*\)$|^-|-$")
        body = F.trim(F.regexp_replace(bare, r"^\((.*)\)$|^-(.*)$|^(.*)-$", "$1$2$3"))
        return _let(_let(body, number), lambda n: F.when(negative, -F.abs(n)).otherwise(n))

    t = F.trim(x)
    bare = F.trim(F.regexp_replace(t, f"{CURRENCY}|[ \u00a0]", ""))
    return F.when(t.isin(*NO_AMOUNT), F.lit(None).cast(MONEY)).otherwise(_let(bare, signed)).cast(MONEY)


def date_text(x: Column) -> Column:
    """ISO date of a serial number or of day-month-year or year-month-day text; anything else trimmed."""

    def parsed(t: Column, first: Column) -> Column:
        sep = F.when(F.instr(first, "/") > 0, "/").when(F.instr(first, "-") > 0, "-").otherwise(".")
        digits = F.replace(first, sep, F.lit("")).rlike("^[0-9]+$")

        def iso(parts: Column) -> Column:
            p = lambda i: F.get(parts, F.lit(i))
            clean, short = (F.size(parts) == 3) & digits, lambda i: F.length(p(i)).between(1, 2)
            ymd = F.concat_ws("-", p(0), F.lpad(p(1), 2, "0"), F.lpad(p(2), 2, "0"))
            dmy = F.concat_ws("-", p(2), F.lpad(p(1), 2, "0"), F.lpad(p(0), 2, "0"))
            return F.when(clean & (F.length(p(0)) == 4) & short(1) & short(2), ymd).when(clean & (F.length(p(2)) == 4) & short(1) & short(0), dmy)

        text = _let(F.split(F.translate(first, "/-.", "   "), " "), iso)
        return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"), t)

    def either(t: Column) -> Column:
        number = t.try_cast("double")
        serial = F.date_add(F.to_date(F.lit("1899-12-30")), F.floor(number).cast("int"))
        return F.when((number > 1000) & (number < 100000), F.date_format(serial, "yyyy-MM-dd")).otherwise(_let(F.substring_index(t, " ", 1), lambda first: parsed(t, first)))

    return _let(F.trim(x), either)


def as_date(x: Column) -> Column:
    """The date of year-month-day text; null for any other. Ten characters of that form need no pattern's parser."""
    t = F.trim(x)
    return F.when(t.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), t.try_cast("date")).otherwise(F.try_to_date(t, "yyyy-M-d"))


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(as_date(a), as_date(b)))


def near_days(a: Column, b: Column, days: int | Column, on_null: bool) -> Column:
    """|a - b| <= days of two dates; on_null where either is missing."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(on_null))


def within_days(a: Column, b: Column, days: int | Column, on_null: bool) -> Column:
    """|a - b| <= days; on_null where either date is missing or isn't one."""
    return near_days(as_date(a), as_date(b), days, on_null)


def same_counterparty(a: Column, b: Column) -> Column:
    """Equal tax numbers; a missing one is no objection."""
    return F.coalesce(F.nullif(tax_number(a), F.lit("")) == F.nullif(tax_number(b), F.lit("")), F.lit(True))


def is_summary_title(x: Column) -> Column:
    return _is_summary(token(x))


def _is_summary(t: Column) -> Column:
    company = F.lit(False)
    for w in COMPANY_WORDS:
        company = company | t.contains(w)
    return ~company & (t.isin(*SUMMARY_TITLES) | t.startswith("ngay    thang"))


def is_garbage_row(cells: Column) -> Column:
    """Nothing but blanks, or a summary title in any cell."""
    filled = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
    return _let(filled, lambda f: (F.size(f) == 0) | F.exists(F.transform(f, token), _is_summary))  # each title is reduced once


def yes_no(x: Column) -> Column:
    t = token(x)
    return F.when(t.isin("1", "x", "yes", "true", "co"), True).when(t.isin("0", "no", "false", "khong"), False)


def lifecycle(x: Column) -> Column:
    """Kind of an invoice by its status text; a blank one is unknown."""
    t = plain_letters(F.trim(x))
    regular = t.contains("moi") | t.contains("goc") | t.contains("hop le") | t.contains("da cap ma") | t.contains("con hieu luc")
    return F.when(t.contains("dieu chinh"), "ADJUSTED").when(t.contains("thay the"), "REPLACED").when(t.contains("huy"), "CANCELLED").when(regular, "STANDARD").otherwise("UNKNOWN")


def money_direction(kind: str | Column, debit: Column, credit: Column) -> Column:
    """IN or OUT of the bank account: a ledger books receipts as debits, the bank's own statement as credits."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    d, c = F.coalesce(debit, F.lit(0)) != 0, F.coalesce(credit, F.lit(0)) != 0
    side = F.when(d & ~c, "D").when(c & ~d, "C")
    ledger = F.when(side == "D", "IN").when(side == "C", "OUT")
    bank = F.when(side == "C", "IN").when(side == "D", "OUT")
    return F.coalesce(F.when(kind == "ledger112", ledger).when(kind == "bank_statement", bank), F.lit("UNKNOWN"))


def directional_amount(debit: Column, credit: Column) -> Column:
    d, c = F.coalesce(debit, F.lit(0)), F.coalesce(credit, F.lit(0))
    return F.when((d != 0) & (c == 0), debit).when((c != 0) & (d == 0), credit)


def grouped_amount(x: Column) -> Column:
    """Thousands by comma, a fraction only where there is one."""
    return F.call_function("format_number", x, F.lit("#,##0.######"))


def grouped_amount_local(x: Column) -> Column:
    """Thousands by dot, fraction by comma, and the currency's letter."""
    return F.concat(F.translate(F.call_function("format_number", x, F.lit("#,##0.######")), ",.", ".,"), F.lit(" đ"))


def parse_local_money(x: Column) -> Column:
    """Strict input grammar: digits, or dots between groups of three; up to four decimals after a comma. struct(ok, value, error)."""
    t = F.trim(x)
    good = t.rlike(r"^[0-9]+(,[0-9]{1,4})?$") | t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]{1,4})?$")
    value = F.translate(t, ",.", ".").try_cast(MONEY)
    error = F.when(F.coalesce(t, F.lit("")) == "", "EMPTY").when(t.startswith("-"), "NEGATIVE").when(~good, "MALFORMED")
    return F.struct(F.coalesce(good, F.lit(False)).alias("ok"), F.when(good, value).alias("value"), error.alias("error"))


def is_zero_money(x: Column) -> Column:
    return F.regexp_replace(x, r"[\s.,+-]", "").rlike("^0*$")


def lenient_money(x: Column) -> Column:
    """Money as typed, as text: currency letters and blanks go, a comma is the decimal mark, dots part thousands where there
    are several or where one stands before three digits and behind at most three. Nothing is 0; brackets and a minus negate."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), r"[₫đĐVNDvnd\s\u00a0]", "")
    negative = s.rlike(r"^\(.*\)$") | s.startswith("-")
    bare = F.regexp_replace(s, r"^\((.*)\)$|^-(.*)$", "$1$2")
    whole, part = F.split_part(bare, F.lit(","), F.lit(1)), F.split_part(bare, F.lit(","), F.lit(2))
    digits = F.coalesce(F.nullif(F.replace(whole, F.lit("."), F.lit("")), F.lit("")), F.lit("0"))
    comma = F.when(part.isin("", "0", "00"), digits).otherwise(F.concat(digits, F.lit("."), part))
    thousands = bare.rlike(r"\..*\.") | bare.rlike(r"^[^.]{0,3}\.[^.]{3}$")
    out = F.when(F.contains(bare, F.lit(",")), comma).when(thousands, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
    return F.when(s.isin("", "-"), F.lit("0")).otherwise(F.concat(F.when(negative & (out != "0"), F.lit("-")).otherwise(F.lit("")), out))


def executed_at() -> Column:
    """Now, as RFC 3339 text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
