"""Schema inference for sheets: where the header is, which column holds what, and what kind of source it is.

infer_sources() does it for any number of sheets at once, as DataFrame operations over (source_id, row_idx, cells); inspect()
does the same for the first rows of one sheet on the driver, for a preview of a file.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S

#: Rows of a sheet that are searched for its header: a limit of the feature.
SCAN_ROWS = 500
POINTS = 10

# Words by which header cells are known, in plain letters.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "credit_amount": ("phat sinh co", "so phat sinh co", "tien co", "credit amount", "ps co", "ps_co"),
    "debit_amount": ("phat sinh no", "so phat sinh no", "tien no", "debit amount", "ps no", "ps_no"),
    "fee_amount": ("tong tien phi", "tien phi", "phi", "le phi", "fee amount", "fee"),
    "discount_amount": ("tong tien chiet khau", "chiet khau thuong mai", "tien chiet khau", "chiet khau", "giam gia", "tong giam gia", "discount"),
    "pretax_amount": ("tong tien chua thue", "tien chua thue", "doanh so", "tien hang", "doanh thu", "chua thue", "doanh thu ban hang", "pretax", "amount before tax", "thanh tien chua thue", "gia tri chua thue"),
    "vat_amount": ("tong tien thue", "tien thue gtgt", "thue gtgt", "tien thue", "thue vat", "vat amount", "tax amount", "tien vat", "thue suat gtgt tien"),
    "total_amount": ("tong tien thanh toan", "tong thanh toan", "thanh tien thanh toan", "so tien thanh toan", "tong cong tien thanh toan", "tong gia tri thanh toan", "tong thanh toan sau thue", "tong tien tt"),
    "total_generic": ("total amount", "grand total", "tong cong", "tong tien"),
    "doc_code": ("ma ct", "ma chung tu", "loai ct", "loai chung tu", "voucher type", "doc code"),
    "doc_no": ("so hoa don", "so hd", "so ct", "so chung tu", "so phieu", "invoice no", "inv no", "so ref", "so hdon", "document no", "doc no"),
    "template_code": ("ky hieu mau so", "mau so ky hieu", "mau so", "mau hd", "template code"),
    "series": ("ky hieu hoa don", "ky hieu hd", "ky hieu", "series"),
    "buyer_tax_id": ("mst nguoi mua", "ma so thue nguoi mua", "mst khach hang", "mst doi tac", "buyer tax id"),
    "seller_tax_id": ("mst nguoi ban", "ma so thue nguoi ban", "mst don vi", "seller tax id"),
    "partner_tax_id": ("ma so thue", "mst", "tax id", "tax code", "mst dv"),
    "date": ("ngay hoa don", "ngay hd", "ngay ct", "ngay chung tu", "ngay lap", "ngay gd", "ngay giao dich", "date", "invoice date", "ngay ghi so", "ngay phat hanh"),
    "partner_name": ("ten khach hang", "ten nguoi mua", "ten don vi", "ten doi tac", "customer name", "buyer name", "ten doi tuong", "don vi mua hang", "ten cong ty", "nguoi nop tien", "doi tuong"),
    "vat_rate": ("thue suat", "vat rate", "phan tram thue", "% thue", "ts"),
    "debit_account": ("tk no", "tai khoan no", "debit account", "debit acc", "tkno", "tk doi ung no"),
    "credit_account": ("tk co", "tai khoan co", "credit account", "credit acc", "tkco", "tk doi ung", "tk doi ung co"),
    "voucher_no": ("so phieu", "voucher no", "so phieu thu", "so phieu chi"),
    "description": ("dien giai", "noi dung", "description", "memo", "ly do", "noi dung thanh toan"),
    "bank_account": ("so tai khoan", "so tk", "bank account", "account number", "stk"),
    "partner_code": ("ma khach", "ma khach ncc", "customer code", "partner code"),
    "address": ("dia chi", "address"),
    "is_customer": ("khach hang", "customer"),
    "is_supplier": ("nha cung cap", "supplier", "vendor"),
    "status": ("trang thai", "status"),
    "currency": ("don vi tien te", "currency"),
    "exchange_rate": ("ty gia", "exchange rate"),
    "invoice_status": ("trang thai hoa don", "invoice status"),
    "invoice_check_result": ("ket qua kiem tra hoa don", "invoice check"),
    "transaction_number": ("so giao dich", "transaction number", "reference number"),
    "accounting_date": ("ngay hach toan", "accounting date"),
    "transaction_date": ("ngay phat sinh giao dich", "transaction date", "value date"),
    "counterparty_account": ("so tai khoan doi ung", "corresponsive account", "correspondent account", "counterparty account"),
    "counterparty_name": ("ten tai khoan doi ung", "corresponsive name", "correspondent name", "counterparty name"),
    "balance": ("so du tk", "so du", "account balance", "balance"),
    "product_name": ("ten mat hang", "product name"),
    "product_code": ("mat hang", "ma hang", "product code"),
    "quantity": ("so luong", "quantity"),
    "unit_price": ("gia ban", "unit price"),
    "revenue": ("doanh thu",),
    "cost": ("tien von", "cost"),
    "profit": ("lai", "profit"),
}
#: Families that make a row look like a header.
HEADER_FAMILIES = ("doc_no", "date", "total_amount", "total_generic", "pretax_amount", "vat_amount", "debit_amount", "credit_amount", "partner_tax_id", "buyer_tax_id", "seller_tax_id", "partner_name", "series", "template_code", "description", "fee_amount", "discount_amount", "partner_code", "product_code", "transaction_number", "balance")
#: A column takes the first open slot of this order that its title fits ...
EXCLUSIVE = ("credit_amount", "debit_amount", "fee_amount", "discount_amount", "pretax_amount", "vat_amount", "total_amount", "doc_code", "doc_no", "template_code", "series", "buyer_tax_id", "seller_tax_id", "partner_tax_id", "date", "partner_name", "vat_rate", "debit_account", "credit_account", "voucher_no", "description", "bank_account")
#: ... and, besides, every open slot of these that it fits.
ADDITIVE = ("partner_code", "address", "is_customer", "is_supplier", "status", "currency", "exchange_rate", "invoice_status", "invoice_check_result", "transaction_number", "accounting_date", "transaction_date", "counterparty_account", "counterparty_name", "balance", "product_name", "product_code", "quantity", "unit_price", "revenue", "cost", "profit")
#: Slots whose title must be the keyword itself.
WHOLE_TITLE = {"doc_code", "is_customer", "is_supplier", "status"}
#: Bare titles that fit as well: equal, as a first word, or as a last one.
BARE = {"credit_amount": ("co", "credit"), "debit_amount": ("no", "debit")}
# Words that keep a title out of a slot.
BARRED = {"bank_account": ("doi ung", "corresponsive"), "series": ("mau so",)}
NOT_A_TOTAL = ("phi", "chiet khau", "giam gia", "chua thue")


def plain_title(text: str) -> str:
    """The driver's form of scalars.token()."""
    table = str.maketrans(S.MARKED, S.PLAIN)
    kept = "".join(c for c in text.lower().translate(table) if unicodedata.category(c)[0] in "LN" or c.isspace())
    return kept.strip()


def _known(slot: str) -> tuple[str, ...]:
    return tuple(plain_title(k) for k in KEYWORDS[slot])


def header_scores(sheets: DataFrame) -> DataFrame:
    """source_id, row_idx, score of each of the first SCAN_ROWS rows that have two filled cells or more."""
    words = sorted({k for f in HEADER_FAMILIES for k in _known(f)})
    pattern = "|".join(re.escape(w) for w in words)
    filled = F.filter(F.col("cells"), lambda c: F.trim(c) != "")
    hits = F.size(F.filter(filled, lambda c: S.token(c).rlike(pattern)))
    rows = sheets.where(F.col("row_idx") < SCAN_ROWS).where(F.size(filled) >= 2)
    return rows.select("source_id", "row_idx", (hits * POINTS).alias("score"))


def header_rows(sheets: DataFrame) -> DataFrame:
    """source_id, row_idx of the header (the earliest of the best rows; 0 if no row scores), and its cells."""
    best = header_scores(sheets).where("score > 0").groupBy("source_id").agg(F.min_by("row_idx", F.struct((-F.col("score")).alias("s"), "row_idx")).alias("row_idx"))
    every = sheets.select("source_id").distinct().join(best, "source_id", "left").fillna(0, ["row_idx"])
    return sheets.join(every, ["source_id", "row_idx"]).select("source_id", "row_idx", "cells")


def column_names(cells: Column) -> Column:
    return F.transform(cells, lambda c, i: F.coalesce(S.blank_to_null(c), F.concat(F.lit("Cột "), (i + 1).cast("string"))))


def names_of(cells: Sequence[str]) -> list[str]:
    return [c.strip() or f"Cột {i + 1}" for i, c in enumerate(cells)]


def _fits(slot: str, title: str) -> bool:
    if any(w in title for w in BARRED.get(slot, ())):
        return False
    if slot in ("total_amount", "total_generic") and (any(w in title for w in NOT_A_TOTAL) or ("thue" in title and "sau thue" not in title)):
        return False
    first, last = BARE.get(slot, ("", ""))
    if first and (title in (first, last) or title.startswith(first + " ") or title.endswith(" " + last)):
        return True
    words = _known(slot)
    return title in words if slot in WHOLE_TITLE else any(w in title for w in words)


def map_columns(columns: Sequence[str]) -> dict[str, str]:
    """slot -> column title."""
    found: dict[str, str] = {}
    titles = [(c, plain_title(c)) for c in columns]
    for column, title in titles:
        for slot in EXCLUSIVE:
            if slot == "doc_code":
                if _fits(slot, title):  # a document code is never a number, even where the slot is filled
                    found.setdefault(slot, column)
                    break
            elif slot not in found and _fits(slot, title):
                if slot != "doc_no" or not title.startswith(("ma ct", "ma chung tu")):
                    found[slot] = column
                if slot == "buyer_tax_id":
                    found.setdefault("partner_tax_id", column)
                break
    for column, title in titles:
        for slot in ADDITIVE:
            if slot in found or (slot == "product_code" and found.get("product_name") == column):
                continue
            if _fits(slot, title) or (slot == "revenue" and title == "tien"):
                found[slot] = column
                also = {"transaction_number": "voucher_no", "revenue": "pretax_amount"}.get(slot)
                if also:
                    found.setdefault(also, column)
        for slot, bare in (("vat_amount", "thue"), ("total_amount", "phai thu")):
            if title == bare:
                found.setdefault(slot, column)
    if "total_amount" not in found:
        generic = next((c for c, t in titles if _fits("total_generic", t)), None)
        if generic:
            found["total_amount"] = generic
    return found


# Evidence for a kind, as points, slots that must be mapped (a tuple inside: any of them), words of the context (any of them).
Evidence = tuple[int, tuple, tuple[str, ...]]
EVIDENCE: dict[str, tuple[Evidence, ...]] = {
    "e_invoice": ((35, ("series",), ()), (30, ("template_code",), ()), (40, ("pretax_amount", "vat_amount"), ()), (20, (("buyer_tax_id", "seller_tax_id"),), ()), (25, (), ("hoa don", "einvoice"))),
    "ledger511": ((50, (), ("511",)), (15, (), ("doanh thu",)), (20, ("credit_amount",), ("511", "doanh thu"))),
    "ledger3331": ((60, (), ("3331", "thue gtgt phai nop", "thue gtgt dau ra")),),
    "ledger131": ((60, (), ("131", "phai thu khach hang", "cong no phai thu")),),
    "ledger133": ((60, (), ("133", "thue gtgt dau vao", "thue gtgt duoc khau tru")),),
    "ledger112": ((80, ("debit_amount", "credit_amount"), ("112",)),),
    "partner_master": ((90, ("partner_code", "partner_name", "partner_tax_id"), ("danh muc", "khach hang", "nha cung cap", "columns:khach hang", "columns:nha cung cap")),),
    "sales_register": ((85, ("date", "doc_no", "partner_code", "revenue", "vat_amount", "total_amount"), ()),),
    "sales_analysis_report": ((90, ("product_name", "revenue", "cost", "profit"), ()),),
    "bank_statement": ((35, (("bank_account", "transaction_number"),), ()), (55, ("debit_amount", "credit_amount", "transaction_number", "accounting_date", "balance"), ()), (50, (), ("sao ke", "ngan hang", "bank"))),
    "cash_book": ((50, (), ("so quy", "tien mat")),),
    "branch_ledger": ((40, (), ("chi nhanh",)),),
}
LEAST, MARGIN = 40, 10


def kind_scores(mapping: dict[str, str], context: str, columns: Sequence[str]) -> dict[str, int]:
    text, titles = plain_title(context), plain_title(" ".join(columns))
    has = lambda s: any(x in mapping for x in s) if isinstance(s, tuple) else s in mapping
    says = lambda w: w[8:] in titles if w.startswith("columns:") else w in text
    return {kind: sum(p for p, slots, words in evidence if all(map(has, slots)) and (not words or any(map(says, words)))) for kind, evidence in EVIDENCE.items()}


def source_kind(scores: dict[str, int]) -> tuple[str, float]:
    """The best kind and its confidence; unclear evidence is nobody's kind."""
    ranked = sorted(scores.items(), key=lambda x: -x[1])  # stable: ties keep the table's order
    (kind, best), (_, second) = ranked[:2]
    if best < LEAST:
        return "custom", 0.35
    if second >= LEAST and best - second < MARGIN:
        return "custom", 0.45
    return kind, min(0.99, max(0.60, best / 100))


def inspect(rows: Sequence[Sequence[str]], context: str = "") -> dict:
    """header_row and data_start_row (from 1), columns, mapping, kind, confidence of one sheet's first rows."""
    words = {k for f in HEADER_FAMILIES for k in _known(f)}
    scored = [(sum(any(w in plain_title(c) for w in words) for c in row if c.strip()) if sum(bool(c.strip()) for c in row) > 1 else 0) for row in rows[:SCAN_ROWS]]
    at = scored.index(max(scored)) if scored else 0
    columns = names_of(rows[at]) if rows else []
    mapping = map_columns(columns)
    above = " ".join([context.lower(), *[c.lower() for row in rows[:at] for c in row if c.strip()]])
    kind, confidence = source_kind(kind_scores(mapping, above, columns)) if rows else ("custom", 0.0)
    return {"header_row": at + 1, "data_start_row": at + 2, "columns": columns, "mapping": mapping, "kind": kind, "confidence": confidence}


def kind_score_frame(scores: DataFrame) -> DataFrame:
    """source_id, kind, confidence from rows (source_id, ord, kind, score): the best two by score, then order."""
    w = Window.partitionBy("source_id").orderBy(F.col("score").desc(), "ord")
    top = scores.withColumn("r", F.row_number().over(w)).where("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    both = top.groupBy("source_id").agg(pick(1, "kind").alias("k"), pick(1, "score").alias("a"), F.coalesce(pick(2, "score"), F.lit(0)).alias("b"))
    close = (F.col("b") >= LEAST) & (F.col("a") - F.col("b") < MARGIN)
    kind = F.when((F.col("a") < LEAST) | close, "custom").otherwise(F.col("k"))
    confidence = F.when(F.col("a") < LEAST, 0.35).when(close, 0.45).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.6), F.col("a") / 100)))
    return both.select("source_id", kind.alias("kind"), confidence.alias("confidence"))


# ---- the same for any number of sheets, in Spark ----------------------------------------------------------------------


def _any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether text has one of the words in it."""
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def _fitting(slots: Sequence[str], title: Column) -> Column:
    """Those of the slots that a title fits, in their order: the DataFrame form of _fits()."""

    def fits(slot: str) -> Column:
        known = _known(slot)
        ok = title.isin(*known) if slot in WHOLE_TITLE else _any_of(title, known)
        if slot in BARE:
            first, last = BARE[slot]
            ok = ok | title.isin(first, last) | title.startswith(first + " ") | title.endswith(" " + last)
        if slot in ("total_amount", "total_generic"):
            ok = ok & ~_any_of(title, NOT_A_TOTAL) & ~(title.contains("thue") & ~title.contains("sau thue"))
        return ok & ~_any_of(title, BARRED[slot]) if slot in BARRED else ok

    return F.array_compact(F.array(*[F.when(fits(s), F.lit(s)) for s in slots]))


def _with(found: Column, slots: Column, column: Column) -> Column:
    return F.map_concat(found, F.map_from_arrays(slots, F.transform(slots, lambda _: column)))


def _exclusive(found: Column, c: Column) -> Column:
    """A column takes the first open slot that it fits; a document code's column takes nothing else, filled or not."""
    slot = F.get(F.filter(c["exclusive"], lambda s: (s == "doc_code") | ~F.map_contains_key(found, s)), F.lit(0))
    refused = slot.isNull() | ((slot == "doc_code") & F.map_contains_key(found, "doc_code")) | ((slot == "doc_no") & c["title"].rlike("^(ma ct|ma chung tu)"))
    also = F.when((slot == "buyer_tax_id") & ~F.map_contains_key(found, "partner_tax_id"), F.array(slot, F.lit("partner_tax_id"))).otherwise(F.array(slot))
    return F.when(refused, found).otherwise(_with(found, also, c["column"]))


def _additive(found: Column, c: Column) -> Column:
    """A column takes every open slot of the second list that it fits, and what goes with these."""
    has = lambda s: F.map_contains_key(found, s)
    names_product = F.coalesce(found["product_name"] == c["column"], F.array_contains(c["additive"], "product_name"))
    open_ = F.filter(c["additive"], lambda s: ~has(s) & ~((s == "product_code") & names_product))
    goes_with = (("voucher_no", F.array_contains(open_, "transaction_number")), ("pretax_amount", F.array_contains(open_, "revenue")), ("vat_amount", c["title"] == "thue"), ("total_amount", c["title"] == "phai thu"))
    more = F.array_compact(F.array(*[F.when(when & ~has(s), F.lit(s)) for s, when in goes_with]))
    return _with(found, F.concat(open_, more), c["column"])


def map_headers(headers: DataFrame) -> DataFrame:
    """source_id, row_idx, columns, mapping (slot -> column title) from header rows: an ordered fold over each row's columns."""
    title = F.posexplode_outer(F.zip_with(column_names(F.col("cells")), F.col("cells"), lambda name, _: F.struct(name.alias("column"), S.token(name).alias("title"))))
    each = headers.select("source_id", "row_idx", title.alias("at", "c")).select("source_id", "row_idx", "at", "c.*")
    additive = _fitting(ADDITIVE, F.col("title"))
    additive = F.when((F.col("title") == "tien") & ~F.array_contains(additive, "revenue"), F.array_append(additive, "revenue")).otherwise(additive)
    fitted = each.select("source_id", "row_idx", F.when(F.col("at").isNotNull(), F.struct("at", "column", "title", _fitting(EXCLUSIVE, F.col("title")).alias("exclusive"), additive.alias("additive"), (F.size(_fitting(("total_generic",), F.col("title"))) > 0).alias("generic"))).alias("c"))
    rows = fitted.groupBy("source_id", "row_idx").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("mapping", F.reduce("cs", none, _exclusive)).withColumn("mapping", F.reduce("cs", F.col("mapping"), _additive))
    generic = F.get(F.filter("cs", lambda c: c["generic"]), F.lit(0))["column"]
    whole = F.when(F.map_contains_key("mapping", "total_amount") | generic.isNull(), F.col("mapping")).otherwise(F.map_concat("mapping", F.create_map(F.lit("total_amount"), generic)))
    return rows.select("source_id", "row_idx", F.transform("cs", lambda c: c["column"]).alias("columns"), whole.alias("mapping"))


def kind_points(mapping: Column, text: Column, titles: Column) -> Column:
    """Array of (less, ord, kind), the best first; less is minus the points. text and titles as token() gives them."""

    def met(slots: tuple, words: tuple[str, ...]) -> Column:
        ok = F.lit(True)
        for s in slots:
            ok = ok & reduce(lambda a, b: a | b, [F.map_contains_key(mapping, x) for x in (s if isinstance(s, tuple) else (s,))])
        said = [titles.contains(w[8:]) if w.startswith("columns:") else text.contains(w) for w in words]
        return ok & reduce(lambda a, b: a | b, said) if said else ok

    points = [reduce(lambda a, b: a + b, [F.when(met(slots, words), F.lit(p)).otherwise(F.lit(0)) for p, slots, words in evidence]) for evidence in EVIDENCE.values()]
    return F.array_sort(F.array(*[F.struct((-p).alias("less"), F.lit(i).alias("ord"), F.lit(k).alias("kind")) for i, (k, p) in enumerate(zip(EVIDENCE, points, strict=True))]))


def infer_sources(sheets: DataFrame, context: str | None = None) -> DataFrame:
    """source_id, header_row and data_start_row (from 1), columns, mapping, kind, confidence of every sheet.

    sheets: source_id, row_idx, cells and, if context names it, a column with each sheet's title. A sheet's first SCAN_ROWS
    rows are looked at; one group holds a sheet's header, another the texts above it. Unclear evidence is nobody's kind.
    """
    mapped = map_headers(header_rows(sheets))
    first = sheets.where(F.col("row_idx") < SCAN_ROWS).join(mapped.select("source_id", F.col("row_idx").alias("header")), "source_id").where(F.col("row_idx") < F.col("header"))
    line = F.concat_ws(" ", F.transform(F.filter("cells", lambda c: F.trim(c) != ""), F.lower))
    above = first.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda x: x["line"]), " ").alias("above"))
    named = sheets.groupBy("source_id").agg(F.lower(F.first(context)).alias("named")) if context else mapped.select("source_id", F.lit("").alias("named"))
    text = S.token(F.concat_ws(" ", F.coalesce("named", F.lit("")), F.coalesce("above", F.lit(""))))
    rows = mapped.join(above, "source_id", "left").join(named, "source_id").withColumn("points", kind_points(F.col("mapping"), text, S.token(F.array_join("columns", " "))))
    best, second = -F.get("points", F.lit(0))["less"], -F.get("points", F.lit(1))["less"]
    close = (second >= LEAST) & (best - second < MARGIN)
    kind = F.when((best < LEAST) | close, "custom").otherwise(F.get("points", F.lit(0))["kind"])
    confidence = F.when(best < LEAST, 0.35).when(close, 0.45).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.6), best / 100)))
    return rows.select("source_id", (F.col("row_idx") + 1).cast("int").alias("header_row"), (F.col("row_idx") + 2).cast("int").alias("data_start_row"), "columns", "mapping", kind.alias("kind"), confidence.alias("confidence"))
