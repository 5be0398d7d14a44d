"""Raw sheet rows (source_id, row_idx from 0, cells) to canonical, partner and sales-analysis records.

Every projection is one select over array elements; filters are Column predicates, so a scan drops rows before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.plans.model import MONEY, MONEY_FIELDS, Source
from ledgerloom.session import spread

_DATES = ("date", "accounting_date", "transaction_date")
_TEXT = ("doc_no", "doc_code", "template_code", "buyer_tax_id", "seller_tax_id", "partner_name", "partner_code", "vat_rate", "debit_account", "credit_account", "voucher_no", "description", "bank_account", "transaction_number", "counterparty_account", "counterparty_name")


class Cells:
    """Looks mapped columns up in a row's cells: the first title that is equal after trimming."""

    def __init__(self, columns: Sequence[str], mapping: dict[str, str]):
        self.place: dict[str, int] = {}
        titles = [c.strip() for c in columns]
        for slot, title in mapping.items():
            if title.strip() in titles:
                self.place[slot] = titles.index(title.strip())

    def text(self, slot: str) -> Column:
        at = self.place.get(slot)
        return S.blank_to_null(F.get("cells", F.lit(at))) if at is not None else F.lit(None).cast("string")

    def money(self, slot: str) -> Column:
        return S.amount(self.text(slot)) if slot in self.place else F.lit(None).cast(MONEY)

    def date(self, slot: str) -> Column:
        return S.date_text(self.text(slot)) if slot in self.place else F.lit(None).cast("string")


def data_rows(rows: DataFrame, source: Source) -> DataFrame:
    """Rows from the data's start on that hold something and are no subtotal."""
    start = max(1, source.data_start_row - 1) if source.data_start_row else 1
    return rows.where((F.col("row_idx") >= start) & ~S.is_garbage_row(F.col("cells")))


def derived_total(mapped: Column, pretax: Column, vat: Column, discount: Column, fee: Column, credit: Column, debit: Column) -> tuple[Column, Column]:
    """The mapped total; else pretax and tax less discount plus fee; else pretax, credit, debit, nothing. And its origin."""
    zero = F.lit(0).cast(MONEY)
    made = F.coalesce((pretax + vat - F.coalesce(discount, zero) + F.coalesce(fee, zero)).cast(MONEY), pretax, credit, debit, zero)
    return F.coalesce(mapped, made).cast(MONEY), F.when(mapped.isNotNull(), "SOURCE").otherwise("DERIVED")


def canonical(rows: DataFrame, source: Source, columns: Sequence[str]) -> DataFrame:
    cells = Cells(columns, source.mapping)
    amounts = F.inline(F.array(F.struct(*[cells.money(c).alias("mapped_total" if c == "total_amount" else c) for c in MONEY_FIELDS])))
    money = {c: F.col(c) for c in MONEY_FIELDS if c != "total_amount"}
    total, origin = derived_total(F.col("mapped_total"), *[money[c] for c in ("pretax_amount", "vat_amount", "discount_amount", "fee_amount", "credit_amount", "debit_amount")])
    # of columns with one title the last that is filled counts
    filled = lambda i: F.nullif(F.get("cells", F.lit(i)), F.when(F.trim(F.get("cells", F.lit(i))) == "", F.get("cells", F.lit(i))))
    places = {t: [i for i, x in enumerate(columns) if x == t] for t in columns}
    raw = F.map_filter(F.create_map(*[x for t, at in places.items() for x in (F.lit(t), F.coalesce(*[filled(i) for i in reversed(at)]))]) if places else F.create_map().cast("map<string,string>"), lambda k, v: v.isNotNull())
    parsed = spread(data_rows(rows, source).select("row_idx", "cells")).select("row_idx", "cells", amounts)  # generated: the money filter below doesn't parse them again
    out = parsed.select(
        F.concat(F.lit(f"{source.id}_row_"), (F.col("row_idx") + 1).cast("string")).alias("id"),
        F.lit(source.id).alias("source_id"),
        (F.col("row_idx") + 1).cast("int").alias("source_row"),
        F.col("row_idx").cast("bigint").alias("pos"),
        *[cells.date(c).alias(c) for c in _DATES],
        *[cells.text(c).alias(c) for c in _TEXT],
        F.upper(cells.text("series")).alias("series"),
        F.coalesce(cells.text("partner_tax_id"), cells.text("buyer_tax_id")).alias("partner_tax_id"),
        *[v.alias(c) for c, v in money.items()],
        total.alias("total_amount"),
        origin.alias("total_amount_origin"),
        S.lifecycle(F.coalesce(cells.text("invoice_status"), F.lit(""))).alias("lifecycle") if "invoice_status" in cells.place else F.lit(None).cast("string").alias("lifecycle"),
        raw.alias("raw_fields"),
    )
    return out.where(has_money()).where("doc_no IS NOT NULL OR voucher_no IS NOT NULL OR partner_name IS NOT NULL")


def has_money() -> Column:
    some = F.lit(False)
    for c in ("pretax_amount", "vat_amount", "discount_amount", "fee_amount", "total_amount", "debit_amount", "credit_amount"):
        some = some | (F.coalesce(F.col(c), F.lit(0)) != 0)
    return some


def partners(rows: DataFrame, source: Source, columns: Sequence[str]) -> DataFrame:
    c = Cells(columns, source.mapping)
    out = data_rows(rows, source).select(
        F.concat(F.lit(f"{source.id}_row_"), (F.col("row_idx") + 1).cast("string")).alias("id"), F.lit(source.id).alias("source_id"), (F.col("row_idx") + 1).cast("int").alias("source_row"),
        c.text("partner_code").alias("partner_code"), c.text("partner_name").alias("partner_name"), F.nullif(S.tax_number(c.text("partner_tax_id")), F.lit("")).alias("partner_tax_id"), c.text("address").alias("address"),
        S.yes_no(c.text("is_customer")).alias("is_customer"), S.yes_no(c.text("is_supplier")).alias("is_supplier"), c.text("status").alias("status"),
    )
    return out.where("partner_code IS NOT NULL OR partner_name IS NOT NULL OR partner_tax_id IS NOT NULL")


def row_level(product_code: Column, product_name: Column) -> Column:
    return F.when(product_code.isNotNull(), "DETAIL").when(product_name.isNotNull(), "GROUP").otherwise("NEEDS_REVIEW")


def sales_analysis(rows: DataFrame, source: Source, columns: Sequence[str]) -> DataFrame:
    c = Cells(columns, source.mapping)
    out = data_rows(rows, source).select(
        F.concat(F.lit(f"{source.id}_row_"), (F.col("row_idx") + 1).cast("string")).alias("id"), F.lit(source.id).alias("source_id"), (F.col("row_idx") + 1).cast("int").alias("source_row"),
        c.text("product_code").alias("product_code"), c.text("product_name").alias("product_name"), c.money("quantity").alias("quantity"), c.money("unit_price").alias("unit_price"),
        c.money("revenue").alias("revenue"), c.money("vat_amount").alias("vat"), c.money("total_amount").alias("receivable"), c.money("cost").alias("cost"), c.money("profit").alias("profit"),
    )
    return out.withColumn("row_level", row_level(F.col("product_code"), F.col("product_name")))


def ledger_entries(records: DataFrame, kind: str) -> DataFrame:
    """Ledger view: account by kind or by the raw field, and the counter account."""
    account = F.lit(kind[6:]) if kind.startswith("ledger") else F.try_element_at("raw_fields", F.lit("ledgerAccount"))
    counter = F.coalesce(F.try_element_at("raw_fields", F.lit("counterAccount")), F.col("credit_account"), F.col("debit_account"))
    return records.select("id", "source_id", account.alias("account"), counter.alias("counter_account"), "date", "doc_no", "debit_amount", "credit_amount", "description")


def bank_transactions(records: DataFrame) -> DataFrame:
    return records.select("id", "source_id", "bank_account", S.first_filled(F.col("transaction_number"), F.col("voucher_no"), F.col("doc_no")).alias("reference"), F.coalesce("accounting_date", "transaction_date", "date").alias("date"), S.money_direction("bank_statement", F.col("debit_amount"), F.col("credit_amount")).alias("direction"), S.directional_amount(F.col("debit_amount"), F.col("credit_amount")).alias("amount"), "counterparty_account", "counterparty_name", "description", "balance")


def _movements(df: DataFrame, side: str) -> DataFrame:
    """id, account, amount, credit of bank rows with one amount and an account, under the side's name."""
    moved = df.withColumn("amount", S.directional_amount(F.col("debit_amount"), F.col("credit_amount"))).where("amount IS NOT NULL AND trim(bank_account) <> ''")
    return moved.select(F.col("id").alias(f"{side}_id"), F.col("bank_account").alias(f"{side}_account"), "amount", (F.coalesce("debit_amount", F.lit(0)) == 0).alias(f"{side}_credit"))


def internal_transfers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of bank rows that move one amount between two accounts of one's own: an equi-join on the amount."""
    return _movements(left, "a").join(_movements(right, "b"), "amount").where("a_account <> b_account AND a_credit <> b_credit").select("a_id", "b_id", "amount")


def transfer_classes(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """internal_transfers without its pairs: classes of rows that link to the same rows, and their members.

    Links: amount, a_account, b_account, a_credit, a_n, b_n and links, the number of pairs. Members: side, id, account, amount,
    credit. An amount that very many rows have is counted before it is joined; no pair of rows is made.
    """
    sides = {s: _movements(df, s) for s, df in (("a", left), ("b", right))}
    counted = {s: df.groupBy("amount", f"{s}_account", f"{s}_credit").agg(F.count(F.lit(1)).alias(f"{s}_n")) for s, df in sides.items()}
    met = counted["a"].join(counted["b"], "amount").where("a_account <> b_account AND a_credit <> b_credit")
    links = met.select("amount", "a_account", "b_account", "a_credit", "a_n", "b_n", (F.col("a_n") * F.col("b_n")).alias("links"))
    member = lambda s: sides[s].select(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_account").alias("account"), "amount", F.col(f"{s}_credit").alias("credit"))
    return links, member("a").unionByName(member("b"))
