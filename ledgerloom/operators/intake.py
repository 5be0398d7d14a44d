"""The intake gate: fingerprints of records and datasets, relations between datasets, and merging of disjoint partitions.

Fingerprints are built by grouped aggregation; relations come from one self-join on record fingerprints, whatever the
number of datasets. Amounts enter at a fixed scale, so 100 and 100.00 are one amount.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators.ordering import number_rows
from ledgerloom.plans.model import ReconciliationError
from ledgerloom.session import materialise

#: Names that enter the digest, by kind.
_NAMES = {"e_invoice": "EInvoice", "ledger511": "Ledger511", "ledger3331": "Ledger3331", "ledger131": "Ledger131", "ledger133": "Ledger133", "ledger112": "Ledger112", "bank_statement": "BankStatement", "partner_master": "PartnerMaster", "sales_register": "SalesRegister", "sales_analysis_report": "SalesAnalysisReport", "cash_book": "CashBook", "branch_ledger": "BranchLedger", "custom": "Custom"}
_PLAIN_KINDS = ("partner_master", "sales_analysis_report", "custom")


def record_fingerprint(kind: str) -> Column:
    """SHA-256 over the kind and its identifying fields, joined by bars."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    money = lambda c: F.coalesce(F.col(c).cast("decimal(28,2)").cast("string"), F.lit(""))
    doc = S.doc_number(F.coalesce(F.col("doc_no"), F.lit("") if kind == "e_invoice" or kind in _PLAIN_KINDS else F.col("voucher_no"), F.lit("")))
    tax = lambda *cs: S.tax_number(F.coalesce(*cs, F.lit("")))
    series = F.upper(text("series"))
    if kind == "e_invoice":
        parts = [doc, series, text("date"), tax("seller_tax_id", "buyer_tax_id", "partner_tax_id"), money("pretax_amount"), money("vat_amount"), money("total_amount")]
    elif kind == "bank_statement":
        parts = [text("bank_account"), doc, text("date"), money("credit_amount"), money("debit_amount"), money("total_amount")]
    elif kind in _PLAIN_KINDS:
        parts = [doc, text("date"), tax("partner_tax_id"), money("total_amount")]
    else:
        parts = [doc, series, text("date"), tax("partner_tax_id"), text("debit_account"), text("credit_account"), money("credit_amount"), money("debit_amount"), money("total_amount")]
    return F.sha2(F.concat_ws("|", F.lit(_NAMES[kind]), *parts), 256)


def dataset_fingerprints(prints: DataFrame, chunk_digits: int = 3) -> DataFrame:
    """source_id, n_records, fingerprint of rows (source_id, fp): independent of order, and exact about repeats.

    Record digests are summed in buckets by their first digits, each bucket digested in sorted order of its distinct
    digests with their counts, and the bucket digests digested in turn: no task holds a whole dataset's digests.
    """
    return _bucketed(prints.groupBy("source_id", "fp").agg(F.count(F.lit(1)).alias("n")), chunk_digits)


def _bucketed(counted: DataFrame, chunk_digits: int = 3) -> DataFrame:
    """dataset_fingerprints() of distinct digests and their counts n."""
    bucket = counted.groupBy("source_id", F.substring("fp", 1, chunk_digits).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("fp", F.lit("x"), F.col("n").cast("string")))), ";"), 256).alias("d"), F.sum("n").alias("n"))
    return bucket.groupBy("source_id").agg(F.sum("n").alias("n_records"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", F.lit(":"), F.col("d")))), ";"), 256).alias("fingerprint"))


#: Digests that a block of content_fingerprints holds at most.
BLOCK_ROWS = 4096


def digest(kind: str) -> Column:
    """record_fingerprint() as its 32 bytes: half of what its digits take wherever it is shuffled or written."""
    return F.unhex(record_fingerprint(kind))


def _dealt(prints: DataFrame) -> DataFrame:
    """source_id, fp and begin, its first three digits, by which rows are dealt: no other task has a digest between two that begin alike."""
    begin = F.substring(F.hex(F.substring("fp", 1, 2)), 1, 3) if dict(prints.dtypes)["fp"] == "binary" else F.substring("fp", 1, 3)
    return prints.where("source_id IS NOT NULL").select("source_id", "fp").repartition(begin).withColumn("begin", begin)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each source's sorted digests that begin alike, end to end in blocks; texts with a semicolon each. A null has no text."""
    for batch in batches:
        for source in batch.column("source_id").unique():
            mine = batch.filter(pc.equal(batch.column("source_id"), source))
            fps = mine.column("fp")
            begin, at = mine.column("begin"), fps.null_count  # nulls sort first
            changes = pc.fill_null(pc.not_equal(begin.slice(1), begin.slice(0, len(begin) - 1)), True).to_numpy(zero_copy_only=False).nonzero()[0] + 1
            text = (fps if pa.types.is_binary(fps.type) else pc.binary_join_element_wise(fps, "", ";")).cast(pa.binary())
            rows = [(None, None, at, b"")] if at else []
            for end in (*changes[changes > at].tolist(), len(fps)):
                while at < end:
                    to = min(at + BLOCK_ROWS, end)
                    rows.append((fps[at].as_py(), fps[to - 1].as_py(), to - at, b"".join(text[at:to].to_pylist())))
                    at = to
            first, last, n, data = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([source.as_py()] * len(rows)), pa.array(first, fps.type), pa.array(last, fps.type), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["source_id", "first", "last", "n", "data"])


def _hashed(packed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows and SHA-256 of each source's blocks, which come in order; packed digests are written out as text here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda: pa.RecordBatch.from_pydict({"source_id": [name], "n_records": [records], "fingerprint": [state.hexdigest()]})
        name, records, state = None, 0, None
        for batch in batches:
            for source, n, data in zip(*batch.columns, strict=True):
                if state is None or source.as_py() != name:
                    if state is not None:
                        yield row()
                    name, records, state = source.as_py(), 0, hashlib.sha256()
                records += n.as_py()
                block = data.as_py()
                state.update(block.hex(";", 32).encode() + b";" if packed and block else block)
        if state is not None:
            yield row()

    return run


def content_fingerprints(prints: DataFrame) -> DataFrame:
    """source_id, n_records, fingerprint of rows (source_id, fp); fp: text, or digest()'s 32 bytes, which count as their 64 digits.

    SHA-256 over the sorted record digests, each followed by a semicolon, whatever their number. Tasks sort digests that begin
    alike and lay them end to end in blocks; such a hash can only be taken front to back, so one task a dataset reads its
    blocks in order. Digests are shuffled once as rows and once as blocks, and nothing is written.
    """
    return _fingerprints(_dealt(prints))


def _fingerprints(dealt: DataFrame) -> DataFrame:
    """content_fingerprints() of dealt rows."""
    kind = dict(dealt.dtypes)["fp"]
    blocks = dealt.sortWithinPartitions("fp", "source_id").mapInArrow(_blocks, f"source_id string, first {kind}, last {kind}, n long, data binary")
    ordered = blocks.repartition("source_id").sortWithinPartitions("source_id", "first", "last").select("source_id", "n", "data")
    return ordered.mapInArrow(_hashed(kind == "binary"), "source_id string, n_records long, fingerprint string")


def compatibility_keys(records: DataFrame, kind: str) -> DataFrame:
    """source_id and the first filled bank account, entity tax number and ledger account, in row order."""
    have = set(records.columns)
    records = records.withColumns({c: F.lit(None).cast("string") for c in ("bank_account", "seller_tax_id", "buyer_tax_id", "partner_tax_id", "debit_account", "credit_account") if c not in have})
    first = lambda *cs: F.min_by(F.coalesce(*[S.blank_to_null(F.col(c)) for c in cs]), F.when(F.coalesce(*[S.blank_to_null(F.col(c)) for c in cs]).isNotNull(), F.col("pos")))
    return records.groupBy("source_id").agg(first("bank_account").alias("bank_account"), first("seller_tax_id", "buyer_tax_id", "partner_tax_id").alias("entity_tax_id"), first("debit_account", "credit_account").alias("ledger_account")).withColumn("kind", F.lit(kind))


def _counts(prints: DataFrame) -> DataFrame:
    """fp, per: for each distinct digest its sources and how often each has it. Digests are shuffled once, not once a source."""
    names = sorted(r[0] for r in prints.where("source_id IS NOT NULL").select("source_id").distinct().collect())  # one a dataset
    each = [F.struct(F.lit(s).alias("source_id"), F.count_if(F.col("source_id") == s).alias("n")) for s in names] or [F.struct(F.lit("").alias("source_id"), F.count_if(F.lit(False)).alias("n"))]
    per = F.filter(F.array(*each), lambda x: x["n"] > 0)
    return materialise(prints.groupBy("fp").agg(per.alias("per")), "counts")


def overlaps(prints: DataFrame) -> DataFrame:
    """a, b (source ids, a < b), shared, n_a, n_b (distinct records), for datasets that share a record."""
    return _overlaps(_counts(prints))


def _overlaps(counts: DataFrame) -> DataFrame:
    met = materialise(_pairs(counts.select("fp", F.transform("per", lambda x: x["source_id"]).alias("names"))), "overlaps")
    size = lambda s: met.where("a = b").select(F.col("a").alias(s), F.col("shared").alias(f"n_{s}"))
    return met.where("a < b").join(size("a"), "a").join(size("b"), "b")


def _pairs(sets: DataFrame) -> DataFrame:
    """a, b, shared of distinct digests and the names of the datasets that have each: a row a pair of datasets; a = b: its size."""
    pairs = sets.select("fp", "names", F.explode("names").alias("a")).select("fp", "a", F.explode("names").alias("b")).where("a = b OR (a < b AND fp IS NOT NULL)")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def contents(prints: DataFrame, names: list[str]) -> tuple[dict[str, str], list[dict]]:
    """content_fingerprints() by source, and relations() of them (a, b, relation), of rows (source_id, fp) of the named sources.

    Both come from rows that are dealt once: what is sorted for the one is counted for the other. A row a source or a pair of
    sources reaches the driver.
    """
    dealt = _dealt(prints)
    has = [F.max(F.col("source_id") == s).alias(f"in{i}") for i, s in enumerate(names)]
    sets = dealt.groupBy("begin", "fp").agg(*has).select("fp", F.array_compact(F.array(*[F.when(F.col(f"in{i}"), F.lit(s)) for i, s in enumerate(names)])).alias("names"))
    none = F.lit(None).cast("string")
    made = _fingerprints(dealt).select(F.col("source_id").alias("a"), none.alias("b"), F.lit(None).cast("long").alias("shared"), "fingerprint")
    rows = made.unionByName(_pairs(sets).withColumn("fingerprint", none)).collect()
    fingerprint = {r["a"]: r["fingerprint"] for r in rows if r["b"] is None}
    size = {r["a"]: r["shared"] for r in rows if r["a"] == r["b"]}
    related = []
    for r in sorted((r for r in rows if r["b"] not in (None, r["a"])), key=lambda r: (r["a"], r["b"])):
        a, b = r["a"], r["b"]
        relation = "CONTENT_DUPLICATE" if fingerprint[a] == fingerprint[b] else "SUBSET_DUPLICATE" if r["shared"] in (size[a], size[b]) else "PARTIAL_OVERLAP"
        related.append({"a": a, "b": b, "relation": relation})
    return fingerprint, related


def relations(prints: DataFrame) -> DataFrame:
    """overlaps with relation (CONTENT, SUBSET, PARTIAL) and the ratio in percent of b's records, one decimal."""
    counts = _counts(materialise(prints.select("source_id", "fp"), "prints"))
    o = _overlaps(counts)
    same = _bucketed(counts.select("fp", F.explode("per").alias("x")).select("fp", "x.*"))
    fp = lambda s: same.select(F.col("source_id").alias(s), F.col("fingerprint").alias(f"f_{s}"))
    joined = o.join(fp("a"), "a").join(fp("b"), "b")
    kind = F.when(F.col("f_a") == F.col("f_b"), "CONTENT_DUPLICATE").when((F.col("shared") == F.col("n_a")) | (F.col("shared") == F.col("n_b")), "SUBSET_DUPLICATE").otherwise("PARTIAL_OVERLAP")
    return joined.select("a", "b", "shared", "n_a", "n_b", kind.alias("relation"), F.format_string("%.1f%%", F.col("shared") / F.col("n_b") * 100).alias("ratio"))


def gate(sources: list[dict], related: DataFrame | list[dict]) -> list[dict]:
    """Decide source by source, in order, which are accepted. sources: id, kind, key, path, sheet, raw_hash, fingerprint.

    related: rows a, b, relation, as relations() or contents() give them.

    A duplicate is dropped; a subset or an overlap stops the run, as nothing tells which rows to believe.
    """
    found = {frozenset((r["a"], r["b"])): r for r in (related.collect() if isinstance(related, DataFrame) else related)}  # one row a pair of datasets
    accepted: list[dict] = []
    out = []
    for s in sources:
        relation, other = "UNIQUE", None
        for prev in (p for p in accepted if p["kind"] == s["kind"] and p["key"] == s["key"]):
            same_file = (s.get("raw_hash") and s.get("raw_hash") == prev.get("raw_hash")) or s["path"].strip().lower() == prev["path"].strip().lower()
            if s["fingerprint"] == prev["fingerprint"]:
                relation = "EXACT_DUPLICATE" if same_file and s["sheet"].strip().lower() == prev["sheet"].strip().lower() else "CONTENT_DUPLICATE"
            elif (row := found.get(frozenset((s["id"], prev["id"])))) is not None:
                relation = row["relation"]
            else:
                continue
            other = prev["id"]
            break
        out.append(s | {"relation": relation, "other": other, "eligible": relation == "UNIQUE"})
        if relation == "UNIQUE":
            accepted.append(s)
    conflicts = [x for x in out if x["relation"] in ("SUBSET_DUPLICATE", "PARTIAL_OVERLAP")]
    if conflicts:
        raise ReconciliationError("DATASET_CONFLICT", "; ".join(f"{x['id']} {x['relation']} {x['other']}" for x in conflicts))
    return out


def merge_partitions(records: DataFrame, logical_id: str) -> DataFrame:
    """Rows of disjoint partitions as one source, renumbered by date, number, amount and fingerprint (column fp, which goes)."""
    order = [F.coalesce("date", F.lit("")), F.coalesce("doc_no", F.lit("")), F.col("total_amount"), F.col("fp"), F.col("source_id"), F.col("pos")]
    numbered = number_rows(records, order, "__new", drop=("fp",))
    text = F.col("__new").cast("string")
    name = F.concat(F.lit(f"{logical_id}_rec_"), F.when(F.col("__new") < 100000, F.lpad(text, 5, "0")).otherwise(text))
    return numbered.withColumns({"id": name, "source_id": F.lit(logical_id), "pos": F.col("__new")}).drop("__new")
