"""Canonical records, sessions and results as JSON: names in camel case, amounts as decimals."""

from __future__ import annotations

import json
import re
from dataclasses import MISSING, asdict, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ledgerloom.plans.model import MONEY, RECORD_SCHEMA, ReconciliationError, Rule, Session, Source


def camel(name: str) -> str:
    return re.sub(r"_([a-z0-9])", lambda m: m[1].upper(), name)


def record_schema() -> StructType:
    """The record's schema as it is written: pos isn't, it is the order of the rows."""
    return StructType([StructField(camel(f.name), f.dataType) for f in StructType.fromDDL(RECORD_SCHEMA) if f.name != "pos"])


def _canonical(df: DataFrame) -> DataFrame:
    names = [f.name for f in StructType.fromDDL(RECORD_SCHEMA) if f.name != "pos"]
    return df.select(*[F.col(camel(n)).alias(n) for n in names], F.coalesce(F.col("sourceRow").cast("bigint"), F.monotonically_increasing_id()).alias("pos"))


def read_records(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Records of a JSON array a file, or of a line each. Order is sourceRow, else the order in which they are read."""
    return _canonical(spark.read.schema(record_schema()).option("multiLine", multiline).json(path))


def from_documents(df: DataFrame, column: str = "document") -> DataFrame:
    return _canonical(df.select(F.from_json(column, record_schema()).alias("r")).select("r.*"))


def to_documents(records: DataFrame) -> DataFrame:
    """id and a JSON document of each record; absent values are left out."""
    have = set(records.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(camel(f.name)) for f in StructType.fromDDL(RECORD_SCHEMA) if f.name in have and f.name != "pos"]
    return records.select("id", F.to_json(F.struct(*cols)).alias("document"))


# ---- results ------------------------------------------------------------------------------------------------------

_MONEY_OF_GROUP = ("revenueVariance", "vatVariance", "receivableVariance", "otherVariance", "totalSourceAmount", "totalTargetAmount", "amountVariance")
_DISCREPANCY = f"struct<fieldName: string, sourceValue: string, targetValue: string, amountDiff: {MONEY}, message: string>"
_COMPARISON = f"struct<control: int, secondarySourceId: string, secondarySourceKind: string, semantic: string, expectedAmount: {MONEY}, actualAmount: {MONEY}, variance: {MONEY}, status: string, secondaryRecordIds: array<string>, discrepancies: array<{_DISCREPANCY}>>"
_BREAKDOWN = f"struct<recordIds: array<string>, comparedAmount: {MONEY}, status: string, discrepancies: array<{_DISCREPANCY}>>"
#: A group as it is written: its comparisons in control order, and per source what the last of its controls says.
GROUP_SCHEMA = (
    "id string, status string, docNo string, series string, date string, partnerName string, primarySourceRecordIds array<string>, targetSourceRecordIds array<string>, "
    f"sourceBreakdowns map<string, {_BREAKDOWN}>, discrepancies array<{_DISCREPANCY}>, semanticComparisons array<{_COMPARISON}>, " + ", ".join(f"{c} {MONEY}" for c in _MONEY_OF_GROUP)
)


def nested_result(frames) -> DataFrame:
    """A row per group, with GROUP_SCHEMA, from the matcher's flat frames; a group's arrays follow its own candidates."""
    said = F.struct(*[F.col(c).alias(camel(c)) for c in ("field_name", "source_value", "target_value", "amount_diff", "message")])
    none = F.array().cast(f"array<{_DISCREPANCY}>")
    kinds = {"l": (frames.named, F.struct("control", "s_id", "in_group")), "d": (frames.discrepancies, F.struct("control", said.alias("d"))), "c": (frames.comparisons, F.struct("control", "source_id", "source_kind", "semantic", "expected", "actual", "variance", "status")), "b": (frames.breakdowns, F.struct("source_id", "control", "status", "compared_amount"))}
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select("group_id", x.alias(k)) for k, (df, x) in kinds.items()])
    # all that belongs to a group is shuffled once, by the group, and dealt to its controls in place
    g = frames.groups.join(rows.groupBy("group_id").agg(*[F.array_sort(F.collect_list(k)).alias(k) for k in kinds]), "group_id", "left")
    ids = lambda x: F.array_sort(F.array_distinct(F.transform(F.filter("l", lambda i: i["control"] == x["control"]), lambda i: i["s_id"])))
    told = lambda x: F.transform(F.filter("d", lambda i: i["control"] == x["control"]), lambda i: i["d"])
    comparison = lambda x: F.struct(x["control"].alias("control"), x["source_id"].alias("secondarySourceId"), x["source_kind"].alias("secondarySourceKind"), x["semantic"].alias("semantic"), x["expected"].alias("expectedAmount"), x["actual"].alias("actualAmount"), x["variance"].alias("variance"), x["status"].alias("status"), ids(x).alias("secondaryRecordIds"), told(x).alias("discrepancies"))
    breakdown = lambda x: F.struct(x["source_id"], F.struct(ids(x).alias("recordIds"), x["compared_amount"].alias("comparedAmount"), x["status"].alias("status"), told(x).alias("discrepancies")))
    held = F.array_sort(F.array_distinct(F.transform(F.filter("l", lambda i: i["in_group"]), lambda i: i["s_id"])))
    g = g.withColumns({"comparisons": F.transform("c", comparison), "breakdowns": F.map_from_entries(F.transform("b", breakdown)), "all_said": F.transform("d", lambda i: i["d"]), "targets": F.when(F.size(held) > 0, held)})
    ids_of = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col(c)))
    made = {
        "id": F.col("group_id"), "docNo": F.col("doc_no"), "partnerName": F.col("partner_name"), "primarySourceRecordIds": ids_of("primary_id"),
        "targetSourceRecordIds": F.coalesce("targets", ids_of("secondary_id")), "sourceBreakdowns": F.coalesce("breakdowns", F.create_map().cast(f"map<string, {_BREAKDOWN}>")),
        "discrepancies": F.coalesce("all_said", none), "semanticComparisons": F.coalesce("comparisons", F.array().cast(f"array<{_COMPARISON}>")),
    }
    snake = lambda name: re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), name)
    return g.select(*[made.get(f.name, F.col(snake(f.name))).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(GROUP_SCHEMA)])


def result_documents(frames) -> DataFrame:
    """group_id and a JSON document of each group."""
    rows = nested_result(frames)
    return rows.select(F.col("id").alias("group_id"), F.to_json(F.struct(*rows.columns)).alias("document"))


def read_result(documents: DataFrame, column: str = "document") -> DataFrame:
    """Groups with GROUP_SCHEMA from their documents; what isn't a group's document is an error, not a row of nulls."""
    parsed = documents.select(F.col(column).alias("text"), F.from_json(column, StructType.fromDDL(GROUP_SCHEMA)).alias("g"))
    bad = F.raise_error(F.concat(F.lit("NOT_A_GROUP: "), F.coalesce(F.left("text", F.lit(200)), F.lit(""))))
    return parsed.select(F.when(F.col("g.id").isNull(), bad).otherwise(F.col("g.id")).alias("id"), *[f"g.{f.name}" for f in StructType.fromDDL(GROUP_SCHEMA) if f.name != "id"])


def write_result(frames, path: str) -> None:
    """A result as folders of JSON lines: groups with everything nested, links, summary."""
    result_documents(frames).select(F.col("document").alias("value")).write.text(f"{path}/groups")
    for name in ("discrepancies", "links", "summary"):
        df = getattr(frames, name)
        df.select(*[F.col(c).alias(camel(c)) for c in df.columns]).write.json(f"{path}/{name}")


# ---- sessions -----------------------------------------------------------------------------------------------------


def session_document(session: Session) -> str:
    """A session as JSON, names in camel case; what a mapping or a rule's field is called stays as it is."""
    plain = lambda x: {camel(k): v for k, v in asdict(x).items()}
    return json.dumps(plain(session) | {"sources": [plain(s) for s in session.sources], "rules": [plain(r) for r in session.rules]}, ensure_ascii=False)


def read_session(document: str) -> Session:
    """The session of a document; unknown names are refused, absent ones have their defaults."""

    def made(kind, found: dict, **parts):
        names = {camel(f.name): f.name for f in fields(kind)}
        if unknown := sorted(set(found) - set(names)):
            raise ReconciliationError("UNKNOWN_FIELD", ", ".join(unknown))
        values = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in found.items()} | parts
        if lacking := [f.name for f in fields(kind) if f.name not in values and f.default is MISSING and f.default_factory is MISSING]:
            raise ReconciliationError("FIELD_MISSING", ", ".join(lacking))
        return kind(**values)

    try:
        found = json.loads(document)
    except ValueError as e:
        raise ReconciliationError("NOT_A_SESSION", str(e)) from e
    if not isinstance(found, dict):
        raise ReconciliationError("NOT_A_SESSION", "a session is an object")
    parts = {"sources": tuple(made(Source, s) for s in found.get("sources", ())), "rules": tuple(made(Rule, r) for r in found.get("rules", ()))}
    return made(Session, {k: v for k, v in found.items() if k not in parts}, **parts)
