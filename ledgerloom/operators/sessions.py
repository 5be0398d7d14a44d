"""What a session needs before it runs: contents, roles, active semantics, and the merge of files into logical sources.

Records stay in Spark; only sources (a handful) and one row a source or pair of sources reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import intake
from ledgerloom.plans.model import ReconciliationError, Rule, Session, Source

REFERENCE_KINDS = ("partner_master", "sales_analysis_report")
# Roles as they enter a logical source's id.
ROLE_NAMES = {"PRIMARY": "Primary", "SECONDARY": "RequiredSecondary", "OPTIONAL": "OptionalSecondary", "REFERENCE": "ReferenceMaster"}


def content(source: Source, by_id: Mapping[str, bytes] | None = None, by_path: Mapping[str, bytes] | None = None) -> bytes:
    """A source's file: handed over under its id, or under its path, or read from disk."""
    for given, key in ((by_id, source.id), (by_path, source.path)):
        if given and key in given:
            return given[key]
    if source.path and Path(source.path).is_file():
        return Path(source.path).read_bytes()
    raise ReconciliationError("CONTENT_NOT_FOUND", source.id)


def assign_roles(sources: tuple[Source, ...], recommended: Mapping[str, str]) -> tuple[Source, ...]:
    """Roles by kind where a scenario recommends one; else the first source is primary and the others are required."""
    return tuple(replace(s, role=recommended.get(s.kind, "PRIMARY" if i == 0 else "SECONDARY")) for i, s in enumerate(sources))


def active_semantics(rules: tuple[Rule, ...], sources: tuple[Source, ...]) -> list[str]:
    """Semantics of the rules whose secondary kind is among the sources, each once, in rule order."""
    kinds = {s.kind for s in sources}
    return list(dict.fromkeys(r.semantic for r in rules if r.secondary_kind in kinds))


def first_rule(session: Session, primary_kind: str, secondary_kind: str) -> Rule | None:
    """The first rule of a pair of kinds, with the session's tolerances where it has none of its own."""
    rule = next((r for r in session.rules if (r.primary_kind, r.secondary_kind) == (primary_kind, secondary_kind)), None)
    return rule and replace(rule, tolerance=rule.tolerance if float(rule.tolerance) else session.tolerance, days=rule.days or session.days)


def without_references(session: Session) -> Session:
    """The session without partner masters and sales analyses; the primary is elected anew among what is left."""
    left = tuple(s for s in session.sources if s.kind not in REFERENCE_KINDS)
    picks = [s for s in left if s.role == "PRIMARY"] or [s for s in left if s.kind == "e_invoice"] or list(left)
    kind = None if session.expected_primary_kind in REFERENCE_KINDS else session.expected_primary_kind
    required = session.required_ids and tuple(i for i in session.required_ids if i in {s.id for s in left})
    return replace(session, sources=left, primary_id=picks[0].id if picks else None, expected_primary_kind=kind, required_ids=required)


def logical_id(kind: str, role: str, fingerprints: list[str]) -> str:
    text = f"{intake._NAMES[kind]}_{ROLE_NAMES[role]}" + "".join(f"{f};" for f in sorted(fingerprints))
    return f"log_{kind}_{hashlib.sha256(text.encode()).hexdigest()[:10]}"


def written(session: Session, records: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The records, written once for all that reads them; those of like columns as one table, so that what they share is made once.

    Records with an untyped column, which files can't hold, stay as they are.
    """
    alike: dict[tuple, list[str]] = {}
    for s in session.sources:
        if not any("void" in kind for _, kind in records[s.id].dtypes):
            alike.setdefault(tuple(records[s.id].dtypes), []).append(s.id)
    out = dict(records)
    for ids in alike.values():
        table = intake.materialise(reduce(DataFrame.unionByName, [records[i].withColumn("__of", F.lit(i)) for i in ids]), "records")
        out |= {i: table.where(F.col("__of") == i).drop("__of") for i in ids}
    return out


def analyse(session: Session, records: Mapping[str, DataFrame]) -> tuple[list[dict], dict[str, int]]:
    """Every source with key, fingerprint, relation and eligibility; and the intake's counters. Conflicts stop the run.

    Records are read twice: see written().
    """
    parts = [records[s.id].withColumn("source_id", F.lit(s.id)).select("source_id", intake.digest(s.kind).alias("fp")) for s in session.sources]
    fingerprint, related = intake.contents(reduce(DataFrame.unionByName, parts), [s.id for s in session.sources])
    keys = {}
    for kind in {s.kind for s in session.sources}:
        rows = [records[s.id].withColumn("source_id", F.lit(s.id)) for s in session.sources if s.kind == kind]
        for r in intake.compatibility_keys(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), kind).collect():
            keys[r["source_id"]] = (r["bank_account"], r["entity_tax_id"], r["ledger_account"])
    described = [{"id": s.id, "kind": s.kind, "role": s.role, "key": (s.role, *keys.get(s.id, (None,) * 3)), "path": s.path, "sheet": s.sheet, "raw_hash": s.raw_hash, "fingerprint": fingerprint.get(s.id, hashlib.sha256(b"").hexdigest())} for s in session.sources]
    gated = intake.gate(described, related)
    n = lambda *r: sum(x["relation"] in r for x in gated)
    counters = {"physical": len(gated), "unique": n("UNIQUE"), "exact_duplicates": n("EXACT_DUPLICATE"), "content_duplicates": n("CONTENT_DUPLICATE"), "logical": len({(x["kind"], x["key"]) for x in gated if x["eligible"]})}
    return gated, counters


def merge_logical(session: Session, records: Mapping[str, DataFrame], on_disk: bool = False) -> tuple[Session, dict[str, DataFrame], dict[str, int]]:
    """Drop duplicate sources and merge disjoint parts of equal kind, role, entity and accounts into one logical source.

    Ids of the primary and of required sources follow through duplicates and parts. on_disk: the records are written steps
    already; else they are written once here, as they are read for digests, keys and parts.
    """
    records = records if on_disk else written(session, records)
    made, merged, counters = logical_sources(session, records)
    out = {}
    for source in made.sources:
        parts = merged.get(source.id)
        if parts is None:
            out[source.id] = records[source.id]
            continue
        rows = [records[i].withColumns({"source_id": F.lit(i), "fp": intake.digest(source.kind)}) for i in parts]
        out[source.id] = intake.merge_partitions(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), source.id)
    return made, out, counters


def logical_sources(session: Session, records: Mapping[str, DataFrame]) -> tuple[Session, dict[str, list[str]], dict[str, int]]:
    """What merge_logical() makes, without its rows: the session, the parts of each merged source by its id, and the counters."""
    gated, counters = analyse(session, records)
    remap = {x["id"]: x["other"] for x in gated if x["relation"] in ("EXACT_DUPLICATE", "CONTENT_DUPLICATE")}
    groups: dict[tuple, list[dict]] = {}
    for x in gated:
        if x["eligible"]:
            groups.setdefault((intake._NAMES[x["kind"]], ROLE_NAMES[x["role"]], *(str(k or "") for k in (x["key"][2], x["key"][1], x["key"][3]))), []).append(x)
    sources, merged = [], {}
    for _, parts in sorted(groups.items()):
        if len(parts) == 1:
            sources.append(session.source(parts[0]["id"]))
            continue
        parts.sort(key=lambda x: (x["fingerprint"], x["id"]))
        first = session.source(parts[0]["id"])
        name = logical_id(first.kind, first.role, [x["fingerprint"] for x in parts])
        remap |= {x["id"]: name for x in parts}
        sources.append(replace(first, id=name, name=f"{first.title} (Hợp nhất {len(parts)} phân đoạn)"))
        merged[name] = [x["id"] for x in parts]

    def resolve(i: str) -> str:
        while i in remap and remap[i] != i:
            i = remap[i]
        return i

    valid = {s.id for s in sources}
    primary = session.primary_id and resolve(session.primary_id)
    if primary and primary not in valid:
        primary = next((s.id for s in sources if s.role == "PRIMARY" or s.kind == "e_invoice"), session.primary_id)
    required = session.required_ids if session.required_ids is None else tuple(dict.fromkeys(r for r in map(resolve, session.required_ids) if r in valid))
    return replace(session, sources=tuple(sources), primary_id=primary, required_ids=required), merged, counters | {"logical": len(sources)}
