"""From files to a result in one call: sheets, what they are, canonical records, intake, matching.

    outcome = reconcile_files(spark, "/uploads/2026-03/*", "scenario_revenue_standard")
    xlsx.export_report(outcome.frames, "report.xlsx", outcome.session.primary().title)

Only what is one row a sheet or a source (kinds, mappings, fingerprints, relations) comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import infer, matching, normalize, sessions
from ledgerloom.plans.model import SCENARIOS, ReconciliationError, Session, Source
from ledgerloom.session import materialise
from ledgerloom.sources import workbooks, xlsx


@dataclass
class Outcome:
    session: Session
    frames: matching.Frames
    #: Physical, unique, duplicate and logical sources.
    counters: dict[str, int]
    #: Sheets that no rule of the scenario reads: a kind that isn't asked for, or none that is clear.
    left_out: tuple[Source, ...]


def read_sources(spark: SparkSession, path: str, sheet: str = "*") -> tuple[list[Source], dict[str, list[str]], DataFrame]:
    """Every sheet that holds something as a source of the kind it is taken for; its columns; and all rows by source id."""
    raw = workbooks.read_workbooks(spark, path, sheet).withColumnRenamed("source_id", "path")
    rows = materialise(raw.withColumn("source_id", F.concat("path", F.lit("#"), "sheet")), "sheets")
    seen = sorted(infer.infer_sources(rows, "sheet").collect(), key=lambda r: r.source_id)  # a row a sheet
    hashes = {r["path"].removeprefix("file:"): r["sha256"] for r in xlsx.files(spark, path).select("path", "sha256").collect()}
    sources, columns, ids = [], {}, []
    for i, r in enumerate(seen, 1):
        at, name = r.source_id.rsplit("#", 1)
        made = Source(f"s{i:03}", r.kind, name, sheet=name, path=at, header_row=r.header_row, data_start_row=r.data_start_row, mapping=dict(r.mapping), raw_hash=hashes.get(at.removeprefix("file:"), ""))
        sources.append(made)
        columns[made.id] = list(r.columns)
        ids += [F.lit(r.source_id), F.lit(made.id)]
    named = rows.withColumn("source_id", F.try_element_at(F.create_map(*ids), "source_id")) if ids else rows
    return sources, columns, named


def scenario_sources(scenario: str, sources: list[Source]) -> tuple[tuple[Source, ...], tuple[Source, ...]]:
    """The sources that a scenario reads, with their roles, the primary kind's first; and the others."""
    plan = SCENARIOS[scenario]
    wanted = {k for _, _, k, _ in plan.rules}
    if plan.primary_kind == "any":
        return sessions.assign_roles(tuple(sources), {}), ()
    roles = {plan.primary_kind: "PRIMARY"} | {k: "OPTIONAL" if k in plan.optional_kinds else "SECONDARY" for k in wanted}
    mine = sorted((s for s in sources if s.kind in roles), key=lambda s: s.kind != plan.primary_kind)
    return sessions.assign_roles(tuple(mine), roles), tuple(s for s in sources if s.kind not in roles)


def reconcile_files(spark: SparkSession, path: str, scenario: str = "scenario_revenue_standard", kinds: dict[str, str] | None = None) -> Outcome:
    """Reconcile workbooks under a path, a folder or a glob.

    kinds: what a sheet (by its name) is, where its looks aren't clear. Duplicates of a source are dropped and disjoint parts
    of one merged; a subset, an overlap or a lacking required source stops the run.
    """
    found, columns, rows = read_sources(spark, path)
    found = [replace(s, kind=(kinds or {}).get(s.sheet, s.kind)) for s in found]
    mine, left_out = scenario_sources(scenario, found)
    if len(mine) < 2:
        raise ReconciliationError("TOO_FEW_SOURCES", ", ".join(f"{s.path}#{s.sheet}: {s.kind}" for s in found) or path)
    records = {s.id: materialise(normalize.canonical(rows.where(F.col("source_id") == s.id).select("row_idx", "cells"), s, columns[s.id]), "records") for s in mine}
    session = SCENARIOS[scenario].session(f"upload_{scenario}", mine)
    session, records, counters = sessions.merge_logical(session, records, on_disk=True)
    need = {k for _, _, k, _ in SCENARIOS[scenario].rules} - set(SCENARIOS[scenario].optional_kinds)
    session = replace(session, required_kinds=tuple(sorted(need)))
    return Outcome(session, matching.reconcile(session, records), counters, left_out)
