"""How datasets relate, against sets in plain Python, and that digests of all datasets aren't joined with each other."""

import random
import re
from itertools import combinations

from ledgerloom.operators import intake


def test_relations_are_counted_not_joined(spark, monkeypatch):
    seen, write = [], intake.materialise
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(intake, "materialise", lambda df, label="step": seen.append(plan(df)) or write(df, label))
    draw = random.Random(5)
    sets = {s: [f"{draw.randrange(n):064x}" for _ in range(60)] for s, n in (("a", 40), ("b", 200), ("c", 200))}
    sets |= {"part": sets["a"][:9], "copy": list(reversed(sets["a"])), "twice": sets["a"] + sets["a"], "far": ["f" * 64], "none": [None, None]}
    sets["a"] = [*sets["a"], None]
    sets["copy"] = [*sets["copy"], None]
    rows = [(s, fp) for s, fps in sets.items() for fp in fps]
    related = intake.relations(spark.createDataFrame(rows, "source_id string, fp string"))
    seen.append(plan(related))
    assert not any(re.search(r"Join[^\n]*fp#", p) for p in seen)
    got = {(r.a, r.b): (r.shared, r.n_a, r.n_b, r.relation) for r in related.collect()}
    want = {}
    for a, b in combinations(sorted(sets), 2):
        x, y = set(sets[a]), set(sets[b])
        shared = len((x & y) - {None})
        if shared:
            full = "CONTENT_DUPLICATE" if {a, b} == {"a", "copy"} else "SUBSET_DUPLICATE" if shared in (len(x), len(y)) else "PARTIAL_OVERLAP"
            want[a, b] = (shared, len(x), len(y), full)
    assert got == want
