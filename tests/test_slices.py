"""Queries that return a slice of the revenue scenario don't make the rest of it."""

from ledgerloom.plans import more_queries, queries

SMALL = "/root/testdata/sf0.001"


def steps_read(df):
    return {path.rsplit("/", 2)[-2].split("-")[0] for path in df.inputFiles()}


def test_fallback_groups_are_told_without_the_residuals(spark):
    assert "left" not in steps_read(queries.taxid_fallback(spark, SMALL))


def test_residual_messages_are_told_without_what_controls_say(spark):
    out = more_queries.residual_messages(spark, SMALL)
    assert "sets" not in steps_read(out) and {"left", "rest"} <= steps_read(out)
    assert out.where("group_id LIKE 'grp_missing_source_%'").count() and out.where("group_id LIKE 'grp_unmatched_prim_%'").count()
