"""Every registered query beside its SQL on the smallest tables, and plan checks."""

import duckdb
import pytest

from tidewatch.plans import catalog
from tools.check_oracle import TABLES, rows_of

SLOW = {"topic_model", "pooled_trees", "sequence_classifier", "model_info", "batch_score"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toArrow()
    if name in catalog.ORACLE:
        assert rows_of(got) == rows_of(con.sql(catalog.ORACLE[name]).to_arrow_table())


def plan(spark, sf, name):
    return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_plans(spark, sf):
    for name in ("feature_matrix", "drift_levels", "weekly_panel", "binary_metrics", "template_brief", "scenario_what_if", "event_calendar", "replay_asof"):
        p = plan(spark, sf, name)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_texts_are_never_shuffled(spark, sf):
    """The exchanges of the feature job carry partial sums, not texts."""
    p = plan(spark, sf, "feature_matrix")
    for part in p.split("Exchange hashpartitioning")[1:]:
        head = part.split("\n")[1]
        assert "clean_text" not in head and "selftext" not in head


def test_column_pruning(spark, sf):
    p = plan(spark, sf, "new_author_ratio")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in p


@pytest.mark.parametrize("name", ("ensemble_merge", "ensemble_scored", "replay_rows", "replay_asof"))
def test_all_weeks_have_their_query(name):
    """The queries with gaps have one beside them that reads every week."""
    sql = catalog.ORACLE[f"{name}_weeks"]
    assert "week_idx %" not in sql and "1996" not in sql and sql != catalog.ORACLE[name]
