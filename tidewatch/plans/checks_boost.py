"""Queries on boosted trees of all walk-forward folds; the first tree has SQL, as its gradients have a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import boost, metrics
from tidewatch.plans import bindings as b
from tidewatch.plans.checks_learn import COLS, DEV
from tidewatch.plans.checks_panel import LABELLED
from tidewatch.plans.registry import query, shown

DEPTH = 3
FIT_ROWS = f""", train AS (SELECT f.community, f.fold_i, n.week_idx, CASE WHEN n.nx >= f.t2 THEN 1 ELSE 0 END AS y, r.n_train,
    row_number() OVER (PARTITION BY f.community, f.fold_i ORDER BY n.week_idx) AS place
  FROM fitted f JOIN fold_records r USING (community, fold_i) JOIN dev d ON d.community = f.community
  JOIN nexts n ON n.community = f.community AND n.week_idx < f.train_end - 1 AND n.nx IS NOT NULL WHERE f.test_idx < d.dev_n AND NOT r.skipped),
kept AS (SELECT *, count(*) FILTER (WHERE y = 1) OVER fold AS pos, count(*) FILTER (WHERE y = 0) OVER fold AS neg FROM train
  WHERE place <= n_train - least(greatest(20, CAST(round_even(n_train * 0.2, 0) AS INT)), greatest(n_train - 1, 0)) WINDOW fold AS (PARTITION BY community, fold_i)),
slopes AS (SELECT community, fold_i, week_idx, w * (0.5 - y) AS g, w * 0.25 AS h FROM (SELECT *, CASE WHEN y = 1 THEN least(8.0, neg / pos::DOUBLE) ELSE 1.0 END AS w FROM kept)),
inputs AS ({' UNION ALL '.join(f"SELECT community, week_idx, {i} AS feature, coalesce(CAST({c} AS DOUBLE), 0) AS value FROM scored" for i, c in enumerate(COLS))}),
binned AS MATERIALIZED (SELECT community, fold_i, week_idx, feature, value, floor((rank() OVER (part ORDER BY value) - 1) * {boost.BINS} / count(*) OVER part) AS bin
  FROM slopes JOIN inputs USING (community, week_idx) WINDOW part AS (PARTITION BY community, fold_i, feature)),
at0 AS MATERIALIZED (SELECT *, 1 AS node FROM slopes)"""
LEVEL = """, cells{k} AS (SELECT community, fold_i, node, feature, bin, sum(g) AS g, sum(h) AS h, min(value) AS threshold FROM at{k} JOIN binned USING (community, fold_i, week_idx) GROUP BY ALL),
halves{k} AS (SELECT u.community, u.fold_i, u.node, u.feature, u.bin, u.threshold, sum(v.g) AS g, sum(v.h) AS h, sum(v.g) FILTER (WHERE v.bin < u.bin) AS gl, sum(v.h) FILTER (WHERE v.bin < u.bin) AS hl
  FROM cells{k} u JOIN cells{k} v USING (community, fold_i, node, feature) GROUP BY ALL),
cuts{k} AS (SELECT *, round(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 9) AS gain FROM halves{k} WHERE round(hl, 9) >= 1 AND round(h - hl, 9) >= 1),
split{k} AS MATERIALIZED (SELECT * FROM cuts{k} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY community, fold_i, node ORDER BY gain DESC, feature, bin) = 1),
at{n} AS MATERIALIZED (SELECT a.community, a.fold_i, a.week_idx, a.g, a.h, 2 * a.node + CASE WHEN x.value >= s.threshold THEN 1 ELSE 0 END AS node
  FROM at{k} a JOIN split{k} s USING (community, fold_i, node) JOIN binned x USING (community, fold_i, week_idx, feature))"""
SPLITS = " UNION ALL ".join(
    f"SELECT community, CAST(fold_i AS BIGINT) AS fold_i, CAST(node AS BIGINT) AS node, CAST(feature AS BIGINT) AS feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM split{k}"
    for k in range(DEPTH))


@query("fold_tree_splits", "WITH " + b.RAW_SCORED + LABELLED.format(last="NULL") + DEV + FIT_ROWS + "".join(LEVEL.format(k=k, n=k + 1) for k in range(DEPTH)) + " " + SPLITS)
def fold_tree_splits(spark, sf):
    """Splits of the first tree of every fold of every community."""
    rows, _ = boost.fold_rows(b.stored(b.scored_panel(spark, sf, normalize=False)), COLS, cuts=b.CUTS)
    _, trees = boost.boost(rows, ["community", "fold_i"], trees=1, depth=DEPTH)
    return shown(trees.where("feature IS NOT NULL").select("community", "fold_i", "node", "feature", "threshold", "gain"))


@query("fold_tree_rows", "WITH " + b.RAW_SCORED + LABELLED.format(last="NULL") + DEV + FIT_ROWS + """
SELECT community, CAST(fold_i AS BIGINT) AS fold_i, count(*) AS n_fit, count(*) FILTER (WHERE g < 0) AS n_elevated, round(sum(h), 6) AS h FROM slopes GROUP BY ALL""")
def fold_tree_rows(spark, sf):
    """Rows of the fit of every fold, how many are elevated, and their summed second derivative at the first tree."""
    rows, _ = boost.fold_rows(b.stored(b.scored_panel(spark, sf, normalize=False)), COLS, cuts=b.CUTS)
    fit = rows.where("fit").groupBy("community", "fold_i")
    return shown(fit.agg(F.count("*").alias("n_fit"), F.count_if(F.col("y") == 1).alias("n_elevated"), F.sum(F.col("w") * 0.25).alias("h")))


@query("fold_tree_metrics")
def fold_tree_metrics(spark, sf):
    """Metrics of the walk-forward with boosted trees."""
    w = boost.walk_forward(b.stored(b.scored_panel(spark, sf, normalize=False)), COLS, cuts=b.CUTS)
    return shown(metrics.metric_pack(w.where("NOT skipped").withColumn("model", F.lit("trees"))))
