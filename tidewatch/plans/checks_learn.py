"""Queries that fit models.  Their values depend on a numeric fit, so only what has a closed form gets SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import folds, learn, metrics, serve, stats
from tidewatch.plans import bindings as b
from tidewatch.plans.checks_panel import LABELLED
from tidewatch.plans.checks_stats import COMMUNITIES
from tidewatch.plans.registry import query, shown

COLS = ["post_volume", "unique_posters", "new_poster_ratio", "avg_negative", "hopelessness_density", "isolation_density"]
DEV = ", dev AS (SELECT community, CASE WHEN count(*) <= 28 THEN count(*) ELSE count(*) - least(12, greatest(0, count(*) - 28)) END AS dev_n FROM scored GROUP BY community)"


def _raw(spark, sf):
    return b.stored(b.scored_panel(spark, sf, normalize=False))


@query("model_walk_forward")
def model_walk_forward(spark, sf):
    return shown(learn.walk_forward(_raw(spark, sf), COLS, cuts=b.CUTS))


@query("walk_forward_actuals", "WITH " + b.RAW_SCORED + LABELLED.format(last="NULL") + DEV + f"""
SELECT f.community, f.fold_i, f.test_idx AS week_idx, r.n_train, r.n_crisis_train, r.skipped, CAST(CASE WHEN next_score IS NOT NULL THEN CASE WHEN next_score >= t2 THEN 1 ELSE 0 END END AS BIGINT) AS actual
FROM fitted f JOIN fold_records r USING (community, fold_i) JOIN dev d USING (community) WHERE f.test_idx < d.dev_n""")
def walk_forward_actuals(spark, sf):
    """Labels, skips and actuals of the walk-forward job; the fitted probabilities have no SQL."""
    w = learn.walk_forward(_raw(spark, sf), COLS, cuts=b.CUTS)
    return shown(w.select("community", "fold_i", "week_idx", "n_train", "n_crisis_train", "skipped", "actual"))


@query("walk_forward_metrics")
def walk_forward_metrics(spark, sf):
    w = learn.walk_forward(_raw(spark, sf), COLS, cuts=b.CUTS)
    return shown(metrics.metric_pack(w.where("not skipped").withColumn("model", F.lit("tabular"))))


SEQ_GRID = """, dev AS (SELECT community, CASE WHEN count(*) <= 34 THEN count(*) ELSE count(*) - least(12, greatest(0, count(*) - 34)) END AS dev_n FROM scored GROUP BY community),
expanding AS (SELECT community, week_idx, lead(distress_score) OVER (PARTITION BY community ORDER BY week_start) AS nx, avg(distress_score) OVER w AS mean, stddev_samp(distress_score) OVER w AS std
  FROM scored WINDOW w AS (PARTITION BY community ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING))"""


@query("sequence_actuals", "WITH " + b.RAW_SCORED + SEQ_GRID + f""" SELECT community, week_idx - 33 AS fold_i, week_idx, CAST({b.bucket_sql('nx', ('mean + 0.3 * std', 'mean + 0.6 * std', 'mean + std'))} AS BIGINT) AS actual, week_idx - 2 AS n_train
FROM expanding JOIN dev USING (community) WHERE week_idx >= 33 AND week_idx < dev_n""")
def sequence_actuals(spark, sf):
    """Folds and 4-class actuals of the sequence job."""
    w = learn.walk_forward(_raw(spark, sf), COLS, cuts=b.CUTS, sequence_length=6)
    return shown(w.select("community", "fold_i", "week_idx", "actual", "n_train"))


@query("sequence_classifier")
def sequence_classifier(spark, sf):
    return shown(learn.walk_forward(_raw(spark, sf), COLS, cuts=b.CUTS, sequence_length=6))


@query("sequence_search")
def sequence_search(spark, sf):
    """Trials of the search over window length and penalty, by successive halving."""
    return shown(learn.search_sequence(_raw(spark, sf), COLS, cuts=b.CUTS))


@query("holdout_predictions")
def holdout_predictions(spark, sf):
    raw = _raw(spark, sf)
    return shown(learn.holdout_predictions(raw, COLS, learn.final_models(raw, COLS, cuts=b.CUTS), cuts=b.CUTS))


LABELS = """, cut AS (SELECT community, avg(distress_score) + 0.3 * stddev_samp(distress_score) AS t1, avg(distress_score) + 0.6 * stddev_samp(distress_score) AS t2, avg(distress_score) + stddev_samp(distress_score) AS t3
  FROM scored JOIN dev USING (community) WHERE week_idx < dev_n GROUP BY community),
nexts AS (SELECT community, week_idx, lead(distress_score) OVER (PARTITION BY community ORDER BY week_start) AS nx FROM scored)"""


@query("holdout_actuals", "WITH " + b.RAW_SCORED + DEV + LABELS + """ SELECT community, week_idx, CAST(CASE WHEN nx >= t2 THEN 1 ELSE 0 END AS BIGINT) AS actual FROM nexts JOIN cut USING (community) JOIN dev USING (community)
WHERE week_idx >= dev_n AND nx IS NOT NULL""")
def holdout_actuals(spark, sf):
    raw = _raw(spark, sf)
    h = learn.holdout_predictions(raw, COLS, learn.final_models(raw, COLS, cuts=b.CUTS), cuts=b.CUTS)
    return shown(h.select("community", "week_idx", "actual"))


@query("holdout_sequence")
def holdout_sequence(spark, sf):
    raw = _raw(spark, sf)
    m = learn.final_models(raw, COLS, cuts=b.CUTS, sequence_length=6, method="isotonic")
    return shown(learn.holdout_predictions(raw, COLS, m, cuts=b.CUTS, sequence_length=6))


@query("transfer")
def transfer(spark, sf):
    return shown(learn.transfer(_raw(spark, sf), COLS, COMMUNITIES, b.CUTS))


@query("transfer_support", "WITH " + b.RAW_SCORED + """, c AS (SELECT community, avg(distress_score) + 0.6 * stddev_samp(distress_score) AS t2 FROM scored GROUP BY community),
n AS (SELECT community, lead(distress_score) OVER (PARTITION BY community ORDER BY week_start) AS nx FROM scored),
s AS (SELECT community, count(*) AS n_test, count(*) FILTER (WHERE nx >= t2) AS n_positive FROM n JOIN c USING (community) WHERE nx IS NOT NULL GROUP BY community)
SELECT a.community AS source, z.community AS target, z.n_test, z.n_positive FROM s a JOIN s z ON a.community <> z.community WHERE a.n_positive >= 2""")
def transfer_support(spark, sf):
    """Pairs and test weeks of the transfer job."""
    return learn.transfer(_raw(spark, sf), COLS, COMMUNITIES, b.CUTS).select("source", "target", "n_test", "n_positive")


@query("ablation")
def ablation(spark, sf):
    return shown(learn.ablation(_raw(spark, sf), COLS, cuts=b.CUTS))


@query("permutation_importance")
def permutation_importance(spark, sf):
    rows = b.stored(learn.labeled_rows(_raw(spark, sf), COLS, b.CUTS))
    return shown(learn.permutation_importance(rows, b.stored(learn.fit_variants(rows, None, len(COLS))), COLS))


@query("pooled_trees")
def pooled_trees(spark, sf):
    """Boosted trees over all communities, scored in-sample."""
    rows = b.stored(learn.labeled_rows(_raw(spark, sf), COLS, b.CUTS))
    p = learn.gbt_probability(rows, learn.fit_gbt(rows))
    return shown(metrics.average_precision(p.select("community", F.lit("trees").alias("model"), "prob", F.lit(0).alias("pred"), F.col("y").alias("actual"))))


@query("batch_score")
def batch_score(spark, sf):
    raw = _raw(spark, sf)
    tab = b.stored(learn.final_models(raw, COLS, cuts=b.CUTS))
    seq = learn.predict(raw, COLS, learn.final_models(raw, COLS, cuts=b.CUTS, sequence_length=6), 6)
    out = serve.score_batch(
        raw, tab.select("community", "model"), COLS, stats=stats.train_stats(raw, COLS), calibrators=tab.select("community", "calibrator"),
        sequence=seq.select("community", "week_start", "probs"), monitoring_only=["5-low"], max_sigma=4.0)
    return shown(out.withColumn("violations", F.array_join("violations", ",")).withColumn("drift_warnings", F.size("drift_warnings")))


CHECKED = ", long AS (" + " UNION ALL ".join(f"SELECT community, week_start, '{c}' AS feature, {c} AS value FROM panel" for c in COLS) + """),
st AS (SELECT community, feature, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std FROM long GROUP BY ALL),
j AS (SELECT l.*, mean, std, abs(value - mean) AS d FROM long l JOIN st USING (community, feature))"""


@query("batch_checks", "WITH " + b.RAW_SCORED + CHECKED + """ SELECT community, week_start, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE std > 0 AND d / std > 4), '') AS violations,
  count(*) FILTER (WHERE std > 0 AND d > 2.5 * std) AS n_warnings, count(*) FILTER (WHERE std > 0 AND d > 2.5 * std) > 0 AS has_drift,
  community <> '5-low' AND count(*) FILTER (WHERE std > 0 AND d / std > 4) = 0 AS prediction_available FROM j GROUP BY community, week_start""")
def batch_checks(spark, sf):
    """Guardrail, drift warnings and availability of the scoring job."""
    raw = _raw(spark, sf)
    tab = b.stored(learn.final_models(raw, COLS, cuts=b.CUTS))
    out = serve.score_batch(raw, tab.select("community", "model"), COLS, stats=stats.train_stats(raw, COLS), monitoring_only=["5-low"], max_sigma=4.0)
    return shown(out.select("community", "week_start", F.array_join("violations", ",").alias("violations"), F.size("drift_warnings").alias("n_warnings"), "has_drift", "prediction_available"))


@query("model_info")
def model_info(spark, sf):
    raw = _raw(spark, sf)
    pack = metrics.metric_pack(b.binary_predictions(spark, sf)).select("community", "model", "recall", "pr_auc")
    rows = learn.labeled_rows(raw, COLS, b.CUTS)
    imp = learn.linear_attribution(rows, learn.fit_variants(rows, None, len(COLS)), COLS)
    weeks = folds.holdout_split(raw).select("community", F.col("dev_n").alias("n_training_weeks"))
    return shown(serve.model_info(pack, imp, weeks).withColumn("top_features", F.array_join("top_features", ",")))
