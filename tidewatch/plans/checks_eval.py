"""Queries over the long prediction table: metrics, ranking, lead time, calibration, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import mathx
from tidewatch.operators import decide, metrics
from tidewatch.plans import bindings as b
from tidewatch.plans.registry import ORACLE, query, shown

P = "WITH " + b.PREDICTIONS


@query("prediction_series", P + " SELECT community, week_idx, model, CAST(pred AS BIGINT) AS pred, round(prob, 6) AS prob, CAST(actual AS BIGINT) AS actual FROM predictions")
def prediction_series(spark, sf):
    return shown(b.predictions(spark, sf).drop("week_start"))


CONFUSION = """, tally AS (SELECT community, model, count(*) AS n, count(*) FILTER (WHERE pred = 1 AND actual = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND actual = 0) AS fp,
  count(*) FILTER (WHERE pred = 0 AND actual = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND actual = 0) AS tn FROM evaluated GROUP BY ALL)"""


def _r(num: str, den: str) -> str:
    return f"round(CASE WHEN {den} > 0 THEN ({num})::DOUBLE / ({den}) ELSE 0 END, 6)"


@query("confusion_breakdown", P + CONFUSION + f""" SELECT community, model, tp, fp, fn, tn, {_r('tp', 'tp + fp')} AS precision, {_r('tp', 'tp + fn')} AS recall, {_r('2 * tp', '2 * tp + fp + fn')} AS f1,
  {_r('fp', 'fp + tn')} AS false_alarm_rate, {_r('fn', 'fn + tp')} AS miss_rate FROM tally""")
def confusion_breakdown(spark, sf):
    return shown(metrics.confusion(b.binary_predictions(spark, sf)))


AREAS = """, ties AS (SELECT community, model, prob, count(*) AS n, sum(actual) AS tp FROM evaluated GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(tp) OVER w AS ctp, sum(tp) OVER (PARTITION BY community, model) AS pos, sum(n) OVER (PARTITION BY community, model) AS tot
  FROM ties WINDOW w AS (PARTITION BY community, model ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)),
areas AS (SELECT community, model, coalesce(sum(tp::DOUBLE / nullif(pos, 0) * ctp / cn), 0) AS pr_auc,
  sum((n - tp) * (ctp - tp + tp / 2.0::DOUBLE)) / nullif(max(pos * (tot - pos)), 0)::DOUBLE AS roc_auc FROM cum GROUP BY ALL)"""
PACK = CONFUSION + AREAS + f""", pack AS (SELECT community, model, n AS n_valid_predictions, tp + fn AS n_crisis_actual, tp + fp AS n_crisis_predicted,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp, fp, fn, tn, pr_auc, roc_auc FROM tally JOIN areas USING (community, model))"""


@query("binary_metrics", P + PACK + """ SELECT community, model, n_valid_predictions, n_crisis_actual, n_crisis_predicted, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(f1, 6) AS f1, tp, fp, fn, tn, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM pack""")
def binary_metrics(spark, sf):
    return shown(metrics.metric_pack(b.binary_predictions(spark, sf)))


@query("pr_auc", P + AREAS + " SELECT community, model, round(pr_auc, 6) AS pr_auc FROM areas")
def pr_auc(spark, sf):
    return shown(metrics.average_precision(b.binary_predictions(spark, sf)))


@query("roc_auc", P + """, ranked AS (SELECT community, model, actual, rank() OVER (PARTITION BY community, model ORDER BY prob) + (count(*) OVER (PARTITION BY community, model, prob) - 1) / 2.0::DOUBLE AS r FROM evaluated)
SELECT community, model, round((sum(r) FILTER (WHERE actual = 1) - count(*) FILTER (WHERE actual = 1) * (count(*) FILTER (WHERE actual = 1) + 1) / 2.0::DOUBLE)
  / nullif(count(*) FILTER (WHERE actual = 1) * count(*) FILTER (WHERE actual = 0), 0), 6) AS roc_auc FROM ranked GROUP BY ALL""")
def roc_auc(spark, sf):
    return shown(metrics.roc_auc(b.binary_predictions(spark, sf)))


TOPK = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY community, model ORDER BY prob DESC, week_idx) AS r,
    coalesce(lag(actual) OVER (PARTITION BY community, model ORDER BY week_idx), 0) AS previous FROM evaluated),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY community, model ORDER BY previous DESC, week_idx) AS r2 FROM ranked),
topk AS (SELECT community, model, CAST(k AS BIGINT) AS k, count(*) AS n_weeks, CAST(sum(actual) AS BIGINT) AS total_positives, CAST(coalesce(sum(actual) FILTER (WHERE r <= k), 0) AS BIGINT) AS captured,
  CAST(coalesce(sum(actual) FILTER (WHERE r2 <= k), 0) AS BIGINT) AS persistence_captured FROM ranked2 CROSS JOIN (VALUES (1), (2), (3), (5)) t(k) GROUP BY ALL)"""


@query("recall_at_k", P + TOPK + f" SELECT community, model, n_weeks, total_positives, k, captured, {_r('captured', 'total_positives')} AS recall FROM topk")
def recall_at_k(spark, sf):
    return shown(metrics.top_k_recall(b.binary_predictions(spark, sf)))


@query("decision_usefulness", P + TOPK + f""" SELECT community, model, n_weeks, total_positives, k, captured, {_r('captured', 'total_positives')} AS recall,
  round(CASE WHEN total_positives > 0 THEN least(k, n_weeks)::DOUBLE / n_weeks ELSE 0 END, 6) AS random_recall, persistence_captured, {_r('persistence_captured', 'total_positives')} AS persistence_recall FROM topk""")
def decision_usefulness(spark, sf):
    return shown(metrics.decision_usefulness(b.binary_predictions(spark, sf)))


@query("recall_table", P + TOPK + f""" SELECT community, model, k, captured, total_positives, {_r('captured', 'total_positives')} AS recall,
  round(CASE WHEN total_positives > 0 THEN least(k, n_weeks)::DOUBLE / n_weeks ELSE 0 END, 6) AS random_recall, {_r('persistence_captured', 'total_positives')} AS persistence_recall FROM topk""")
def recall_table(spark, sf):
    reports = metrics.usefulness_json(metrics.decision_usefulness(b.binary_predictions(spark, sf)))
    return shown(metrics.recall_table_from_json(reports))


LEAD = """, flags AS (SELECT *, coalesce(CASE WHEN actual >= 1 THEN 1 ELSE 0 END, 0) AS hot, coalesce(CASE WHEN pred >= 1 THEN 1 ELSE 0 END, 0) AS flag FROM binary_predictions),
islands AS (SELECT *, sum(1 - flag) OVER (PARTITION BY community, model ORDER BY week_idx) AS island FROM flags),
runs AS (SELECT *, sum(flag) OVER (PARTITION BY community, model, island ORDER BY week_idx) AS run FROM islands),
leads AS (SELECT community, model, week_idx, hot, lag(hot, 1, 0) OVER w AS hot_before, coalesce(lag(run) OVER w, 0) AS lead FROM runs WINDOW w AS (PARTITION BY community, model ORDER BY week_idx)),
onsets AS (SELECT community, model, week_idx, CAST(lead AS BIGINT) AS lead FROM leads WHERE hot = 1 AND hot_before = 0)"""


@query("lead_times", P + LEAD + " SELECT community, model, week_idx, lead FROM onsets")
def lead_times(spark, sf):
    return shown(metrics.lead_times(b.binary_predictions(spark, sf)))


@query("lead_time_summary", P + LEAD + """ SELECT community, model, count(*) AS n_onsets, round(avg(lead), 6) AS mean, round(quantile_cont(lead::DOUBLE, 0.5), 6) AS p50,
  round(quantile_cont(lead::DOUBLE, 0.75), 6) AS p75, round(quantile_cont(lead::DOUBLE, 0.9), 6) AS p90 FROM onsets GROUP BY ALL""")
def lead_time_summary(spark, sf):
    return shown(metrics.lead_time_summary(b.binary_predictions(spark, sf)))


BIN = "CASE " + " ".join(f"WHEN prob >= {i / 10!r}::DOUBLE THEN {i}" for i in range(9, 0, -1)) + " ELSE 0 END"


@query("reliability_bins", P + f""" SELECT community, model, CAST({BIN} AS BIGINT) AS bin, count(*) AS n, round(avg(prob), 6) AS mean_predicted, round(avg(actual), 6) AS mean_actual,
  round(avg(prob) - avg(actual), 6) + 0.0 AS gap FROM evaluated GROUP BY ALL""")
def reliability_bins(spark, sf):
    return shown(metrics.reliability(b.binary_predictions(spark, sf)))


@query("calibration_verdict", P + """ SELECT community, model, count(*) AS n, round(avg(prob), 6) AS mean_predicted, round(avg(actual), 6) AS mean_actual, round(avg(prob) - avg(actual), 6) + 0.0 AS gap,
  CASE WHEN count(*) < 20 THEN 'insufficient_data' WHEN avg(prob) - avg(actual) > 0.05 THEN 'over-confident' WHEN avg(prob) - avg(actual) < -0.05 THEN 'under-confident' ELSE 'well-calibrated' END AS verdict FROM evaluated GROUP BY ALL""")
def calibration_verdict(spark, sf):
    return shown(metrics.calibration_verdict(b.binary_predictions(spark, sf)))


@query("threshold_sweep", P + f""", s AS (SELECT community, model, t::DOUBLE AS threshold, count(*) FILTER (WHERE prob >= t AND actual = 1) AS tp, count(*) FILTER (WHERE prob >= t) AS n_alerts, count(*) FILTER (WHERE actual = 1) AS pos
  FROM evaluated CROSS JOIN (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) v(t) GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_alerts + pos > 0 THEN 2.0::DOUBLE * tp / (n_alerts + pos) ELSE 0 END AS f FROM s)
SELECT community, model, threshold, n_alerts, {_r('tp', 'n_alerts')} AS precision, {_r('tp', 'pos')} AS recall, round(f, 6) AS f1,
  row_number() OVER (PARTITION BY community, model ORDER BY f DESC, threshold) = 1 AS is_best FROM m""")
def threshold_sweep(spark, sf):
    return shown(metrics.threshold_sweep(b.binary_predictions(spark, sf)))


@query("error_timeline", P + " SELECT community, model, week_idx, CASE WHEN pred = 1 THEN 'false_positive' ELSE 'false_negative' END AS error_type FROM evaluated WHERE pred <> actual")
def error_timeline(spark, sf):
    return shown(metrics.error_timeline(b.binary_predictions(spark, sf)))


FOUR = """, cells AS (SELECT community, CAST(a AS BIGINT) AS actual, CAST(q AS BIGINT) AS pred, count(*) FILTER (WHERE p.actual = a AND p.pred = q) AS n
  FROM (SELECT * FROM predictions WHERE model = 'sequence' AND pred IS NOT NULL AND actual IS NOT NULL) p CROSS JOIN range(4) x(a) CROSS JOIN range(4) y(q) GROUP BY ALL)"""


def _sequence(spark, sf):
    return b.predictions(spark, sf).where("model = 'sequence'").drop("model")


@query("confusion_4class", P + FOUR + " SELECT community, actual, pred, n FROM cells")
def confusion_4class(spark, sf):
    return shown(metrics.confusion_4class(_sequence(spark, sf)))


@query("class_recall", P + FOUR + """, c AS (SELECT community, CAST(s AS BIGINT) AS state, CAST(sum(n) FILTER (WHERE actual = s AND pred = s) AS BIGINT) AS hit, CAST(sum(n) FILTER (WHERE actual = s) AS BIGINT) AS support,
  CAST(sum(n) FILTER (WHERE pred = s) AS BIGINT) AS predicted FROM cells CROSS JOIN range(4) z(s) GROUP BY ALL)""" + f" SELECT *, {_r('hit', 'support')} AS recall, {_r('hit', 'predicted')} AS precision FROM c")
def class_recall(spark, sf):
    return shown(metrics.per_class(_sequence(spark, sf)))


PAIR = """, a AS (SELECT * FROM predictions WHERE model = 'sequence' AND week_idx % 7 <> 0), t AS (SELECT * FROM predictions WHERE model = 'tabular' AND week_idx % 5 <> 0)"""


def _pair(spark, sf):
    p = b.stored(b.predictions(spark, sf))
    return p.where("model = 'sequence' AND week_idx % 7 <> 0"), p.where("model = 'tabular' AND week_idx % 5 <> 0")


@query("ensemble_merge", P + PAIR + """ SELECT community, week_idx, CAST(CASE WHEN a.pred IS NOT NULL AND t.pred IS NOT NULL THEN greatest(a.pred, t.pred) ELSE coalesce(a.pred, t.pred) END AS BIGINT) AS pred,
  round(coalesce((a.prob + t.prob) / 2, a.prob, t.prob), 6) AS prob, CAST(coalesce(a.actual, t.actual) AS BIGINT) AS actual FROM a FULL JOIN t USING (community, week_idx)""")
def ensemble_merge(spark, sf):
    return shown(metrics.merge_models(*_pair(spark, sf)))


@query("ensemble_scored", P + PAIR + """, e AS (SELECT community, week_idx, coalesce((a.prob + t.prob) / 2, a.prob, t.prob) AS prob, coalesce(a.actual, t.actual * 2) AS actual FROM a FULL JOIN t USING (community, week_idx)),
v AS (SELECT community FROM e WHERE prob IS NOT NULL AND actual IS NOT NULL GROUP BY community HAVING count(*) >= 5)
SELECT community, week_idx, CAST(CASE WHEN prob >= 0.3 THEN 2 WHEN prob IS NOT NULL THEN 0 END AS BIGINT) AS pred, round(prob, 6) AS prob, CAST(actual AS BIGINT) AS actual FROM e JOIN v USING (community)""")
def ensemble_scored(spark, sf):
    return shown(metrics.ensemble(*_pair(spark, sf)))


PAIR_WEEKS = """, a AS (SELECT * FROM predictions WHERE model = 'sequence'), t AS (SELECT * FROM predictions WHERE model = 'tabular')"""


def _pair_weeks(spark, sf):
    p = b.stored(b.predictions(spark, sf))
    return p.where("model = 'sequence'"), p.where("model = 'tabular'")


@query("ensemble_merge_weeks", ORACLE["ensemble_merge"].replace(PAIR, PAIR_WEEKS))
def ensemble_merge_weeks(spark, sf):
    """``ensemble_merge`` over all weeks of both models."""
    return shown(metrics.merge_models(*_pair_weeks(spark, sf)))


@query("ensemble_scored_weeks", ORACLE["ensemble_scored"].replace(PAIR, PAIR_WEEKS))
def ensemble_scored_weeks(spark, sf):
    """``ensemble_scored`` over all weeks of both models."""
    return shown(metrics.ensemble(*_pair_weeks(spark, sf)))


@query("array_results", P + """, g AS (SELECT community, count(*) + 3 AS n FROM predictions WHERE model = 'tabular' GROUP BY community),
s AS (SELECT community, CAST(unnest(generate_series(0, n - 1)) AS BIGINT) AS week_idx FROM g)
SELECT s.community, s.week_idx, CAST(p.pred AS DOUBLE) AS pred, round(p.prob, 6) AS prob, CAST(p.actual AS DOUBLE) AS actual FROM s LEFT JOIN predictions p ON p.community = s.community AND p.week_idx = s.week_idx AND p.model = 'tabular'""")
def array_results(spark, sf):
    p = b.stored(b.predictions(spark, sf).where("model = 'tabular'"))
    val = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    rows = F.array_sort(F.collect_list(F.struct("week_idx", val("pred").alias("p"), val("prob").alias("q"), val("actual").alias("a"))))
    arrays = p.groupBy("community").agg(rows.alias("r")).select(
        "community", F.col("r.p").alias("predictions"), F.col("r.q").alias("probabilities"), F.col("r.a").alias("actuals"))
    sizes = p.groupBy("community").agg((F.count("*") + 3).alias("n_weeks"))
    return shown(metrics.explode_arrays(arrays, sizes))


@query("model_comparison", P + PACK + """ SELECT community, """ + ", ".join(
    f"round(max({n}) FILTER (WHERE model = '{m}'), 6) AS {m}_{n}" for m in ("tabular", "sequence") for n in ("recall", "precision", "f1", "pr_auc", "roc_auc")) + " FROM pack GROUP BY community")
def model_comparison(spark, sf):
    return shown(metrics.compare_models(metrics.metric_pack(b.binary_predictions(spark, sf)), ("tabular", "sequence")))


@query("section_summary", P + PACK + " SELECT community, " + ", ".join(
    f"round(max({n}) FILTER (WHERE model = '{m}'), 6) AS {m}_{n}" for m in ("tabular", "sequence") for n in ("pr_auc", "recall")) + ", count(*) FILTER (WHERE n_crisis_actual < 10) AS alerts FROM pack GROUP BY community")
def section_summary(spark, sf):
    return shown(metrics.section_summary(metrics.metric_pack(b.binary_predictions(spark, sf)), ("tabular", "sequence")))


@query("performance_bands", P + PACK + """, w AS (SELECT community, max(pr_auc) FILTER (WHERE model = 'tabular') AS t, max(pr_auc) FILTER (WHERE model = 'sequence') AS s FROM pack GROUP BY community)
SELECT community, round(greatest(t, s), 6) AS best_pr_auc, CASE WHEN s > t THEN 'sequence' ELSE 'tabular' END AS winner, CASE WHEN greatest(t, s) >= 0.45 THEN 'High' WHEN greatest(t, s) < 0.20 THEN 'Low' ELSE 'Medium' END AS band FROM w""")
def performance_bands(spark, sf):
    return shown(metrics.performance_bands(metrics.metric_pack(b.binary_predictions(spark, sf)), "tabular", "sequence"))


@query("anomaly_flags", P + PACK + """ SELECT community, model, 'low crisis support' AS flag FROM pack WHERE n_crisis_actual < 10 UNION ALL SELECT community, model, 'recall is zero' FROM pack WHERE recall <= 0
UNION ALL SELECT community, model, 'PR-AUC very low' FROM pack WHERE pr_auc < 0.12 UNION ALL SELECT community, model, 'ROC-AUC below random' FROM pack WHERE roc_auc < 0.5""")
def anomaly_flags(spark, sf):
    return metrics.anomaly_flags(metrics.metric_pack(b.binary_predictions(spark, sf)))


@query("average_metrics", P + PACK + " SELECT community, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1, round(avg(pr_auc), 6) AS pr_auc FROM pack GROUP BY community")
def average_metrics(spark, sf):
    return shown(metrics.average_metrics(metrics.metric_pack(b.binary_predictions(spark, sf))))


@query("monitoring_only", P + PACK + " SELECT community, model, n_crisis_actual, n_crisis_actual < 80 AS monitoring_only FROM pack")
def monitoring_only(spark, sf):
    return metrics.monitoring_only(metrics.metric_pack(b.binary_predictions(spark, sf)), 80)


@query("calibrator_apply", P + """ SELECT community, model, week_idx, round(CASE WHEN week_idx % 3 = 0 THEN 1 / (1 + exp(-(2.5::DOUBLE * prob - 1.0::DOUBLE))) WHEN week_idx % 3 = 1 THEN
  CASE WHEN prob <= 0.1 THEN 0.05::DOUBLE WHEN prob <= 0.4 THEN 0.05::DOUBLE + 0.25::DOUBLE * (prob - 0.1::DOUBLE) / 0.3::DOUBLE WHEN prob <= 0.8 THEN 0.3::DOUBLE + 0.6::DOUBLE * (prob - 0.4::DOUBLE) / 0.4::DOUBLE ELSE 0.9::DOUBLE END
  ELSE prob END, 6) AS calibrated FROM predictions WHERE prob IS NOT NULL""")
def calibrator_apply(spark, sf):
    nothing = F.array().cast("array<double>")
    kind = lambda t, c, i, x, y: F.struct(F.lit(t).alias("type"), F.lit(c).alias("coef"), F.lit(i).alias("intercept"), x.alias("x"), y.alias("y"))
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    p = b.predictions(spark, sf).where(F.col("prob").isNotNull())
    cal = (F.when(F.col("week_idx") % 3 == 0, kind("platt", 2.5, -1.0, nothing, nothing))
           .when(F.col("week_idx") % 3 == 1, kind("isotonic", 1.0, 0.0, arr(0.1, 0.4, 0.8), arr(0.05, 0.3, 0.9)))
           .otherwise(kind("identity", 1.0, 0.0, nothing, nothing)))
    return shown(p.withColumn("cal", cal).select("community", "model", "week_idx", metrics.apply_calibrator(F.col("prob"), F.col("cal")).alias("calibrated")))


@query("rescaled_classes", P + """, q AS (SELECT community, week_idx, prob, (1 - prob) * 0.5::DOUBLE AS p0, (1 - prob) * 0.5::DOUBLE AS p1, prob * 0.25::DOUBLE AS p2, prob * 0.75::DOUBLE AS p3 FROM predictions WHERE model = 'sequence' AND prob IS NOT NULL)
SELECT community, week_idx, round(p0, 6) AS p0, round(p1, 6) AS p1, round(CASE WHEN p2 + p3 > 0 THEN least(1, p2 * (1 / (1 + exp(-(2 * prob - 1)))) / (p2 + p3)) ELSE p2 END, 6) AS p2,
  round(CASE WHEN p2 + p3 > 0 THEN least(1, p3 * (1 / (1 + exp(-(2 * prob - 1)))) / (p2 + p3)) ELSE p3 END, 6) AS p3 FROM q""")
def rescaled_classes(spark, sf):
    p = _sequence(spark, sf).where(F.col("prob").isNotNull())
    q = F.col("prob")
    probs = F.array((1 - q) * 0.5, (1 - q) * 0.5, q * 0.25, q * 0.75)
    out = p.withColumn("r", metrics.rescale_classes(probs, mathx.sigmoid(2 * q - 1)))
    return shown(out.select("community", "week_idx", *[F.col("r")[i].alias(f"p{i}") for i in range(4)]))


@query("first_hits", P + """ SELECT community, model, week_idx, rank, prob FROM (SELECT community, model, week_idx, round(prob, 6) AS prob, row_number() OVER (PARTITION BY community, model ORDER BY week_idx) AS rank
  FROM evaluated WHERE pred >= 1 AND actual >= 1) WHERE rank <= 3""")
def first_hits(spark, sf):
    return shown(metrics.first_hits(b.binary_predictions(spark, sf)))


@query("latest_state", P + """ SELECT community, model, round(max(probability), 4) AS probability, CAST(max(state) AS BIGINT) AS state FROM (SELECT community, model, arg_max(prob, week_idx) FILTER (WHERE prob IS NOT NULL) AS probability,
  arg_max(pred, week_idx) FILTER (WHERE pred IS NOT NULL) AS state FROM predictions GROUP BY ALL) GROUP BY ALL""")
def latest_state(spark, sf):
    p = b.stored(b.predictions(spark, sf))
    both = [decide.latest_known(p.where(F.col("model") == m)).withColumn("model", F.lit(m)) for m in ("tabular", "sequence")]
    return shown(both[0].unionByName(both[1]))


@query("model_choice", P + """ SELECT community, CASE WHEN community LIKE '1%' THEN 'tabular' WHEN community LIKE '2%' THEN 'sequence' ELSE 'ensemble' END AS model FROM (SELECT DISTINCT community FROM predictions)""")
def model_choice(spark, sf):
    p = b.predictions(spark, sf)
    some = p.where(~((F.col("community").startswith("1")) & (F.col("model") == "sequence")) & ~((F.col("community").startswith("2")) & (F.col("model") == "tabular")))
    return decide.choose_model(some)
