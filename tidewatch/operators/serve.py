"""Batch scoring of feature rows with checks, and the prediction log."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import dates, mathx
from tidewatch.operators import metrics, monitor
from tidewatch.schemas import STATE_NAMES


def check_requests(requests: DataFrame, communities: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """``skip_reason`` per request: community, date, finite values and required features.

    ``requests`` has request_id, community, week_start (string) and features (map name -> value).
    """
    values = F.map_values("features")
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    need = F.array(*[F.lit(f) for f in required]) if required else F.array().cast("array<string>")
    missing = F.array_except(need, F.map_keys("features"))
    reason = (
        F.when(~F.coalesce(F.col("community").isin(*communities), F.lit(False)), "unknown_community")
        .when(dates.to_timestamp_or_null(F.col("week_start")).isNull(), "bad_date")
        .when(bad, "non_finite_feature").when(F.size(missing) > 0, "missing_features")
    )
    return requests.withColumn("skip_reason", reason).withColumn("missing_features", missing)


def missing_features(long: DataFrame, required: DataFrame) -> DataFrame:
    """Required (community, feature) pairs that a table of values lacks."""
    return required.join(long.select("community", "feature").distinct(), ["community", "feature"], "left_anti")


def linear_probability(x: Column, model: Column) -> Column:
    """Logistic probability of a feature array under a model struct (intercept, coef)."""
    dot = F.aggregate(F.zip_with(x, model["coef"], lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return mathx.sigmoid(model["intercept"] + dot)


def class_probabilities(x: Column, model: Column) -> Column:
    """Softmax over the classes of a model struct (intercept array, coef array of arrays)."""
    logits = F.zip_with(
        model["intercept"],
        F.transform(model["coef"], lambda w: F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)),
        lambda a, b: a + b,
    )
    top = F.array_max(logits)
    parts = F.transform(logits, lambda z: F.exp(z - top))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(parts, lambda p: p / total)


def score_batch(
    panel: DataFrame, models: DataFrame, features: Sequence[str], stats: DataFrame | None = None,
    calibrators: DataFrame | None = None, sequence: DataFrame | None = None,
    monitoring_only: Iterable[str] = (), max_sigma: float = 5.0, drift_std: float = 2.5,
) -> DataFrame:
    """Scores every row of a feature table: guardrail, drift, tabular, sequence, ensemble.

    ``models``: community, model (struct); ``calibrators``: community, calibrator (struct);
    ``sequence``: community, week_start, probs (4 calibrated class probabilities).  Rows
    that break the guardrail or belong to a monitoring-only community get no prediction.
    """
    rows = panel
    if stats is not None:
        long = monitor.long_features(panel, features)
        bad = monitor.guardrail(long, stats, max_sigma).where("violation").groupBy("community", "week_start").agg(
            F.array_sort(F.collect_set("feature")).alias("violations"))
        warn = monitor.drift_warnings(long, stats, drift_std).groupBy("community", "week_start").agg(
            F.array_sort(F.collect_set("warning")).alias("drift_warnings"))
        rows = rows.join(bad, ["community", "week_start"], "left").join(warn, ["community", "week_start"], "left")
    else:
        rows = rows.withColumn("violations", F.lit(None).cast("array<string>")).withColumn("drift_warnings", F.lit(None).cast("array<string>"))
    watch = list(monitoring_only)
    quiet = F.col("community").isin(*watch) if watch else F.lit(False)
    usable = ~quiet & F.col("violations").isNull()
    rows = rows.join(models, "community", "left")
    prob = F.when(usable & F.col("model").isNotNull(), linear_probability(F.array(*[F.col(f).cast("double") for f in features]), F.col("model")))
    if calibrators is not None:
        rows = rows.join(calibrators, "community", "left")
        prob = F.when(F.col("calibrator").isNotNull(), metrics.apply_calibrator(prob, F.col("calibrator"))).otherwise(prob)
    rows = rows.withColumn("tabular_prob", F.round(prob, 4))
    if sequence is not None:
        rows = rows.join(sequence.select("community", "week_start", "probs"), ["community", "week_start"], "left")
        probs = F.when(usable, F.col("probs"))
        best = F.array_position(probs, F.array_max(probs)).cast("int") - 1
        rows = rows.withColumn("sequence_state", best).withColumn(
            "_seq", F.round(F.element_at(probs, 3), 4) + F.round(F.element_at(probs, 4), 4))
    else:
        rows = rows.withColumn("sequence_state", F.lit(None).cast("int")).withColumn("_seq", F.lit(None).cast("double"))
    both = F.round((F.col("tabular_prob") + F.col("_seq")) / 2.0, 4)
    two = lambda p: F.when(p.isNotNull(), F.when(p >= 0.5, F.lit(2)).otherwise(F.lit(0)))
    state = F.coalesce(two(both), two(F.col("tabular_prob")), F.col("sequence_state"))
    warnings = F.coalesce("drift_warnings", F.array().cast("array<string>"))
    return rows.select(
        "community", "week_start", "tabular_prob", "sequence_state", both.alias("ensemble_prob"),
        state.alias("predicted_state"), monitor.name_of(state, STATE_NAMES).alias("predicted_state_label"),
        state.isNotNull().alias("prediction_available"),
        F.coalesce("violations", F.array().cast("array<string>")).alias("violations"),
        warnings.alias("drift_warnings"), (F.size(warnings) > 0).alias("has_drift"),
    )


def log_summary(log: DataFrame) -> DataFrame:
    """Count, elevated rate and drift rate per community and over all (community TOTAL).

    ``log``: community, tabular_prob, ensemble_prob, has_drift.  An ensemble
    probability of exactly 0 counts as absent, as in the log's own rule.
    """
    p = F.coalesce(F.nullif("ensemble_prob", F.lit(0.0)), F.nullif("tabular_prob", F.lit(0.0)))
    rows = log.select(
        F.coalesce("community", F.lit("unknown")).alias("community"),
        F.coalesce((p >= 0.5).cast("int"), F.lit(0)).alias("_e"), F.coalesce(F.col("has_drift").cast("int"), F.lit(0)).alias("_d"),
    )
    return rows.rollup("community").agg(
        F.count("*").alias("n_predictions"), F.round(F.avg("_e"), 4).alias("elevated_rate"), F.round(F.avg("_d"), 4).alias("drift_rate")
    ).withColumn("community", F.coalesce("community", F.lit("TOTAL")))


def model_info(metric_rows: DataFrame, importance: DataFrame, weeks: DataFrame, top: int = 5) -> DataFrame:
    """Metrics subset, top features and training weeks per community and model."""
    from tidewatch.operators.stats import top_features

    best = top_features(importance, F.col("importance"), top).groupBy("community").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]).alias("top_features"))
    return metric_rows.join(best, "community", "left").join(weeks, "community", "left")
