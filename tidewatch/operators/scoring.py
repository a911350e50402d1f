"""Composite score, thresholds, forward labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions import mathx
from tidewatch.schemas import SCORE_WEIGHTS, STATE_CUTS


def composite_score(panel: DataFrame, weights: Mapping[str, float] = SCORE_WEIGHTS, normalize: bool = True,
                    out: str = "distress_score") -> DataFrame:
    """Weighted sum of the available signals; absent ones are skipped, weights stay as given.

    ``normalize`` takes the z of each signal inside its community (population std).
    """
    whole = Window.partitionBy("community")
    total = F.lit(0.0)
    for c, w in weights.items():
        if c not in panel.columns:
            continue
        v = F.col(c).cast("double")
        part = mathx.zscore(v, F.avg(v).over(whole), F.stddev_pop(v).over(whole)) if normalize else v
        total = total + F.lit(float(w)) * part
    return panel.withColumn(out, total)


def fit_thresholds(scored: DataFrame, cuts: Sequence[float] = STATE_CUTS, score: str = "distress_score") -> DataFrame:
    """mean + k * sample std per community: columns t1, t2, t3."""
    stats = scored.groupBy("community").agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    return stats.select(
        "community", "mean", "std",
        *[(F.col("mean") + F.lit(float(k)) * F.col("std")).alias(f"t{i}") for i, k in enumerate(cuts, 1)],
    )


def states(scored: DataFrame, thresholds: DataFrame, score: str = "distress_score") -> DataFrame:
    """``state`` of the week itself, ``label`` = state of the next week, ``is_crisis_week`` (strictly above t3)."""
    t = thresholds.select("community", "t1", "t2", "t3")
    cuts = [F.col("t1"), F.col("t2"), F.col("t3")]
    upcoming = F.lead(score).over(Window.partitionBy("community").orderBy("week_start"))
    return (
        scored.join(t, "community")
        .withColumn("state", mathx.bucket(F.col(score), cuts))
        .withColumn("label", mathx.bucket(upcoming, cuts))
        .withColumn("is_crisis_week", (F.col(score) > F.col("t3")).cast("int"))
    )


def fit_states(scored: DataFrame, cuts: Sequence[float] = STATE_CUTS, score: str = "distress_score") -> DataFrame:
    """``fit_thresholds`` and ``states`` on the same rows in one pass.

    The thresholds are window aggregates over the partitioning that the score and the
    next-week lookup use anyway, so nothing is aggregated aside and joined back.
    """
    whole = Window.partitionBy("community")
    fitted = scored.withColumn("_m", F.avg(score).over(whole)).withColumn("_s", F.stddev_samp(score).over(whole))
    for i, k in enumerate(cuts, 1):
        fitted = fitted.withColumn(f"t{i}", F.col("_m") + F.lit(float(k)) * F.col("_s"))
    levels = [F.col("t1"), F.col("t2"), F.col("t3")]
    upcoming = F.lead(score).over(Window.partitionBy("community").orderBy("week_start"))
    return (
        fitted.withColumn("state", mathx.bucket(F.col(score), levels))
        .withColumn("label", mathx.bucket(upcoming, levels))
        .withColumn("is_crisis_week", (F.col(score) > F.col("t3")).cast("int"))
        .drop("_m", "_s")
    )


def score_deltas(scored: DataFrame, score: str = "distress_score", band: float = 0.05) -> DataFrame:
    """Change against the week before and its trend word."""
    before = F.lag(score).over(Window.partitionBy("community").orderBy("week_start"))
    out = scored.withColumn("score_delta", F.col(score) - F.coalesce(before, F.col(score)))
    word = F.when(F.col("score_delta") > band, "Rising").when(F.col("score_delta") < -band, "Easing").otherwise("Stable")
    return out.withColumn("trend", word)
