"""Drift against a trailing baseline, level changes, state escalations, guardrails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import mathx
from tidewatch.schemas import DRIFT_SIGNALS, LEVEL_CUTS, LEVEL_NAMES


Z_DIGITS = 9


def name_of(value: Column, names: dict[int, str], default: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.element_at(table, value.cast("int"))
    return found if default is None else F.coalesce(found, default)


def strongest(signals: Sequence[str], value) -> Column:
    """Name of the signal with the largest value; ties go to list order."""
    ranked = F.array_max(F.array(*[F.struct(value(s).alias("v"), F.lit(-i).alias("i")) for i, s in enumerate(signals)]))
    names = F.array(*[F.lit(s) for s in signals])
    return F.element_at(names, 1 - ranked["i"])


def drift(panel: DataFrame, signals: Sequence[str] = DRIFT_SIGNALS, baseline_weeks: int = 12) -> DataFrame:
    """z of every signal against the preceding weeks (the current one excluded).

    Fewer than two baseline weeks or a flat baseline give z = 0.
    """
    used = [s for s in signals if s in panel.columns]
    if not used:
        return panel.select(
            "community", "week_start",
            F.lit(0).alias("aggregate_level"), F.lit(LEVEL_NAMES[0]).alias("alert_level_name"),
            F.lit("none").alias("dominant_signal"),
        )
    past = Window.partitionBy("community").orderBy("week_start").rowsBetween(-baseline_weeks, -1)
    zs = {}
    for s in used:
        v = F.col(s).cast("double")
        zs[s] = mathx.zscore(v, F.avg(v).over(past), F.stddev_samp(v).over(past))
    scored = panel.select("community", "week_start", *[F.coalesce(z, F.lit(0.0)).alias(f"z_{s}") for s, z in zs.items()])
    # Sizes are compared at nine digits, so that sums added in another order cannot turn a tie or a cut.
    size = {s: F.round(F.abs(F.col(f"z_{s}")), Z_DIGITS) for s in used}
    top = F.greatest(*size.values()) if len(size) > 1 else size[used[0]]
    leveled = scored.withColumn("aggregate_level", mathx.bucket(top, LEVEL_CUTS))
    return leveled.withColumn("alert_level_name", name_of(F.col("aggregate_level"), LEVEL_NAMES)).withColumn(
        "dominant_signal", strongest(used, size.get)
    )


def level_changes(drifted: DataFrame) -> DataFrame:
    """Weeks whose drift level differs from the week before (the first is compared with 0)."""
    order = Window.partitionBy("community").orderBy("week_start")
    before = drifted.withColumn("previous_level", F.lag("aggregate_level", 1, 0).over(order))
    kind = F.when(F.col("aggregate_level") > F.col("previous_level"), "escalation").otherwise("de-escalation")
    return before.where(F.col("aggregate_level") != F.col("previous_level")).select(
        "community", "week_start", "previous_level", "aggregate_level", kind.alias("change"), "dominant_signal"
    )


def escalations(states: DataFrame, signals: Sequence[str] = DRIFT_SIGNALS) -> DataFrame:
    """Weeks whose state rose above the week before; both must be known.

    ``states`` has community, week_start, state, score and optionally signal columns,
    the largest raw value of which names the dominant signal.
    """
    used = [s for s in signals if s in states.columns]
    order = Window.partitionBy("community").orderBy("week_start")
    dominant = strongest(used, lambda s: F.col(s).cast("double")) if used else F.lit("")
    return (
        states.withColumn("from_state", F.lag("state").over(order))
        .where(F.col("state") > F.col("from_state"))
        .select(
            "community", "week_start", F.col("from_state").cast("int").alias("from_state"),
            F.col("state").cast("int").alias("to_state"), F.col("score").alias("distress_score"),
            dominant.alias("dominant_signal"),
        )
    )


def recent(transitions: DataFrame, n: int = 20, clock: str = "timestamp") -> DataFrame:
    """Latest n transitions with a total order."""
    ties = [F.col(c) for c in ("community", "week_start") if c in transitions.columns]
    return transitions.orderBy(F.desc(clock), *ties).limit(n)


def transition_counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("community", "to_state").agg(F.count("*").alias("n"))


# --- guardrails against training statistics ---------------------------------


def long_features(panel: DataFrame, features: Sequence[str], keys: Sequence[str] = ("community", "week_start")) -> DataFrame:
    """Wide panel to (keys, feature, value)."""
    return panel.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        list(keys), list(features), "feature", "value"
    )


def drift_warnings(long: DataFrame, stats: DataFrame, limit_std: float = 2.5) -> DataFrame:
    """Feature values further than ``limit_std`` training deviations from the training mean."""
    joined = long.join(stats.select("community", "feature", "mean", "std"), ["community", "feature"])
    z = F.abs((F.col("value") - F.col("mean")) / F.col("std"))
    text = F.format_string(
        "%s: value %.4f is %.1f std from training mean (%.4f)", F.col("feature"), F.col("value"), z, F.col("mean")
    )
    far = (F.col("std") > 0) & (F.abs(F.col("value") - F.col("mean")) > limit_std * F.col("std"))
    return joined.where(far).withColumn("z", z).withColumn("warning", text)


def guardrail(long: DataFrame, stats: DataFrame, max_sigma: float = 5.0, clip: bool = False) -> DataFrame:
    """Values outside mean +/- max_sigma are flagged, or clipped to the bounds."""
    s = stats.select("community", "feature", "mean", "std")
    joined = long.join(s, ["community", "feature"], "left")
    lo, hi = F.col("mean") - max_sigma * F.col("std"), F.col("mean") + max_sigma * F.col("std")
    outside = F.coalesce((F.col("std") > 0) & (F.abs((F.col("value") - F.col("mean")) / F.nullif("std", F.lit(0.0))) > max_sigma), F.lit(False))
    fixed = F.when(outside, F.least(F.greatest(F.col("value"), lo), hi)).otherwise(F.col("value")) if clip else F.col("value")
    return joined.select(
        *long.columns[:-1], fixed.alias("value"),
        (outside if not clip else F.lit(False)).alias("violation"),
        (outside if clip else F.lit(False)).alias("clipped"),
    )
