"""Lag, rolling and seasonal features of a panel, and its null contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidewatch.functions import dates
from tidewatch.schemas import PANEL_KEYS

NOT_TEMPORAL = {*PANEL_KEYS, "dominant_topic", "week_idx"}


def numeric_features(df: DataFrame) -> list[str]:
    numeric = (T.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name not in NOT_TEMPORAL]


def add_temporal(panel: DataFrame, columns: Sequence[str] | None = None, windows: Sequence[int] = (2, 4)) -> DataFrame:
    """Week-over-week delta (first row 0), trailing means and seasonality.

    All expressions share one partitioning and ordering, so the plan has one exchange
    and one sort whatever the number of columns.
    """
    cols = list(columns or numeric_features(panel))
    order = Window.partitionBy("community").orderBy("week_start")
    deltas = [F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0)).cast("double").alias(f"{c}_delta") for c in cols]
    means = [
        F.avg(c).over(order.rowsBetween(-(w - 1), 0)).alias(f"{c}_roll{w}w") for w in windows for c in cols
    ]
    sin, cos = dates.season(F.col("iso_week"))
    return panel.select("*", *deltas, *means, sin.alias("week_sin"), cos.alias("week_cos"))


def null_counts(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with its number of nulls (core features must have none)."""
    sums = panel.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return sums.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("feature", "n_null"))
