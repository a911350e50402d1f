"""Panel statistics: profiles, balance, outliers, trend, rank correlation, Granger tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidewatch.functions import mathx, special
from tidewatch.operators.monitor import long_features
from tidewatch.operators.weekly import with_week_index
from tidewatch.session import spread

BY = ("community", "feature")


def class_balance(labeled: DataFrame, label: str = "label") -> DataFrame:
    s = F.col(label)
    g = labeled.groupBy("community").agg(
        F.count(s).alias("n_total"),
        *[F.count_if(s == i).alias(f"n_{i}") for i in range(4)],
        F.count_if(s >= 2).alias("crisis_weeks"),
        F.count_if(s < 2).alias("stable_weeks"),
    )
    return g.withColumn("crisis_rate", mathx.ratio(F.col("crisis_weeks"), F.col("n_total"))).withColumn(
        "imbalance_ratio", (F.col("n_total") - F.col("crisis_weeks")) / F.greatest("crisis_weeks", F.lit(1))
    )


def state_profile(labeled: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """n, mean, sample std and median of features by community and state."""
    long = long_features(labeled, features, ("community", label)).where(F.col(label).isNotNull() & F.col("value").isNotNull())
    return long.groupBy("community", "feature", F.col(label).alias("state")).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.median("value").alias("median")
    )


def missing_share(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    long = long_features(panel, features, ("community",))
    return long.groupBy(*BY).agg((F.avg(F.col("value").isNull().cast("double")) * 100.0).alias("missing_pct"))


def feature_profile(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Moments, range, quartiles and bias-corrected skew per community and feature."""
    long = long_features(panel, features, ("community",))
    v = F.col("value")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = long.groupBy(*BY).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        q.alias("_q"), mathx.sample_skew(v).alias("skew"),
        (F.avg(v.isNull().cast("double")) * 100.0).alias("missing_pct"), F.count(v).alias("n_valid"),
    )
    return g.select(
        *BY, "mean", "std", "min", "max", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q3"), "skew", "missing_pct", "n_valid",
    )


def train_stats(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample std (0 for one row), min and max: the guardrail's reference table."""
    long = long_features(panel, features, ("community",))
    v = F.col("value")
    return long.groupBy(*BY).agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"),
        F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
    )


def iqr_outliers(panel: DataFrame, features: Sequence[str], factor: float = 1.5, minimum: int = 8) -> DataFrame:
    """Weeks outside Q1 - k*IQR .. Q3 + k*IQR; short or flat features give none.

    The quartiles are taken over the window of one series (a community's weeks of one
    feature), so the rows are read and shuffled once.
    """
    series = Window.partitionBy(*BY)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(series)
    long = long_features(panel, features, ("community", "week_start")).where(F.col("value").isNotNull())
    rows = long.withColumn("_q", q).withColumn("_n", F.count("*").over(series))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    bounded = rows.where((F.col("_n") >= minimum) & (iqr != 0)).withColumn(
        "lower_bound", F.col("_q")[0] - factor * iqr).withColumn("upper_bound", F.col("_q")[1] + factor * iqr)
    out = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return bounded.where(out).withColumn("direction", F.when(F.col("value") > F.col("upper_bound"), "high").otherwise("low")).drop("_q", "_n")


def trend(scored: DataFrame, score: str = "distress_score", flat: float = 0.1, minimum: int = 4) -> DataFrame:
    """Slope per week, change over the period in population deviations, direction."""
    rows = scored if "week_idx" in scored.columns else with_week_index(scored)
    y, x = F.col(score).cast("double"), F.col("week_idx").cast("double")
    g = rows.where(y.isNotNull()).groupBy("community").agg(
        F.count("*").alias("n_weeks"), F.regr_slope(y, x).alias("slope"), F.stddev_pop(y).alias("_sd")
    )
    change = F.when(F.col("_sd") > 1e-8, F.col("slope") * (F.col("n_weeks") - 1) / F.col("_sd")).otherwise(F.lit(0.0))
    word = (
        F.when(F.col("n_weeks") < minimum, "insufficient_data").when(F.abs("sigma_change") < flat, "stable")
        .when(F.col("slope") > 0, "rising").otherwise("declining")
    )
    return g.withColumn("sigma_change", change).withColumn("direction", word).drop("_sd")


def yearly_rate(labeled: DataFrame, label: str = "label") -> DataFrame:
    """Share of elevated weeks by year; the row without a year is the overall rate."""
    known = labeled.where(F.col(label).isNotNull())
    return known.withColumn("_c", (F.col(label) >= 2).cast("int")).groupingSets(
        [[F.col("community"), F.col("iso_year")], [F.col("community")]], F.col("community"), F.col("iso_year")
    ).agg(F.avg("_c").alias("crisis_rate"), F.count("*").alias("n_weeks"))


def quality_flags(panel: DataFrame, labeled: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Flags per community: high missingness, outlier-prone features (top 3), low crisis rate."""
    missing = missing_share(panel, features).where(F.col("missing_pct") > 20).select(
        "community", F.lit("high_missing").alias("flag"), "feature", F.col("missing_pct").alias("value")
    )
    n_out = iqr_outliers(panel, features).groupBy(*BY).agg(F.count("*").alias("n"))
    top = Window.partitionBy("community").orderBy(F.desc("n"), "feature")
    prone = n_out.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= 3).select(
        "community", F.lit("outlier_prone").alias("flag"), "feature", F.col("n").cast("double").alias("value")
    )
    low = class_balance(labeled, label).where(F.col("crisis_rate") < 0.05).select(
        "community", F.lit("low_crisis_rate").alias("flag"), F.lit("").alias("feature"), F.col("crisis_rate").alias("value")
    )
    return missing.unionByName(prone).unionByName(low)


# --- rank correlation --------------------------------------------------------


def average_rank(value: Column, *by: str) -> Column:
    """Rank from 1 with ties sharing their mean rank."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return first + (ties - 1) / 2.0


def _filled(panel: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    long = long_features(panel, features, keys)
    mid = F.median("value").over(Window.partitionBy("community", "feature"))
    return long.withColumn("value", F.coalesce("value", mid)).where(F.col("value").isNotNull())


def spearman_label(labeled: DataFrame, features: Sequence[str], label: str = "label", minimum: int = 8) -> DataFrame:
    """Rank correlation of each feature with "next week is elevated" (unknown counts as not)."""
    base = labeled.withColumn("_y", F.coalesce((F.col(label) >= 2).cast("double"), F.lit(0.0)))
    long = _filled(base, features, ("community", "week_start", "_y"))
    ranked = long.withColumn("_rx", average_rank(F.col("value"), *BY)).withColumn("_ry", average_rank(F.col("_y"), *BY))
    flat = (F.stddev_pop("_rx") < mathx.FLAT_STD) | (F.stddev_pop("_ry") < mathx.FLAT_STD)
    g = ranked.groupBy(*BY).agg(F.count("*").alias("n"), F.when(~flat, F.corr("_rx", "_ry")).alias("spearman_rho"))
    return g.where(F.col("n") >= minimum)


def with_p_value(rho: DataFrame) -> DataFrame:
    """Two-sided p of a rank correlation (t approximation) and its significance at 5 %."""

    def tail(batches):
        for pdf in batches:
            n, r = pdf["n"].to_numpy(float), pdf["spearman_rho"].to_numpy(float)
            p = special.t_two_sided(r * np.sqrt((n - 2) / np.maximum(1e-300, 1 - r * r)), n - 2)
            yield pdf.assign(p_value=p)

    schema = T.StructType([*rho.schema.fields, T.StructField("p_value", T.DoubleType())])
    return rho.mapInPandas(tail, schema).withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def _collinear(features: Sequence[str], cut: float, min_weeks: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ranks = pdf[list(features)].to_numpy(float)
        ranks = np.where(np.isnan(ranks).all(axis=0), 0.0, ranks)  # features that are null throughout have no pairs; the others are filled
        moving = np.flatnonzero(ranks.std(axis=0) > mathx.FLAT_STD) if len(pdf) >= min_weeks else np.zeros(0, dtype=int)
        rho = np.atleast_2d(np.corrcoef(ranks[:, moving], rowvar=False)) if len(moving) > 1 else np.zeros((0, 0))
        i, j = np.nonzero(np.triu(np.abs(rho) >= cut, 1))
        names = np.array(features, dtype=object)[moving]
        return pd.DataFrame({"community": pdf["community"].iloc[0], "feature_a": names[i], "feature_b": names[j], "spearman_rho": rho[i, j]})

    return run


def collinear_pairs(panel: DataFrame, features: Sequence[str], cut: float = 0.9, min_weeks: int = 8) -> DataFrame:
    """Feature pairs of a community whose absolute rank correlation reaches the cut.

    A community with fewer than ``min_weeks`` weeks has none, as two or three weeks always correlate.

    Ranks are computed once per feature.  The rank matrix of a community, weeks by
    features and so bounded by the calendar, gives all its correlations in one product.
    """
    ranked = _filled(panel, features, ("community", "week_start")).withColumn("_r", average_rank(F.col("value"), *BY))
    wide = ranked.groupBy("community", "week_start").agg(*[F.max(F.when(F.col("feature") == f, F.col("_r"))).alias(f) for f in features])
    schema = "community string, feature_a string, feature_b string, spearman_rho double"
    return wide.groupBy("community").applyInPandas(_collinear(features, cut, min_weeks), schema)


def top_features(table: DataFrame, value: Column, n: int, name: str = "feature") -> DataFrame:
    """Top n rows per community by a value (compared at nine digits, ties by name)."""
    w = Window.partitionBy("community").orderBy(F.desc(F.round(value, 9)), name)
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --- Granger -----------------------------------------------------------------

GRANGER_SCHEMA = "source string, target string, lag int, n long, f_stat double, p_value double, reason string"


def asked_pairs(spark: SparkSession, communities: Sequence[str] | DataFrame) -> DataFrame:
    """Ordered pairs (source, target): those of a short list the caller names, or a table of pairs as it is."""
    if isinstance(communities, DataFrame):
        return communities.select("source", "target")
    return spark.createDataFrame([(a, b) for a in communities for b in communities if a != b], "source string, target string")


def aligned_pairs(scored: DataFrame, communities: Sequence[str] | DataFrame, score: str = "distress_score") -> DataFrame:
    """Rows (source, target, t, x, y): both series counted back from their last week.

    The pairs are those the caller asks about, a list or a table; each side is an
    equi-join on (community, weeks from the end).
    """
    asked = asked_pairs(scored.sparkSession, communities)
    back = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("week_start")))
    series = scored.select("community", "week_start", F.col(score).cast("double").alias("v")).withColumn("back", back)
    x = asked.join(series.select(F.col("community").alias("source"), "back", F.col("v").alias("x")), "source")
    y = series.select(F.col("community").alias("target"), "back", F.col("v").alias("y"))
    return x.join(y, ["target", "back"])


def _ssr(design: np.ndarray, y: np.ndarray) -> float:
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    r = y - design @ beta
    return float(r @ r)


def _granger_group(max_lag: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("back", ascending=False)
        src, tgt = s["source"].iloc[0], s["target"].iloc[0]
        long_enough = len(s) >= 2 * max_lag + 5
        s = s.dropna(subset=["x", "y"])
        x, y = s["x"].to_numpy(), s["y"].to_numpy()
        rows = []
        for k in range(1, max_lag + 1):
            if not long_enough or len(s) < 2 * max_lag + 5:
                reason = "series_too_short" if not long_enough else "too_few_observations"
                rows.append((src, tgt, k, len(s), None, None, reason))
                continue
            m = len(y) - k
            own = np.column_stack([y[k - i : k - i + m] for i in range(1, k + 1)])
            other = np.column_stack([x[k - i : k - i + m] for i in range(1, k + 1)])
            one = np.ones((m, 1))
            target = y[k:]
            small = _ssr(np.hstack([one, own]), target)
            full = _ssr(np.hstack([one, own, other]), target)
            df2 = m - 2 * k - 1
            # An exact fit leaves nothing to test.
            f = ((small - full) / k) / (full / df2) if full > 1e-12 * max(small, 1e-300) else None
            p = float(special.f_tail(f, k, df2)) if f is not None else None
            rows.append((src, tgt, k, m, f, p, None if f is not None else "exact_fit"))
        return pd.DataFrame(rows, columns=["source", "target", "lag", "n", "f_stat", "p_value", "reason"])

    return run


def granger(scored: DataFrame, communities: Sequence[str] | DataFrame, max_lag: int = 4, score: str = "distress_score") -> DataFrame:
    """F test "source helps predict target" for every ordered pair and lag 1..max_lag.

    One group is one pair of weekly series, bounded by the calendar.
    """
    pairs = aligned_pairs(scored, communities, score)
    return spread(pairs, "source", "target").groupBy("source", "target").applyInPandas(_granger_group(max_lag), GRANGER_SCHEMA)
