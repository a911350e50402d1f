"""Walk-forward folds as data: one row per community and test week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import mathx
from tidewatch.operators.weekly import with_week_index
from tidewatch.schemas import STATE_CUTS

REASON = "insufficient_training_examples_or_positives"


def fold_grid(panel: DataFrame, min_train: int = 26, gap: int = 1, n: str = "n_weeks") -> DataFrame:
    """(community, fold_i, test_idx, train_end): rows [0, train_end) train, test_idx is scored.

    ``panel`` is weekly rows, or already one row per community with ``n_weeks``.
    """
    sizes = panel if n in panel.columns else panel.groupBy("community").agg(F.count("*").alias(n))
    first = min_train + gap
    tests = F.sequence(F.lit(first), (F.col(n) - 1).cast("int"))
    return sizes.where(F.col(n) > first).select("community", F.posexplode(tests).alias("fold_i", "test_idx")).withColumn(
        "train_end", F.col("test_idx") - gap
    )


def dev_rows(n: Column, holdout: int = 12, min_required: int = 27) -> Column:
    """Rows left for development after a holdout shrunk so that min_required + 1 remain."""
    hold = F.least(F.lit(max(0, holdout)), F.greatest(F.lit(0), n - (min_required + 1)))
    return F.when(n <= min_required + 1, n).otherwise(n - hold).cast("int")


def holdout_split(panel: DataFrame, holdout: int = 12, min_required: int = 27) -> DataFrame:
    sizes = panel.groupBy("community").agg(F.count("*").cast("int").alias("n_weeks"))
    return sizes.withColumn("dev_n", dev_rows(F.col("n_weeks"), holdout, min_required)).withColumn(
        "holdout_n", F.col("n_weeks") - F.col("dev_n")
    )


def calibration_rows(n: Column, fraction: float = 0.2, minimum: int = 12) -> Column:
    """Size of the calibration tail: banker's rounding of the share, at least the minimum, below n."""
    want = F.greatest(F.lit(minimum), F.bround(n * F.lit(fraction), 0).cast("int"))
    return F.least(F.greatest(want, F.lit(0)), F.greatest(n - 1, F.lit(0))).cast("int")


def fold_thresholds(scored: DataFrame, grid: DataFrame, gap: int = 1, cuts: Sequence[float] = STATE_CUTS,
                    score: str = "distress_score") -> DataFrame:
    """Thresholds of every fold from expanding statistics, without a join on training rows.

    The rows before test_idx - gap are a window frame of the test row itself.
    """
    rows = scored if "week_idx" in scored.columns else with_week_index(scored)
    past = Window.partitionBy("community").orderBy("week_start").rowsBetween(Window.unboundedPreceding, -(gap + 1))
    nxt = F.lead(score).over(Window.partitionBy("community").orderBy("week_start"))
    stats = rows.select(
        "community", "week_start", F.col("week_idx").alias("test_idx"), F.col(score).alias("test_score"),
        nxt.alias("next_score"), F.avg(score).over(past).alias("mean"), F.stddev_samp(score).over(past).alias("std"),
    )
    fitted = grid.join(stats, ["community", "test_idx"])
    for i, k in enumerate(cuts, 1):
        fitted = fitted.withColumn(f"t{i}", F.col("mean") + F.lit(float(k)) * F.col("std"))
    # What really happened: the class of the week after the test week, by the fold's own thresholds.
    return fitted.withColumn("actual", mathx.bucket(F.col("next_score"), [F.col("t1"), F.col("t2"), F.col("t3")]))


def fold_labels(scored: DataFrame, thresholds: DataFrame, compat: bool = False, score: str = "distress_score",
                min_rows: int = 10, min_positive: int = 2) -> DataFrame:
    """Fold records: training size, elevated weeks, and whether the fold is skipped.

    A training row is labelled by its next row inside the training span; with ``compat``
    the last one takes the score of the test row instead of staying unlabelled.  The
    series of a community (one array of weekly scores) meets each of its folds once and
    is counted in place, so no fold x week rows are made.
    """
    rows = scored if "week_idx" in scored.columns else with_week_index(scored)
    series = rows.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("week_idx", F.col(score).alias("v")))).alias("_s"))
    f = thresholds.select("community", "fold_i", "test_idx", "train_end", "test_score", "t2")
    # Next scores of the rows 0 .. train_end - 2 are the scores 1 .. train_end - 1.
    seen = F.transform(F.slice("_s", 2, F.greatest(F.col("train_end") - 1, F.lit(0))), lambda x: x["v"])
    values = F.array_append(seen, F.col("test_score")) if compat else seen
    known = f.join(series, "community").withColumn("_v", F.filter(values, lambda v: v.isNotNull()))
    out = known.select(
        "community", "fold_i", "test_idx", F.size("_v").alias("n_train"),
        F.size(F.filter("_v", lambda v: v >= F.col("t2"))).alias("n_crisis_train"),
    )
    skipped = (F.col("n_train") < min_rows) | (F.col("n_crisis_train") < min_positive)
    return (
        out.withColumn("crisis_rate_train", mathx.ratio(F.col("n_crisis_train"), F.col("n_train")))
        .withColumn("skipped", skipped)
        .withColumn("skip_reason", F.when(skipped, F.lit(REASON)))
    )


def sequence_column(features: Sequence[str], length: int) -> Column:
    """The last ``length`` weeks flattened to one array; null while there are fewer."""
    w = Window.partitionBy("community").orderBy("week_start").rowsBetween(-(length - 1), 0)
    row = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = F.collect_list(row).over(w)
    return F.when(F.count("*").over(w) == length, F.flatten(rows))


def sequences(panel: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """Fixed-length windows ending at each row, one per row from the length-th week on."""
    return panel.withColumn("sequence", sequence_column(features, length)).where(F.col("sequence").isNotNull())


def fold_diagnostics(records: DataFrame, low: float = 0.05) -> DataFrame:
    """Health of the folds per community."""
    ran = ~F.col("skipped")
    rate = F.when(ran, F.col("crisis_rate_train"))
    return records.groupBy("community").agg(
        F.count("*").alias("n_total_folds"),
        F.count_if(ran).alias("n_ran_folds"),
        F.count_if("skipped").alias("n_skipped_folds"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("mean_fold_crisis_rate"),
        F.coalesce(F.min(rate), F.lit(0.0)).alias("min_fold_crisis_rate"),
        F.coalesce(F.max(rate), F.lit(0.0)).alias("max_fold_crisis_rate"),
        F.count_if(rate <= low).alias("n_low_balance_folds"),
        F.coalesce(F.avg(F.when(ran, F.col("n_train"))), F.lit(0.0)).alias("mean_train_size"),
    )


def skip_reasons(records: DataFrame) -> DataFrame:
    return records.where("skipped").groupBy("community", "skip_reason").agg(F.count("*").alias("n_folds"))
