"""Boosted trees for many models at once.

A model is a key: a fold of a community, a community, a candidate.  Every level of the next tree of *all* models is one
aggregate of gradients by (model, node, feature, bin), whose cells give the best split of each node through a window of
running sums.  No model is fitted by itself, so the number of jobs is trees x (depth + 1) whatever the number of models,
and the work of a level is spread by cells.  Trees are small tables; they meet the rows by the model's key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import fits, mathx
from tidewatch.operators import folds, learn, metrics
from tidewatch.schemas import STATE_CUTS
from tidewatch.session import spread, written

#: The fit values of a feature are cut into this many parts of equal size; values that tie stay together.
BINS = 16
#: Gains and weights are compared at this many digits, so that the order in which Spark adds decides nothing.
DIGITS = 9
#: Rows of a task.  A tree is a dozen jobs, so it is not cut into more tasks because the session has more partitions.
TASK_ROWS = 12_000


def _binned(rows: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """``rows`` with ``bins``: the part of the model's fit values that each input falls into; null outside the fit."""
    each = rows.where("fit").select(*keys, "row", F.posexplode("x").alias("feature", "value"))
    over = Window.partitionBy(*keys, "feature")
    part = F.floor((F.rank().over(over.orderBy("value")) - 1) * bins / F.count("*").over(over)).cast("int")
    cells = each.select(*keys, "row", F.struct("feature", part.alias("bin")).alias("cell"))
    wide = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list("cell"))["bin"].alias("bins"))
    return rows.join(wide, [*keys, "row"], "left")


def _placed(rows: DataFrame, splits: DataFrame | None, keys: Sequence[str], levels: int) -> DataFrame:
    """``rows`` with the node they reach: 1 is the root, n has the children 2n (below the threshold) and 2n + 1."""
    if splits is None:
        return rows.withColumn("node", F.lit(1))
    entry = F.struct("node", F.struct("feature", "threshold"))
    trees = splits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_tree"))

    def step(node: Column, _: Column) -> Column:
        cut = F.try_element_at(F.col("_tree"), node)
        above = F.get(F.col("x"), cut["feature"]) >= cut["threshold"]
        return F.when(cut.isNull(), node).otherwise(node * 2 + above.cast("int"))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(1), step)
    return rows.join(trees, list(keys), "left").withColumn("node", F.when(F.col("_tree").isNull(), F.lit(1)).otherwise(walk)).drop("_tree")


def _slopes(rows: DataFrame) -> DataFrame:
    """First (``g``) and second (``h``) derivative of the weighted logistic loss at the margin."""
    p = mathx.sigmoid(F.col("margin"))
    return rows.withColumn("g", F.col("w") * (p - F.col("y"))).withColumn("h", F.col("w") * p * (1 - p))


def _best_splits(placed: DataFrame, keys: Sequence[str], l2: float, min_weight: float, most: int | None = None) -> DataFrame:
    """keys, node, feature, threshold and gain: the best split of each node that has one; ties go to the first feature and bin."""
    place = F.sequence(F.lit(0), F.size("x") - 1)
    each = _slopes(placed).select(*keys, "node", "g", "h", F.inline(F.arrays_zip(place.alias("feature"), F.col("bins").alias("bin"), F.col("x").alias("value"))))
    cells = each.groupBy(*keys, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.min("value").alias("threshold"))
    cells = spread(cells, *keys, "node", most=most)  # few bytes, much work: not to be coalesced into a few tasks
    whole = Window.partitionBy(*keys, "node", "feature")
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("*", *[F.sum(c).over(below).alias(f"{c}_low") for c in "gh"], *[F.sum(c).over(whole).alias(f"{c}_all") for c in "gh"])
    worth = lambda g, h: g * g / (h + l2)
    g_up, h_up = F.col("g_all") - F.col("g_low"), F.col("h_all") - F.col("h_low")
    gain = worth(F.col("g_low"), F.col("h_low")) + worth(g_up, h_up) - worth(F.col("g_all"), F.col("h_all"))
    enough = lambda h: F.round(h, DIGITS) >= min_weight
    cuts = cells.where(enough(F.col("h_low")) & enough(h_up)).withColumn("gain", F.round(gain, DIGITS)).where("gain > 0")
    best = F.min_by(F.struct("feature", "threshold", "gain"), F.struct(-F.col("gain"), "feature", "bin"))
    return cuts.groupBy(*keys, "node").agg(best.alias("s")).select(*keys, "node", "s.feature", "s.threshold", "s.gain")


def boost(rows: DataFrame, keys: Sequence[str], *, trees: int = 20, depth: int = 3, rate: float = 0.3, l2: float = 1.0,
          min_weight: float = 1.0, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Gradient-boosted trees of every model: the rows with their final ``margin``, and the trees.

    ``rows`` has the ``keys`` of its model, ``row`` (unique in the model), ``x`` (doubles, no nulls), ``y`` (0 or 1),
    ``w`` (weight) and ``fit``; rows that are not of the fit are scored only, and their y and w may be null.  A split
    wants a second derivative of ``min_weight`` on both sides and a positive gain.  The trees are keys, tree, node,
    feature, threshold and gain for a split, and ``value`` (times ``rate`` already) for a leaf.
    """
    keys = list(keys)
    state = written(spread(_binned(rows, keys, bins).withColumn("margin", F.lit(0.0)), *keys, "row"), "boost-rows")
    columns, grown, most = state.columns, [], math.ceil(state.count() / TASK_ROWS) or 1
    for tree in range(trees):
        splits = None
        for level in range(depth):
            here = _placed(state.where("fit"), splits, keys, level).where(F.col("node") >= 2**level)
            found = written(_best_splits(here, keys, l2, min_weight, most), "boost-splits")
            splits = found if splits is None else splits.unionByName(found)
        placed = _placed(state, splits, keys, depth)
        leaves = _slopes(placed.where("fit")).groupBy(*keys, "node").agg((-rate * F.sum("g") / (F.sum("h") + l2)).alias("value"))
        leaves = written(leaves, "boost-leaves")
        moved = placed.join(leaves, [*keys, "node"], "left").withColumn("margin", F.col("margin") + F.coalesce("value", F.lit(0.0)))
        state = written(spread(moved.select(*columns), *keys, "row", most=most), "boost-rows")
        grown.append(splits.unionByName(leaves, allowMissingColumns=True).withColumn("tree", F.lit(tree)))
    model = grown[0]
    for t in grown[1:]:
        model = model.unionByName(t)
    return state, model.select(*keys, "tree", "node", "feature", "threshold", "gain", "value")


def score(rows: DataFrame, model: DataFrame, keys: Sequence[str], depth: int = 3) -> DataFrame:
    """``rows`` (keys, row, x, ...) with the ``prob`` that the stored trees of their model give."""
    keys = list(keys)
    node = F.struct("feature", "threshold", "value")
    each = model.groupBy(*keys, "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", node))).alias("t"))
    whole = each.groupBy(*keys).agg(F.collect_list("t").alias("_trees"))

    def leaf(tree: Column) -> Column:
        def step(n: Column, _: Column) -> Column:
            at = F.try_element_at(tree, n)
            return F.when(at["feature"].isNull(), n).otherwise(n * 2 + (F.get(F.col("x"), at["feature"]) >= at["threshold"]).cast("int"))

        return F.coalesce(F.try_element_at(tree, F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step))["value"], F.lit(0.0))

    margin = F.aggregate(F.transform("_trees", leaf), F.lit(0.0), lambda a, v: a + v)
    return rows.join(whole, keys).withColumn("prob", mathx.sigmoid(margin)).drop("_trees")


def fold_rows(
    scored: DataFrame, features: Sequence[str], *, cuts: Sequence[float] = STATE_CUTS, min_train: int = 26, gap: int = 1,
    holdout: int = 12, fraction: float = 0.2, min_samples: int = 20, cap: float = 8.0, score: str = "distress_score",
) -> tuple[DataFrame, DataFrame]:
    """Rows and records of every walk-forward fold.

    Rows: community, fold_i, row (the week), x, y, w, fit and test.  The last training weeks of a fold (as many as
    ``folds.calibration_rows`` says) are kept from the fit for the calibrator.  Records: community, fold_i, week_idx,
    n_train, n_crisis_train, skipped and actual, skipped folds included; these have no rows.
    """
    first = min_train + gap
    weeks = learn._with_dev(learn._rows(scored, features, None, score), holdout, min_train, gap)
    past = Window.partitionBy("community").orderBy("week_start").rowsBetween(Window.unboundedPreceding, -(gap + 1))
    weeks = weeks.withColumn("t2", F.avg("score").over(past) + F.lit(float(cuts[1])) * F.stddev_samp("score").over(past))
    weeks = weeks.where((F.col("dev_n") > first) & (F.col("week_idx") < F.col("dev_n")))
    tests = weeks.where(F.col("week_idx") >= first).select(
        "community", (F.col("week_idx") - first).alias("fold_i"), F.col("week_idx").alias("test_idx"), "t2",
        (F.col("next_score") >= F.col("t2")).cast("int").alias("actual"))
    # Week k trains the folds whose span holds it and its next week, and is the test week of one.
    since, last = F.greatest(F.lit(0), F.col("week_idx") + 2 + gap - first), F.col("dev_n") - 1 - first
    own = F.when(F.col("week_idx") >= first, F.array(F.col("week_idx") - first)).otherwise(F.array().cast("array<int>"))
    later = F.when(F.col("next_score").isNotNull() & (since <= last), F.sequence(since, last)).otherwise(F.array().cast("array<int>"))
    spanned = weeks.select("community", F.col("week_idx").alias("row"), "x", "next_score", F.explode(F.concat(own, later)).alias("fold_i"))
    fold = Window.partitionBy("community", "fold_i")
    each = spanned.join(tests, ["community", "fold_i"]).withColumn("test", F.col("row") == F.col("test_idx"))
    each = each.withColumn("y", F.when(~F.col("test"), (F.col("next_score") >= F.col("t2")).cast("int")))
    each = each.withColumn("n", F.count("y").over(fold)).withColumn("n_pos", F.coalesce(F.sum("y").over(fold), F.lit(0)))
    place = F.row_number().over(fold.orderBy("test", "row"))
    each = each.withColumn("fit", ~F.col("test") & (place <= F.col("n") - folds.calibration_rows(F.col("n"), fraction, min_samples)))
    fit_pos = F.count_if(F.col("fit") & (F.col("y") == 1)).over(fold)
    fit_neg = F.count_if(F.col("fit") & (F.col("y") == 0)).over(fold)
    # A fold whose fit holds no elevated week weights nothing; the quotient is null there.
    heavy = F.least(F.lit(float(cap)), F.try_divide(fit_neg, fit_pos))
    each = each.withColumn("w", F.when(F.col("y") == 1, heavy).when(F.col("y") == 0, F.lit(1.0)))
    skipped = (F.col("n") < 10) | (F.col("n_pos") < 2)
    each = written(each.withColumn("skipped", skipped), "fold-rows")
    records = each.where("test").select("community", "fold_i", F.col("test_idx").alias("week_idx"), F.col("n").alias("n_train"),
                                        F.col("n_pos").alias("n_crisis_train"), "skipped", "actual")
    return each.where("NOT skipped").select("community", "fold_i", "row", "x", "y", "w", "fit", "test"), records


def _calibrators(method: str, min_samples: int, min_class: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        cal = fits.fit_calibrator(rows["raw"].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float), method, min_samples, min_class)
        return pd.DataFrame({"community": [key[0]], "fold_i": np.array([key[1]], dtype=np.int32), "calibrator": [cal]})

    return run


def walk_forward(
    scored: DataFrame, features: Sequence[str], *, cuts: Sequence[float] = STATE_CUTS, min_train: int = 26, gap: int = 1,
    holdout: int = 12, threshold: float = 0.3, fraction: float = 0.2, method: str = "platt", min_samples: int = 20,
    min_class: int = 3, score: str = "distress_score", **growth,
) -> DataFrame:
    """Fold records with the calibrated probability of boosted trees, all folds of all communities grown together.

    community, fold_i, week_idx, n_train, n_crisis_train, skipped, actual, calibrator, raw, prob and pred; the last four
    are null in skipped folds.  ``growth`` goes to ``boost``.
    """
    keys = ["community", "fold_i"]
    rows, records = fold_rows(scored, features, cuts=cuts, min_train=min_train, gap=gap, holdout=holdout, fraction=fraction, min_samples=min_samples, score=score)
    state, _ = boost(rows, keys, **growth)
    raw = state.select(*keys, "row", "y", "fit", "test", mathx.sigmoid(F.col("margin")).alias("raw"))
    kept = spread(raw.where("NOT fit AND NOT test").select(*keys, "row", "raw", "y"), *keys)
    schema = f"community string, fold_i int, calibrator {learn.CALIBRATOR}"
    fitted = kept.groupBy(*keys).applyInPandas(_calibrators(method, min_samples, min_class), schema)
    prob = metrics.apply_calibrator(F.col("raw"), F.col("calibrator"))
    tested = raw.where("test").join(fitted, keys).withColumn("prob", prob).select(
        *keys, F.col("calibrator")["type"].alias("calibrator"), "raw", "prob", (F.col("prob") >= threshold).cast("int").alias("pred"))
    return records.join(tested, keys, "left")
