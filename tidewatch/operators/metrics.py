"""Evaluation of predictions held as a long table.

``predictions``: community, model, week_idx, pred, prob, actual (nulls = not evaluated).
One group is one community's weeks for one model, so groups are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import mathx

BY = ("community", "model")
K_VALUES = (1, 2, 3, 5)
THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6)


def _by(df: DataFrame) -> list[str]:
    return [c for c in BY if c in df.columns]


def evaluated(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("pred").isNotNull() & F.col("prob").isNotNull() & F.col("actual").isNotNull())


def binary(predictions: DataFrame, elevated: int = 1) -> DataFrame:
    """Predictions and actuals to 0/1 (1 = at least ``elevated``)."""
    flag = lambda c: F.when(F.col(c).isNotNull(), (F.col(c) >= elevated).cast("int"))
    return predictions.withColumn("pred", flag("pred")).withColumn("actual", flag("actual"))


def _tally(actual: Column, pred: Column) -> list[Column]:
    return [
        F.count_if((pred == 1) & (actual == 1)).alias("tp"),
        F.count_if((pred == 1) & (actual == 0)).alias("fp"),
        F.count_if((pred == 0) & (actual == 1)).alias("fn"),
        F.count_if((pred == 0) & (actual == 0)).alias("tn"),
    ]


def confusion(predictions: DataFrame) -> DataFrame:
    """2x2 counts with precision, recall, F1, false alarm and miss rate."""
    by = _by(predictions)
    t = evaluated(predictions).groupBy(*by).agg(*_tally(F.col("actual"), F.col("pred")))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select(
        *by, "tp", "fp", "fn", "tn",
        mathx.ratio(tp, tp + fp).alias("precision"),
        mathx.ratio(tp, tp + fn).alias("recall"),
        mathx.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        mathx.ratio(fp, fp + tn).alias("false_alarm_rate"),
        mathx.ratio(fn, fn + tp).alias("miss_rate"),
    )


def _by_probability(predictions: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows and positives per distinct probability, with running sums from the top."""
    by = _by(predictions)
    ties = evaluated(predictions).groupBy(*by, "prob").agg(
        F.count("*").alias("n"), F.sum(F.col("actual").cast("long")).alias("tp")
    )
    down = Window.partitionBy(*by).orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return ties.withColumn("cum_n", F.sum("n").over(down)).withColumn("cum_tp", F.sum("tp").over(down)).withColumn(
        "all_tp", F.sum("tp").over(whole)
    ).withColumn("all_n", F.sum("n").over(whole)), by


def average_precision(predictions: DataFrame) -> DataFrame:
    """Area under precision-recall as the step sum over distinct thresholds (no interpolation)."""
    t, by = _by_probability(predictions)
    step = (F.col("tp") / F.nullif("all_tp", F.lit(0))) * (F.col("cum_tp") / F.col("cum_n"))
    return t.groupBy(*by).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("pr_auc"))


def roc_auc(predictions: DataFrame) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half; null with one class only."""
    t, by = _by_probability(predictions)
    negatives = F.col("n") - F.col("tp")
    wins = negatives * (F.col("cum_tp") - F.col("tp") + F.col("tp") / 2.0)
    pairs = F.max(F.col("all_tp") * (F.col("all_n") - F.col("all_tp")))
    return t.groupBy(*by).agg(F.try_divide(F.sum(wins), F.nullif(pairs.cast("double"), F.lit(0.0))).alias("roc_auc"))


def metric_pack(predictions: DataFrame) -> DataFrame:
    """Counts, precision/recall/F1, both areas and the 2x2 confusion per community and model.

    One aggregate per distinct probability feeds the counts and the areas alike.
    """
    by = _by(predictions)
    pred, actual = F.col("pred"), F.col("actual")
    ties = evaluated(predictions).groupBy(*by, "prob").agg(
        F.count("*").alias("n"), F.sum(actual.cast("long")).alias("pos"), *_tally(actual, pred)
    )
    down = Window.partitionBy(*by).orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    t = ties.withColumn("cum_n", F.sum("n").over(down)).withColumn("cum_pos", F.sum("pos").over(down)).withColumn(
        "all_pos", F.sum("pos").over(whole)).withColumn("all_n", F.sum("n").over(whole))
    step = (F.col("pos") / F.nullif("all_pos", F.lit(0))) * (F.col("cum_pos") / F.col("cum_n"))
    wins = (F.col("n") - F.col("pos")) * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)
    pairs = F.max(F.col("all_pos") * (F.col("all_n") - F.col("all_pos"))).cast("double")
    g = t.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.coalesce(F.sum(step), F.lit(0.0)).alias("pr_auc"),
        F.try_divide(F.sum(wins), F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(
        *by, (tp + fp + fn + tn).alias("n_valid_predictions"), (tp + fn).alias("n_crisis_actual"),
        (tp + fp).alias("n_crisis_predicted"), mathx.ratio(tp, tp + fn).alias("recall"), mathx.ratio(tp, tp + fp).alias("precision"),
        mathx.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "tp", "fp", "fn", "tn", "pr_auc", "roc_auc",
    )


def _top_k(ranked: DataFrame, by: list[str], k_values: Sequence[int], ranks: dict[str, str]) -> DataFrame:
    """Positives within the first k of each named ranking, one row per group and k."""
    caught = lambda rank, k: F.coalesce(F.sum(F.when(F.col(rank) <= k, F.col("actual"))), F.lit(0)).cast("long")
    sums = ranked.groupBy(*by).agg(
        F.count("*").alias("n_weeks"), F.coalesce(F.sum("actual"), F.lit(0)).cast("long").alias("total_positives"),
        *[caught(rank, k).alias(f"_{out}_{k}") for out, rank in ranks.items() for k in k_values],
    )
    rows = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(f"_{out}_{k}").alias(out) for out in ranks]) for k in k_values])
    return sums.select(*by, "n_weeks", "total_positives", F.inline(rows))


def top_k_recall(predictions: DataFrame, k_values: Sequence[int] = K_VALUES, score: str = "prob") -> DataFrame:
    """Positives caught by alerting on the K most probable weeks (ties in week order)."""
    by = _by(predictions)
    order = Window.partitionBy(*by).orderBy(F.desc(score), "week_idx")
    ranked = evaluated(predictions).withColumn("_rank", F.row_number().over(order))
    return _top_k(ranked, by, k_values, {"captured": "_rank"}).withColumn(
        "recall", mathx.ratio(F.col("captured"), F.col("total_positives")))


def decision_usefulness(predictions: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """Top-K recall of the model, of random alerts and of "alert after an elevated week".

    Both rankings are windows over one partitioning and reduced by one aggregate.
    """
    by = _by(predictions)
    group = Window.partitionBy(*by)
    ranked = (
        evaluated(predictions)
        .withColumn("_last", F.coalesce(F.lag("actual").over(group.orderBy("week_idx")), F.lit(0)))
        .withColumn("_rank", F.row_number().over(group.orderBy(F.desc("prob"), "week_idx")))
        .withColumn("_naive", F.row_number().over(group.orderBy(F.desc("_last"), "week_idx")))
    )
    t = _top_k(ranked, by, k_values, {"captured": "_rank", "persistence_captured": "_naive"})
    known = F.col("total_positives")
    random = F.when(known > 0, F.least("k", "n_weeks") / F.col("n_weeks")).otherwise(F.lit(0.0))
    return t.withColumn("recall", mathx.ratio(F.col("captured"), known)).withColumn("random_recall", random).withColumn(
        "persistence_recall", mathx.ratio(F.col("persistence_captured"), known))


def _onsets(predictions: DataFrame, crisis_min: int) -> tuple[DataFrame, list[str]]:
    """``_onset`` (first week of an actual crisis) and ``lead`` (flagged weeks just before) on every row."""
    by = _by(predictions)
    order = Window.partitionBy(*by).orderBy("week_idx")
    hot = F.coalesce((F.col("actual") >= crisis_min).cast("int"), F.lit(0))
    flagged = F.coalesce((F.col("pred") >= crisis_min).cast("int"), F.lit(0))
    marked = predictions.withColumn("_hot", hot).withColumn("_flag", flagged).withColumn("_pos", F.row_number().over(order))
    # Length of the flagged run that ends at a row: rows since the last unflagged one.
    last_clear = F.max(F.when(F.col("_flag") == 0, F.col("_pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_run", F.col("_pos") - F.coalesce(last_clear, F.lit(0)))
    onset = (F.col("_hot") == 1) & (F.coalesce(F.lag("_hot").over(order), F.lit(0)) == 0)
    lead = F.coalesce(F.lag("_run").over(order), F.lit(0)).cast("int")
    return marked.select(*by, "week_idx", onset.alias("_onset"), lead.alias("lead")), by


def lead_times(predictions: DataFrame, crisis_min: int = 1) -> DataFrame:
    """One row per onset of an actual crisis and its number of flagged weeks just before."""
    rows, _ = _onsets(predictions, crisis_min)
    return rows.where("_onset").drop("_onset")


def lead_time_summary(predictions: DataFrame, crisis_min: int = 1) -> DataFrame:
    """Onsets, mean and percentiles (linear interpolation) of the lead; no onset gives zeros."""
    rows, by = _onsets(predictions, crisis_min)
    lead = F.when(F.col("_onset"), F.col("lead").cast("double"))
    found = rows.groupBy(*by).agg(
        F.count(lead).alias("n_onsets"), F.avg(lead).alias("mean"),
        F.percentile(lead, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).alias("_q"),
    )
    q = lambda i: F.coalesce(F.get("_q", F.lit(i)), F.lit(0.0))
    return found.select(*by, "n_onsets", F.coalesce("mean", F.lit(0.0)).alias("mean"), *[q(i).alias(n) for i, n in enumerate(("p50", "p75", "p90"))])


def reliability(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Mean predicted against mean actual per probability bin (last bin closed)."""
    by = _by(predictions)
    # An integer comparison against the bin edges keeps 0.3 in [0.3, 0.4).
    edges = F.array(*[F.lit(i / bins) for i in range(bins)])
    index = F.size(F.filter(edges, lambda e: F.col("prob") >= e)) - 1
    return (
        evaluated(predictions).withColumn("bin", index).groupBy(*by, "bin")
        .agg(F.count("*").alias("n"), F.avg("prob").alias("mean_predicted"), F.avg("actual").alias("mean_actual"))
        .withColumn("gap", F.col("mean_predicted") - F.col("mean_actual"))
    )


def calibration_verdict(predictions: DataFrame, band: float = 0.05, minimum: int = 20) -> DataFrame:
    by = _by(predictions)
    g = evaluated(predictions).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("prob").alias("mean_predicted"), F.avg("actual").alias("mean_actual")
    ).withColumn("gap", F.col("mean_predicted") - F.col("mean_actual"))
    word = (
        F.when(F.col("n") < minimum, "insufficient_data").when(F.col("gap") > band, "over-confident")
        .when(F.col("gap") < -band, "under-confident").otherwise("well-calibrated")
    )
    return g.withColumn("verdict", word)


def threshold_sweep(predictions: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall, F1 and alerts at several cut points; ``is_best`` marks the top F1 (lowest cut on ties)."""
    by = _by(predictions)
    p, y = F.col("prob"), F.col("actual")
    sums = evaluated(predictions).groupBy(*by).agg(
        *[F.count_if((p >= t) & (y == 1)).alias(f"_tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(p >= t).alias(f"_al{i}") for i, t in enumerate(thresholds)],
        F.count_if(y == 1).alias("_pos"),
    )
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_al{i}").alias("n_alerts"))
        for i, t in enumerate(thresholds)
    ])
    long = sums.select(*by, "_pos", F.inline(rows)).select(
        *by, "threshold", "n_alerts",
        mathx.ratio(F.col("tp"), F.col("n_alerts")).alias("precision"),
        mathx.ratio(F.col("tp"), F.col("_pos")).alias("recall"),
        mathx.ratio(2 * F.col("tp"), F.col("n_alerts") + F.col("_pos")).alias("f1"),
    )
    best = Window.partitionBy(*by).orderBy(F.desc("f1"), "threshold")
    return long.withColumn("is_best", F.row_number().over(best) == 1)


def error_timeline(predictions: DataFrame) -> DataFrame:
    """False positives and false negatives by week."""
    kind = F.when((F.col("pred") == 1) & (F.col("actual") == 0), "false_positive").when(
        (F.col("pred") == 0) & (F.col("actual") == 1), "false_negative"
    )
    return evaluated(predictions).withColumn("error_type", kind).where(F.col("error_type").isNotNull()).select(
        *_by(predictions), "week_idx", "error_type"
    )


def confusion_4class(predictions: DataFrame) -> DataFrame:
    """All 16 (actual, predicted) cells per community and model, from one aggregate."""
    by = _by(predictions)
    cells = [(a, p) for a in range(4) for p in range(4)]
    counts = evaluated(predictions).groupBy(*by).agg(
        *[F.count_if((F.col("actual") == a) & (F.col("pred") == p)).alias(f"_{a}{p}") for a, p in cells])
    rows = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("pred"), F.col(f"_{a}{p}").alias("n")) for a, p in cells])
    return counts.select(*by, F.inline(rows))


def per_class(predictions: DataFrame) -> DataFrame:
    """One-vs-rest recall and precision per class."""
    by = _by(predictions)
    c = confusion_4class(predictions)
    classes = F.array(*[F.lit(i) for i in range(4)])
    long = c.select(*by, "actual", "pred", "n", F.explode(classes).alias("state"))
    hit = F.sum(F.when((F.col("actual") == F.col("state")) & (F.col("pred") == F.col("state")), F.col("n")).otherwise(0))
    return long.groupBy(*by, "state").agg(
        hit.alias("hit"),
        F.sum(F.when(F.col("actual") == F.col("state"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("pred") == F.col("state"), F.col("n")).otherwise(0)).alias("predicted"),
    ).withColumn("recall", mathx.ratio(F.col("hit"), F.col("support"))).withColumn(
        "precision", mathx.ratio(F.col("hit"), F.col("predicted"))
    )


# --- two models --------------------------------------------------------------


def explode_arrays(results: DataFrame, n_weeks: DataFrame | None = None) -> DataFrame:
    """Parallel arrays (predictions, probabilities, actuals) to long rows.

    NaN becomes null; with ``n_weeks`` (community, n_weeks) the arrays are cut or
    padded to the panel length.
    """
    nul = lambda c: F.when(~F.isnan(c), c)
    zipped = F.arrays_zip(F.col("predictions"), F.col("probabilities"), F.col("actuals"))
    keys = [c for c in results.columns if c not in ("predictions", "probabilities", "actuals")]
    if n_weeks is not None:
        results = results.join(n_weeks, "community")
        slots = F.when(F.col("n_weeks") > 0, F.sequence(F.lit(0), (F.col("n_weeks") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        results = results.select(*keys, zipped.alias("_z"), F.explode(slots).alias("week_idx")).withColumn(
            "_e", F.get(F.col("_z"), F.col("week_idx"))
        )
    else:
        results = results.select(*keys, F.posexplode(zipped).alias("week_idx", "_e"))
    return results.select(
        *keys, "week_idx", nul(F.col("_e")["predictions"]).alias("pred"),
        nul(F.col("_e")["probabilities"]).alias("prob"), nul(F.col("_e")["actuals"]).alias("actual"),
    )


def merge_models(first: DataFrame, second: DataFrame) -> DataFrame:
    """Display ensemble per week: higher state, mean of present probabilities, first known actual."""
    keys = ["community", "week_idx"]
    a = first.select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("pred", "prob", "actual")])
    b = second.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("pred", "prob", "actual")])
    j = a.join(b, keys, "full")
    both = F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull()
    worst = F.greatest("pred_a", "pred_b")
    state = F.when(both, F.least(F.greatest(worst, F.lit(0)), F.lit(3))).otherwise(worst)
    mean = F.coalesce((F.col("prob_a") + F.col("prob_b")) / 2.0, "prob_a", "prob_b")
    return j.select(*keys, state.alias("pred"), mean.alias("prob"), F.coalesce("actual_a", "actual_b").alias("actual"))


def ensemble(sequence: DataFrame, tabular: DataFrame, threshold: float = 0.3, minimum: int = 5) -> DataFrame:
    """Scored ensemble: mean probability, state 2 at the threshold, actual of the sequence model else 2 x binary.

    Communities with fewer than ``minimum`` evaluated weeks return no rows.
    """
    keys = ["community", "week_idx"]
    s = sequence.select(*keys, F.col("prob").alias("_ps"), F.col("actual").alias("_as"))
    t = tabular.select(*keys, F.col("prob").alias("_pt"), F.col("actual").alias("_at"))
    j = s.join(t, keys, "full")
    prob = F.coalesce((F.col("_ps") + F.col("_pt")) / 2.0, "_ps", "_pt")
    rows = j.select(*keys, prob.alias("prob"), F.coalesce(F.col("_as"), F.col("_at") * 2).alias("actual"))
    rows = rows.withColumn("pred", F.when(F.col("prob").isNotNull(), F.when(F.col("prob") >= threshold, F.lit(2)).otherwise(F.lit(0))))
    valid = F.count_if(F.col("prob").isNotNull() & F.col("actual").isNotNull()).over(Window.partitionBy("community"))
    return rows.withColumn("_n", valid).where(F.col("_n") >= minimum).drop("_n").select(*keys, "pred", "prob", "actual")


def average_metrics(metrics: DataFrame, names: Sequence[str] = ("recall", "precision", "f1", "pr_auc")) -> DataFrame:
    """Mean of the metrics that are present, per community."""
    return metrics.groupBy("community").agg(*[F.avg(n).alias(n) for n in names])


def _by_model(models: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [F.max(F.when(F.col("model") == m, F.col(n))).alias(f"{m}_{n}") for m in models for n in names]


def compare_models(metrics: DataFrame, models: Sequence[str], names: Sequence[str] = ("recall", "precision", "f1", "pr_auc", "roc_auc")) -> DataFrame:
    """One row per community, one column per model and metric."""
    return metrics.groupBy("community").agg(*_by_model(models, names))


def section_summary(metrics: DataFrame, models: Sequence[str], support: int = 10) -> DataFrame:
    """PR-AUC and recall side by side and the number of models with too little support."""
    alerts = F.count_if(F.col("n_crisis_actual") < support).alias("alerts")
    return metrics.groupBy("community").agg(*_by_model(models, ("pr_auc", "recall")), alerts)


def performance_bands(metrics: DataFrame, tabular: str, sequence: str, high: float = 0.45, low: float = 0.20) -> DataFrame:
    """High / Medium / Low by the better PR-AUC, and the winning model."""
    wide = compare_models(metrics, (tabular, sequence), ("pr_auc",))
    t, s = F.col(f"{tabular}_pr_auc"), F.col(f"{sequence}_pr_auc")
    best = F.greatest(t, s)
    winner = (
        F.when(t.isNull() & s.isNull(), F.lit("none")).when(s.isNull(), F.lit(tabular)).when(t.isNull(), F.lit(sequence))
        .when(s > t, F.lit(sequence)).otherwise(F.lit(tabular))
    )
    band = F.when(best >= high, "High").when(best < low, "Low").otherwise("Medium")
    return wide.select("community", best.alias("best_pr_auc"), winner.alias("winner"), band.alias("band"))


def anomaly_flags(metrics: DataFrame) -> DataFrame:
    """One row per suspicious metric of a community and model."""
    checks = F.array(
        F.when(F.col("n_crisis_actual") < 10, F.lit("low crisis support")),
        F.when(F.col("recall") <= 0, F.lit("recall is zero")),
        F.when(F.col("pr_auc") < 0.12, F.lit("PR-AUC very low")),
        F.when(F.col("roc_auc") < 0.5, F.lit("ROC-AUC below random")),
    )
    return metrics.select(*_by(metrics), F.explode(F.array_compact(checks)).alias("flag"))


def recall_table(usefulness: DataFrame) -> DataFrame:
    """Recall@K table with the nested metrics laid out flat."""
    return usefulness.select(*_by(usefulness), "k", "captured", "total_positives", "recall", "random_recall", "persistence_recall")


_PACK = "map<string,struct<captured:bigint,total_positives:bigint,recall:double>>"
USEFULNESS = f"struct<model:{_PACK},random_expected_recall:map<string,double>,persistence:{_PACK}>"


def usefulness_json(usefulness: DataFrame) -> DataFrame:
    """One nested JSON text per community and model, keyed by K (the stored report form)."""
    by = _by(usefulness)
    key = F.col("k").cast("string")
    entries = lambda *cols: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.struct(*cols).alias("v")))))
    packed = usefulness.groupBy(*by).agg(
        entries("captured", "total_positives", "recall").alias("model_recall"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.col("random_recall").alias("v"))))).alias("random"),
        entries(F.col("persistence_captured").alias("captured"), "total_positives", F.col("persistence_recall").alias("recall")).alias("persistence"),
    )
    body = F.struct(F.col("model_recall").alias("model"), F.col("random").alias("random_expected_recall"), "persistence")
    return packed.select(*by, F.to_json(body).alias("usefulness"))


def recall_table_from_json(reports: DataFrame, column: str = "usefulness") -> DataFrame:
    """Nested Recall@K reports to rows (one per K), the three metric maps joined on K."""
    by = _by(reports)
    j = F.from_json(F.col(column), USEFULNESS)
    rows = reports.select(*by, j.alias("j")).select(*by, "j", F.explode("j.model").alias("key", "m"))
    persistence = F.element_at("j.persistence", F.col("key"))
    return rows.select(
        *by, F.col("key").cast("int").alias("k"), "m.captured", "m.total_positives", "m.recall",
        F.element_at("j.random_expected_recall", F.col("key")).alias("random_recall"), persistence["recall"].alias("persistence_recall"),
    )


def monitoring_only(metrics: DataFrame, minimum: int = 10) -> DataFrame:
    return metrics.select(*_by(metrics), "n_crisis_actual", (F.col("n_crisis_actual") < minimum).alias("monitoring_only"))


def apply_calibrator(prob: Column, cal: Column) -> Column:
    """Probability through a calibrator struct (type, coef, intercept, x, y)."""
    platt = mathx.sigmoid(cal["coef"] * prob + cal["intercept"])
    usable = (F.size(cal["x"]) >= 2) & (F.size(cal["x"]) == F.size(cal["y"]))
    iso = F.when(usable, mathx.interpolate(prob, cal["x"], cal["y"])).otherwise(mathx.clip01(prob))
    return F.when(cal["type"] == "platt", platt).when(cal["type"] == "isotonic", iso).otherwise(mathx.clip01(prob))


def rescale_classes(probs: Column, calibrated: Column) -> Column:
    """Classes 2 and 3 scaled by calibrated / raw crisis mass and clipped; 0 and 1 as they are."""
    raw = F.element_at(probs, 3) + F.element_at(probs, 4)
    factor = F.when(raw > 0, calibrated / raw).otherwise(F.lit(1.0))
    return F.transform(probs, lambda p, i: F.when((i >= 2) & (raw > 0), mathx.clip01(p * factor)).otherwise(p))


def first_hits(predictions: DataFrame, n: int = 3) -> DataFrame:
    """First n correctly predicted crisis weeks."""
    by = _by(predictions)
    order = Window.partitionBy(*by).orderBy("week_idx")
    hits = evaluated(predictions).where((F.col("pred") >= 1) & (F.col("actual") >= 1))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(*by, "week_idx", "rank", "prob")
