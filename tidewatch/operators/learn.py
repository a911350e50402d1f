"""Models over the panel: walk-forward evaluation, final models, transfer, ablation, importance.

Folds are rows.  Thresholds, labels of the test week, splits and metrics are Spark
expressions; only the numeric fit of one fold runs in Python, on one community's
weeks.  Folds of a community are spread over tasks in blocks, so the number of tasks
grows with communities x folds and a task never holds more than one weekly series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import fits, mathx
from tidewatch.operators import folds, metrics, scoring, serve, stats
from tidewatch.operators.weekly import with_week_index
from tidewatch.schemas import FAMILY_COLUMNS, STATE_CUTS
from tidewatch.session import cut_lineage, spread

CALIBRATOR = "struct<type:string,coef:double,intercept:double,x:array<double>,y:array<double>>"
FOLD_SCHEMA = (
    "community string, fold_i int, week_idx int, prob double, pred int, n_train int, n_crisis_train int, "
    "crisis_rate_train double, calibrator string, skipped boolean, skip_reason string, actual int, converged boolean"
)
TABULAR_MODEL = f"community string, model struct<intercept:double,coef:array<double>>, calibrator {CALIBRATOR}"
SEQUENCE_MODEL = f"community string, model struct<intercept:array<double>,coef:array<array<double>>>, calibrator {CALIBRATOR}"

#: Penalties of the tabular search; the first one is taken where there are too few rows to search.
L2_GRID = (1.0, 0.1, 10.0)
#: Penalties of sequence models, whose loss is a mean; a fit takes the first, ``search_sequence`` chooses among all.
SEQUENCE_GRID = (1e-2, 1e-3, 1e-1)


def _rows(scored: DataFrame, features: Sequence[str], length: int | None, score: str) -> DataFrame:
    """community, week_idx, score, next score and the model input of each week."""
    rows = scored if "week_idx" in scored.columns else with_week_index(scored)
    nxt = F.lead(score).over(Window.partitionBy("community").orderBy("week_start"))
    x = folds.sequence_column(features, length) if length else F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return rows.select("community", "week_start", "week_idx", F.col(score).alias("score"), nxt.alias("next_score"), x.alias("x"))


def _with_dev(rows: DataFrame, holdout: int, min_train: int, gap: int) -> DataFrame:
    """``dev_n``, the community's number of development weeks, on every row."""
    n = F.count("*").over(Window.partitionBy("community"))
    return rows.withColumn("dev_n", folds.dev_rows(n, holdout, min_train + gap))


def _classes(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return (values[:, None] >= cuts[None, :]).sum(axis=1)


def _tail(n: int, fraction: float, minimum: int) -> int:
    return min(max(minimum, int(round(n * fraction))), max(0, n - 1))


def _fit_tabular(x, y, opts, need_positive: bool = False):
    """(coefficients, intercept, calibrator); the last rows calibrate, the others fit."""
    n_fit = len(y) - _tail(len(y), opts["fraction"], opts["min_samples"])
    if n_fit < 1 or (need_positive and not y[:n_fit].sum()):
        return None
    l2 = fits.search_l2(x[:n_fit], y[:n_fit], opts["grid"])
    coef, b = fits.fit_binary(x[:n_fit], y[:n_fit], l2)
    raw = 1.0 / (1.0 + np.exp(-np.clip(x[n_fit:] @ coef + b, -35, 35)))
    cal = fits.fit_calibrator(raw, y[n_fit:], opts["method"], opts["min_samples"], opts["min_class"])
    return coef, b, cal


def _fit_sequence(x, y4, opts):
    n_fit = len(y4) - _tail(len(y4), opts["fraction"], opts["min_samples"])
    if n_fit < opts["length"] + 2:
        return None
    coef, b, converged = fits.fit_classes(x[:n_fit], y4[:n_fit], l2=opts["grid"][0])
    p = fits.softmax(x[n_fit:] @ coef.T + b)
    cal = fits.fit_calibrator(p[:, 2] + p[:, 3], (y4[n_fit:] >= 2).astype(float), opts["method"], opts["min_samples"], opts["min_class"])
    return coef, b, cal, converged


def _fold_block(opts: dict):
    sequence = opts["length"] is not None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("week_idx").reset_index(drop=True)  # row k is week k: blocks start at week 0
        x = [None if v is None else np.asarray(v, dtype=float) for v in rows["x"]]
        nxt = rows["next_score"].to_numpy(dtype=float)
        out = []
        for f in rows[rows["asked"]].itertuples(index=False):
            end = int(f.week_idx) - opts["gap"]
            cuts = np.array([f.t1, f.t2, f.t3], dtype=float)
            values = nxt[:end].copy()
            values[-1] = f.score if opts["compat"] else np.nan
            known = _classes(values[np.isfinite(values)], cuts)
            n, pos = len(known), int((known >= 2).sum())
            short = n < opts["length"] + 5 or len(set(known)) < 2 if sequence else n < 10 or pos < 2
            base = dict(community=f.community, fold_i=int(f.fold_i), week_idx=int(f.week_idx), n_train=n, n_crisis_train=pos,
                        crisis_rate_train=pos / n if n else 0.0, actual=None if pd.isna(f.actual) else int(f.actual))
            here = x[int(f.week_idx)]
            if short or here is None:
                reason = "insufficient_sequence_or_class_variety" if sequence else folds.REASON
                out.append({**base, "skipped": True, "skip_reason": reason})
                continue
            keep = np.array([np.isfinite(v) and x[i] is not None for i, v in enumerate(values)])
            train, labels = np.vstack([x[i] for i in np.flatnonzero(keep)]), _classes(values[keep], cuts)
            fit = _fit_sequence(train, labels, opts) if sequence else _fit_tabular(train, (labels >= 2).astype(float), opts)
            if fit is None:
                out.append({**base, "skipped": True, "skip_reason": "insufficient_fit_window"})
                continue
            coef, b, cal, *converged = fit
            if sequence:
                p = fits.softmax((coef @ here + b)[None, :])[0]
                raw, state = p[2] + p[3], int(np.argmax(p))
            else:
                raw = 1.0 / (1.0 + np.exp(-np.clip(here @ coef + b, -35, 35)))
            prob = float(fits.calibrate(np.array([raw]), cal)[0])
            pred = state if sequence else int(prob >= opts["threshold"])
            out.append({**base, "prob": prob, "pred": pred, "calibrator": cal["type"], "skipped": False, "converged": converged[0] if sequence else None})
        names = [c.split()[0] for c in FOLD_SCHEMA.split(", ")]
        return pd.DataFrame({n: pd.Series([o.get(n) for o in out], dtype=object) for n in names})

    return run


def _options(length, gap, threshold, fraction, method, min_samples, min_class, grid, compat) -> dict:
    return dict(length=length, gap=gap, threshold=threshold, fraction=fraction, method=method, min_samples=min_samples,
                min_class=min_class, grid=tuple(grid or (SEQUENCE_GRID if length else L2_GRID)), compat=compat)


def walk_forward(
    scored: DataFrame, features: Sequence[str], *, cuts: Sequence[float] = STATE_CUTS, sequence_length: int | None = None,
    min_train: int = 26, gap: int = 1, holdout: int = 12, threshold: float = 0.3, fraction: float = 0.2,
    method: str = "platt", min_samples: int = 20, min_class: int = 3, l2_grid: Sequence[float] | None = None,
    compat: bool = False, folds_per_task: int = 16, score: str = "distress_score",
) -> DataFrame:
    """Fold records with the calibrated prediction and the actual class of every test week.

    Without ``sequence_length`` the binary tabular model (pred 0/1, actual 0/1), with it
    the 4-class model on the last L weeks (pred and actual 0..3, prob = P(state >= 2)).
    ``converged`` tells of each sequence fit whether its gradient vanished; a fit that isn't finite is an error.
    """
    first = min_train + (sequence_length or 0) + gap
    rows = _with_dev(_rows(scored, features, sequence_length, score), holdout, first - gap, gap)
    # A test week is its own fold: its thresholds are expanding statistics of the same series.
    past = Window.partitionBy("community").orderBy("week_start").rowsBetween(Window.unboundedPreceding, -(gap + 1))
    rows = rows.withColumn("_m", F.avg("score").over(past)).withColumn("_s", F.stddev_samp("score").over(past))
    for i, k in enumerate(cuts, 1):
        rows = rows.withColumn(f"t{i}", F.col("_m") + F.lit(float(k)) * F.col("_s"))
    state = mathx.bucket(F.col("next_score"), [F.col("t1"), F.col("t2"), F.col("t3")])
    rows = rows.withColumn("actual", state if sequence_length else (state >= 2).cast("int"))
    # A row goes to the block of its own fold and to all later ones, which train on it.
    block = lambda week: F.floor((week - first) / F.lit(folds_per_task)).cast("int")
    needed = F.sequence(F.greatest(block(F.col("week_idx")), F.lit(0)), block(F.col("dev_n") - 1))
    blocks = (
        rows.where((F.col("dev_n") > first) & (F.col("week_idx") < F.col("dev_n")))
        .withColumn("fold_i", F.col("week_idx") - first).withColumn("block", F.explode(needed))
        .withColumn("asked", (F.col("fold_i") >= 0) & (block(F.col("week_idx")) == F.col("block")))
    )
    opts = _options(sequence_length, gap, threshold, fraction, method, min_samples, min_class, l2_grid, compat)
    columns = ("community", "block", "week_idx", "fold_i", "asked", "score", "next_score", "x", "t1", "t2", "t3", "actual")
    return spread(blocks.select(*columns), "community", "block").groupBy("community", "block").applyInPandas(_fold_block(opts), FOLD_SCHEMA)


def _whole_cuts(score: str, cuts: Sequence[float], used: Column | None = None) -> list[Column]:
    """Thresholds of a community over the rows that ``used`` marks (all by default)."""
    whole = Window.partitionBy("community")
    v = F.col(score) if used is None else F.when(used, F.col(score))
    return [F.avg(v).over(whole) + F.lit(float(k)) * F.stddev_samp(v).over(whole) for k in cuts]


def _final(opts: dict):
    sequence = opts["length"] is not None

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("week_idx")
        keep = rows["label"].notna() & rows["x"].notna()
        empty = pd.DataFrame({"community": [], "model": [], "calibrator": []}, dtype=object)
        if not keep.any():
            return empty
        x = np.vstack([np.asarray(v, dtype=float) for v in rows["x"][keep]])
        y = rows["label"][keep].to_numpy(dtype=int)
        fit = _fit_sequence(x, y, opts) if sequence else _fit_tabular(x, (y >= 2).astype(float), opts, need_positive=True)
        if fit is None:
            return empty
        coef, b, cal = fit[:3]
        model = {"intercept": b.tolist() if sequence else float(b), "coef": coef.tolist()}
        return pd.DataFrame({"community": [rows["community"].iloc[0]], "model": [model], "calibrator": [cal]})

    return run


def final_models(
    scored: DataFrame, features: Sequence[str], *, cuts: Sequence[float] = STATE_CUTS, sequence_length: int | None = None,
    min_train: int = 26, gap: int = 1, holdout: int = 12, fraction: float = 0.2, method: str = "platt",
    min_samples: int = 20, min_class: int = 3, l2_grid: Sequence[float] | None = None, score: str = "distress_score",
) -> DataFrame:
    """One model and calibrator per community, fitted on its development weeks."""
    span = min_train + (sequence_length or 0)
    rows = _rows(scored, features, sequence_length, score)
    train = _with_dev(rows, holdout, span, gap).where((F.col("dev_n") > span + gap) & (F.col("week_idx") < F.col("dev_n")))
    # The last development week is labelled by the first holdout week, as a final fit may.
    labeled = train.withColumn("label", mathx.bucket(F.col("next_score"), _whole_cuts("score", cuts)))
    opts = _options(sequence_length, gap, 0.3, fraction, method, min_samples, min_class, l2_grid, False)
    schema = SEQUENCE_MODEL if sequence_length else TABULAR_MODEL
    return spread(labeled.select("community", "week_idx", "label", "x"), "community").groupBy("community").applyInPandas(_final(opts), schema)


def predict(scored: DataFrame, features: Sequence[str], models: DataFrame, sequence_length: int | None = None,
            threshold: float = 0.3, score: str = "distress_score", keep: Sequence[str] = ()) -> DataFrame:
    """Every week through its community's final model, in JVM expressions."""
    base = scored if "week_idx" in scored.columns else with_week_index(scored)
    x = folds.sequence_column(features, sequence_length) if sequence_length else F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    keys = ("community", "week_start", "week_idx")
    rows = base.select(*keys, *keep, x.alias("x")).where(F.col("x").isNotNull()).join(models, "community")
    if sequence_length:
        out = rows.withColumn("_p", serve.class_probabilities(F.col("x"), F.col("model")))
        out = out.withColumn("prob", metrics.apply_calibrator(F.element_at("_p", 3) + F.element_at("_p", 4), F.col("calibrator")))
        out = out.withColumn("pred", F.array_position("_p", F.array_max("_p")).cast("int") - 1)
        return out.select(*keys, *keep, "pred", "prob", metrics.rescale_classes(F.col("_p"), F.col("prob")).alias("probs"))
    prob = metrics.apply_calibrator(serve.linear_probability(F.col("x"), F.col("model")), F.col("calibrator"))
    return rows.withColumn("prob", prob).select(*keys, *keep, (F.col("prob") >= threshold).cast("int").alias("pred"), "prob")


def holdout_predictions(scored: DataFrame, features: Sequence[str], models: DataFrame, *, cuts: Sequence[float] = STATE_CUTS,
                        sequence_length: int | None = None, min_train: int = 26, gap: int = 1, holdout: int = 12,
                        threshold: float = 0.3, score: str = "distress_score") -> DataFrame:
    """Final models on the weeks kept back, with the actual class by development thresholds."""
    span = min_train + (sequence_length or 0)
    rows = _with_dev(scored if "week_idx" in scored.columns else with_week_index(scored), holdout, span, gap)
    nxt = F.lead(score).over(Window.partitionBy("community").orderBy("week_start"))
    rows = rows.withColumn("_next", nxt)
    for i, c in enumerate(_whole_cuts(score, cuts, F.col("week_idx") < F.col("dev_n")), 1):
        rows = rows.withColumn(f"_t{i}", c)
    labeled = rows.withColumn("label", mathx.bucket(F.col("_next"), [F.col("_t1"), F.col("_t2"), F.col("_t3")]))
    out = predict(labeled, features, models, sequence_length, threshold, score, keep=("label", "dev_n"))
    actual = F.col("label") if sequence_length else (F.col("label") >= 2).cast("int")
    return out.where((F.col("week_idx") >= F.col("dev_n")) & F.col("label").isNotNull()).select(
        "community", "week_idx", "pred", "prob", actual.alias("actual"))


# --- whole-history fits: transfer, ablation, importance ----------------------


def labeled_rows(scored: DataFrame, features: Sequence[str], cuts: Sequence[float] = STATE_CUTS, score: str = "distress_score") -> DataFrame:
    """Weeks with a known next-week class: community, week_idx, x, y (1 = elevated)."""
    rows = scored if "week_idx" in scored.columns else with_week_index(scored)
    s = scoring.fit_states(rows, cuts, score).where(F.col("label").isNotNull())
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return s.select("community", "week_start", "week_idx", x.alias("x"), (F.col("label") >= 2).cast("int").alias("y"))


def _whole_fit(l2: float, min_rows: int, min_positive: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["y"].to_numpy(dtype=float)
        if len(y) < min_rows or y.sum() < min_positive:
            return pd.DataFrame({"community": [], "variant": [], "model": []}, dtype=object)
        x = np.vstack([np.asarray(v, dtype=float) for v in rows["x"]])
        coef, b = fits.fit_binary(x, y, l2)
        return pd.DataFrame({"community": [key[0]], "variant": [key[1]], "model": [{"intercept": float(b), "coef": coef.tolist()}]})

    return run


def fit_variants(rows: DataFrame, variants: Mapping[str, Sequence[int]] | None, width: int, l2: float = 1.0,
                 min_rows: int = 10, min_positive: int = 2) -> DataFrame:
    """One model per community and variant; a variant lists the input positions it may use."""
    every = {"full": list(range(width))} if variants is None else {k: list(v) for k, v in variants.items()}
    cells = F.array(*[
        F.struct(F.lit(k).alias("variant"), F.array(*[F.lit(1.0 if i in set(v) else 0.0) for i in range(width)]).alias("mask"))
        for k, v in every.items()
    ])
    wide = rows.select("community", "y", "x", F.inline(cells)).withColumn("x", F.zip_with("x", "mask", lambda a, m: a * m))
    schema = "community string, variant string, model struct<intercept:double,coef:array<double>>"
    return spread(wide.select("community", "variant", "y", "x"), "community", "variant").groupBy("community", "variant").applyInPandas(_whole_fit(l2, min_rows, min_positive), schema)


def transfer(scored: DataFrame, features: Sequence[str], communities: Sequence[str] | DataFrame, cuts: Sequence[float] = STATE_CUTS,
             threshold: float = 0.5, l2: float = 1.0, score: str = "distress_score") -> DataFrame:
    """Model of one community scored on another, for every ordered pair that is asked (a list or a table of pairs)."""
    rows = labeled_rows(scored, features, cuts, score)
    models = fit_variants(rows, None, len(features), l2).select(F.col("community").alias("source"), "model")
    asked = stats.asked_pairs(scored.sparkSession, communities)
    pairs = asked.join(models, "source").join(rows.withColumnRenamed("community", "target"), "target")
    p = pairs.withColumn("prob", serve.linear_probability(F.col("x"), F.col("model"))).select(
        F.col("target").alias("community"), F.col("source").alias("model"), "week_idx", "prob",
        (F.col("prob") >= threshold).cast("int").alias("pred"), F.col("y").alias("actual"),
    )
    pack = metrics.metric_pack(p)
    return pack.where(F.col("n_valid_predictions") >= 5).select(
        F.col("model").alias("source"), F.col("community").alias("target"), "pr_auc", "recall", "f1",
        F.col("n_valid_predictions").alias("n_test"), F.col("n_crisis_actual").alias("n_positive"),
    )


def family_of(column: str) -> str:
    """Family a feature belongs to; derived columns are temporal."""
    if column.endswith("_delta") or "_roll" in column or column in ("week_sin", "week_cos"):
        return "temporal"
    for family, columns in FAMILY_COLUMNS.items():
        if column in columns:
            return family
    return "distress" if column.endswith(("_density", "_total")) else "other"


def ablation(scored: DataFrame, features: Sequence[str], families: Mapping[str, Sequence[str]] | None = None,
             cuts: Sequence[float] = STATE_CUTS, l2: float = 1.0, score: str = "distress_score") -> DataFrame:
    """In-sample PR-AUC with each feature family left out, and the drop against all features."""
    groups: dict[str, list[str]] = {k: list(v) for k, v in families.items()} if families else {}
    if not groups:
        for f in features:
            groups.setdefault(family_of(f), []).append(f)
    pos = {f: i for i, f in enumerate(features)}
    variants = {"full": list(pos.values())}
    for name, cols in groups.items():
        left = [i for f, i in pos.items() if f not in cols]
        if left:
            variants[name] = left
    rows = labeled_rows(scored, features, cuts, score)
    models = fit_variants(rows, variants, len(features), l2, 15, 2)
    p = rows.join(models, "community").withColumn("prob", serve.linear_probability(F.col("x"), F.col("model"))).select(
        "community", F.col("variant").alias("model"), "week_idx", "prob", (F.col("prob") >= 0.5).cast("int").alias("pred"), F.col("y").alias("actual"))
    whole = F.max(F.when(F.col("model") == "full", F.col("pr_auc"))).over(Window.partitionBy("community"))
    areas = metrics.average_precision(p).withColumn("full_pr_auc", whole)
    removed = F.create_map(*[F.lit(x) for k, v in groups.items() for x in (k, len([c for c in v if c in pos]))])
    return areas.where((F.col("model") != "full") & F.col("full_pr_auc").isNotNull()).select(
        "community", F.col("model").alias("family"), "pr_auc", "full_pr_auc",
        (F.col("full_pr_auc") - F.col("pr_auc")).alias("pr_auc_drop"), F.element_at(removed, F.col("model")).alias("n_features_removed"),
    )


def linear_attribution(rows: DataFrame, models: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact mean absolute attribution of a linear model: mean |coef * (x - mean x)|."""
    names = F.array(*[F.lit(f) for f in features])
    long = rows.join(models.select("community", "model"), "community").select(
        "community", "week_idx", F.inline(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("model")["coef"].alias("coef"))))
    mean = F.avg("value").over(Window.partitionBy("community", "feature"))
    return long.withColumn("_m", mean).groupBy("community", "feature").agg(
        F.avg(F.abs(F.col("coef") * (F.col("value") - F.col("_m")))).alias("importance"))


def permutation_importance(rows: DataFrame, models: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Loss of PR-AUC when one feature is shuffled among a community's weeks, all features in one job.

    The shuffle pairs the i-th week with the week of i-th smallest hash, an equi-join
    on (community, feature, position); only the changed term of the linear score is redone.
    """
    names = F.array(*[F.lit(f) for f in features])
    base = rows.join(models.select("community", "model"), "community").withColumn(
        "_z", F.col("model")["intercept"] + F.aggregate(F.zip_with("x", F.col("model")["coef"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
    place = F.row_number().over(Window.partitionBy("community").orderBy("week_idx"))
    base = base.withColumn("_i", place)
    long = base.select("community", "week_idx", "_i", "y", "_z", F.inline(F.arrays_zip(
        names.alias("feature"), F.col("x").alias("value"), F.col("model")["coef"].alias("coef"))))
    order = Window.partitionBy("community", "feature").orderBy(F.xxhash64(F.lit(seed), "feature", "week_idx"), "week_idx")
    swapped = long.select("community", "feature", F.col("value").alias("other"), F.row_number().over(order).alias("_i"))
    shuffled = long.join(swapped, ["community", "feature", "_i"]).withColumn(
        "prob", mathx.sigmoid(F.col("_z") + F.col("coef") * (F.col("other") - F.col("value"))))
    as_rows = lambda df, name, z: df.select("community", name.alias("model"), "week_idx", z.alias("prob"), F.lit(0).alias("pred"), F.col("y").alias("actual"))
    changed = metrics.average_precision(as_rows(shuffled, F.col("feature"), F.col("prob")))
    plain = metrics.average_precision(as_rows(base, F.lit("full"), mathx.sigmoid(F.col("_z")))).select("community", F.col("pr_auc").alias("base_pr_auc"))
    return changed.join(plain, "community").select(
        "community", F.col("model").alias("feature"), "base_pr_auc", "pr_auc", (F.col("base_pr_auc") - F.col("pr_auc")).alias("importance"))


# --- pooled models with pyspark.ml -------------------------------------------


def fit_gbt(rows: DataFrame, cap: float = 8.0, depth: int = 5, rate: float = 0.1, trees: int = 200, seed: int = 42):
    """Boosted trees over all communities' labelled weeks, positives weighted by min(neg / pos, cap)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    balance = rows.agg(F.least(F.lit(cap), F.count_if(F.col("y") == 0) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1)))).scalar()
    train = rows.select(array_to_vector(F.col("x")).alias("features"), F.col("y").cast("double").alias("label"),
                        F.when(F.col("y") == 1, balance).otherwise(F.lit(1.0)).alias("weight"))
    return GBTClassifier(maxDepth=depth, stepSize=rate, maxIter=trees, seed=seed, weightCol="weight").fit(train)


def gbt_probability(rows: DataFrame, model) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(rows.withColumn("features", array_to_vector(F.col("x"))))
    return out.withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def tune_gbt(rows: DataFrame, grid: Sequence[Mapping[str, float]], share: float = 0.8, threshold: float = 0.3) -> tuple[dict, list[dict]]:
    """Grid search with a time split: the first ``share`` of each community trains, the rest scores PR-AUC + 0.05 * recall."""
    place = F.percent_rank().over(Window.partitionBy("community").orderBy("week_idx"))
    split = rows.withColumn("_at", place)
    train, test = split.where(F.col("_at") < share), split.where(F.col("_at") >= share)
    trials = []
    for params in grid:
        p = gbt_probability(test, fit_gbt(train, **params)).select(
            F.lit("all").alias("community"), "prob", (F.col("prob") >= threshold).cast("int").alias("pred"), F.col("y").alias("actual"))
        row = metrics.metric_pack(p).first()
        score = (row["pr_auc"] + 0.05 * row["recall"]) if row else 0.0
        trials.append({**params, "score": float(score)})
    return max(trials, key=lambda t: t["score"]), trials


def search_sequence(
    scored: DataFrame, features: Sequence[str], *, lengths: Sequence[int] = (4, 6, 8, 12), l2_grid: Sequence[float] = SEQUENCE_GRID,
    cuts: Sequence[float] = STATE_CUTS, share: float = 0.8, rungs: int = 3, holdout: int = 12, min_train: int = 26, gap: int = 1,
    score: str = "distress_score",
) -> DataFrame:
    """Trials of a search over window length and penalty by successive halving: community, length, l2, rung, n_fit, n_scored, recall, kept.

    All candidates of all communities are rows of one job a rung.  Rung r fits on the last development weeks, a
    2^-(rungs-1-r) part of them, and scores the mean recall of the classes in the last 1 - ``share`` of that part; the
    better half of a community's candidates (rank by recall, then shorter windows, then larger penalties) goes on, one
    from the last rung.  The row with ``kept`` on the last rung is the choice.
    """
    first = min_train + max(lengths) + gap
    tables = [
        _with_dev(_rows(scored, features, k, score), holdout, first - gap, gap).withColumn("length", F.lit(k)) for k in lengths
    ]
    rows = reduce(DataFrame.unionByName, tables).where("week_idx < dev_n")
    past = Window.partitionBy("community", "length")
    label = mathx.bucket(F.col("next_score"), [F.avg("score").over(past) + F.lit(float(k)) * F.stddev_samp("score").over(past) for k in cuts])
    rows = rows.withColumn("label", label).where("x IS NOT NULL AND label IS NOT NULL AND week_idx < dev_n - 1")
    rows = cut_lineage(rows.select("community", "length", "week_idx", "dev_n", "x", "label"))
    penalties = F.explode(F.array(*[F.lit(float(v)) for v in l2_grid])).alias("l2")
    alive = rows.select("community", "length").distinct().select("*", penalties)
    trials = None
    for rung in range(rungs):
        part = rows.where(F.col("week_idx") >= F.col("dev_n") * (1 - 0.5 ** (rungs - 1 - rung)))
        asked = spread(part.join(alive, ["community", "length"]).select("community", "length", "l2", "week_idx", "x", "label"), "community", "length", "l2")
        scores = asked.groupBy("community", "length", "l2").applyInPandas(_trial(share), "community string, length int, l2 double, n_fit int, n_scored int, recall double")
        place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc_nulls_last("recall"), "length", F.desc("l2")))
        most = F.lit(1) if rung == rungs - 1 else F.ceil(F.count("*").over(Window.partitionBy("community")) / 2)
        done = cut_lineage(scores.select("community", "length", "l2", F.lit(rung).alias("rung"), "n_fit", "n_scored", "recall", (place <= most).alias("kept")))
        alive = done.where("kept").select("community", "length", "l2")
        trials = done if trials is None else trials.unionByName(done)
    return trials


def _trial(share: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("week_idx")
        x, y = np.vstack([np.asarray(v, dtype=float) for v in rows["x"]]), rows["label"].to_numpy(dtype=int)
        n = int(len(y) * share)
        recall = None
        if n >= 5 and n < len(y):
            coef, b, _ = fits.fit_classes(x[:n], y[:n], l2=float(key[2]))
            pred = np.argmax(x[n:] @ coef.T + b, axis=1)
            recall = float(np.mean([(pred[y[n:] == c] == c).mean() for c in np.unique(y[n:])]))
        return pd.DataFrame({"community": [key[0]], "length": [key[1]], "l2": [key[2]], "n_fit": [n], "n_scored": [len(y) - n], "recall": pd.Series([recall], dtype=float)})

    return run


def _topic_words(width: int):
    """Texts to word counts in ``width`` hashed slots, so that no word is left out of a vocabulary."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, RegexTokenizer, StopWordsRemover

    return PipelineModel(stages=[
        RegexTokenizer(inputCol="clean_text", outputCol="_words", pattern=r"(?U)\W+", minTokenLength=1),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        HashingTF(inputCol="_kept", outputCol="features", numFeatures=width),
    ])


def word_counts(posts: DataFrame, width: int = 1 << 15) -> DataFrame:
    """Posts with a text long enough for a topic, and ``features``: stored, they serve fit and assignment without the texts."""
    usable = posts.where(F.length("clean_text") > 10)
    return _topic_words(width).transform(usable).select(*posts.columns, "features")


def fit_topics(posts: DataFrame, k: int = 15, width: int = 1 << 15, rounds: int = 20, seed: int = 42, min_topic_size: int = 10):
    """Topic model on all posts; None with too few texts.

    Words are hashed to ``width`` slots, so none is left out of a vocabulary.  Online LDA keeps only the k x width
    matrix and walks the posts in mini-batches.  Posts that have ``word_counts`` are taken as they are.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.clustering import LDA

    counted = "features" in posts.columns
    usable = posts.select("features") if counted else posts.where(F.length("clean_text") > 10).select("clean_text")
    if usable.limit(2 * min_topic_size).count() < 2 * min_topic_size:
        return None
    words = _topic_words(width)
    # Every round of the fit reads the word counts, not the texts; they are stored where a lost executor cannot take them.
    counts = usable if counted else cut_lineage(words.transform(usable).select("features"))
    topics = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online", featuresCol="features").fit(counts)
    return PipelineModel(stages=[*words.stages, topics])


def assign_topics(posts: DataFrame, model) -> DataFrame:
    """``topic_id`` per post: the most probable topic, -1 for posts without known words.

    Posts that have ``word_counts`` go to the model's last stage.  The distribution goes through a generator: a filter on
    the topic would be pushed below the model and run it, from the tokenizer on, once more for each use of the distribution.
    """
    from pyspark.ml.functions import vector_to_array

    out = model.stages[-1].transform(posts) if "features" in posts.columns else model.transform(posts.where(F.length("clean_text") > 10))
    out = out.select(*posts.columns, F.explode(F.array(vector_to_array("topicDistribution"))).alias("_d"))
    known = F.aggregate(F.col("_d"), F.lit(0.0), lambda a, v: a + v) > 0
    topic = F.when(known, F.array_position("_d", F.array_max("_d")).cast("int") - 1).otherwise(F.lit(-1))
    return out.select(*posts.columns, topic.alias("topic_id"))
