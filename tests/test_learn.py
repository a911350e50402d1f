import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewatch.functions import fits
from tidewatch.operators import learn, metrics, serve, stats
from tidewatch.plans import checks_learn, jobs

W = [dt.date(2020, 1, 6) + dt.timedelta(weeks=i) for i in range(130)]
COLS = ["f1", "f2", "f3"]


@pytest.fixture(scope="module")
def scored(spark):
    """Two communities whose next-week score follows f1; f3 is noise."""
    frames = []
    for c, seed in (("a", 1), ("b", 2)):
        rng = np.random.default_rng(seed)
        s = np.zeros(100)
        for t in range(1, 100):
            s[t] = 0.5 * s[t - 1] + rng.normal()
        lead = np.append(s[1:], 0)
        frames.append(pd.DataFrame({"community": c, "week_start": W[:100], "distress_score": s, "f1": lead + 0.3 * rng.normal(size=100), "f2": s, "f3": rng.normal(size=100)}))
    return spark.createDataFrame(pd.concat(frames)).cache()


def test_walk_forward_tabular(scored):
    w = learn.walk_forward(scored, COLS, folds_per_task=7)
    r = w.collect()
    assert len(r) == 2 * (88 - 27)
    ran = [x for x in r if not x["skipped"]]
    assert ran and all(0 <= x["prob"] <= 1 for x in ran)
    pack = metrics.metric_pack(w.where("not skipped").withColumn("model", F.lit("m"))).collect()
    assert all(p["roc_auc"] > 0.6 for p in pack)


def test_blocks_do_not_change_folds(scored):
    cols = ("community", "fold_i", "week_idx", F.round("prob", 9), "n_train", "n_crisis_train", "actual")
    assert rows(learn.walk_forward(scored, COLS, folds_per_task=5), *cols) == rows(learn.walk_forward(scored, COLS, folds_per_task=1000), *cols)


def test_no_future_in_training(spark, scored):
    """Changing the last weeks must not change earlier folds."""
    cut = W[70]
    late = scored.withColumn("f1", F.when(F.col("week_start") > F.lit(cut), F.lit(99.0)).otherwise(F.col("f1")))
    pick = lambda df: rows(learn.walk_forward(df, COLS).where("week_idx <= 68"), "community", "week_idx", F.round("prob", 9))
    assert pick(scored) == pick(late)


def test_walk_forward_sequence(scored):
    w = learn.walk_forward(scored, COLS, sequence_length=4)
    r = w.where("not skipped").collect()
    assert len(r) > 50 and all(0 <= x["pred"] <= 3 and 0 <= x["prob"] <= 1 for x in r)
    assert {x["actual"] for x in r} <= {0, 1, 2, 3, None}


def test_final_models_and_holdout(scored):
    m = learn.final_models(scored, COLS)
    h = learn.holdout_predictions(scored, COLS, m)
    assert rows(h.groupBy("community").count()) == [("a", 11), ("b", 11)]
    seq = learn.final_models(scored, COLS, sequence_length=4, method="isotonic")
    p = learn.predict(scored, COLS, seq, 4)
    r = p.first()
    assert len(r["probs"]) == 4 and all(0 <= v <= 1 for v in r["probs"]) and p.count() == 2 * 97


def test_jvm_scoring_equals_numpy(scored):
    m = {r["community"]: r for r in learn.final_models(scored, COLS).collect()}
    got = {(r["community"], r["week_idx"]): r["prob"] for r in learn.predict(scored, COLS, learn.final_models(scored, COLS)).collect()}
    pdf = scored.orderBy("community", "week_start").toPandas()
    for c, g in pdf.groupby("community"):
        z = g[COLS].to_numpy() @ np.array(m[c]["model"]["coef"]) + m[c]["model"]["intercept"]
        want = fits.calibrate(1 / (1 + np.exp(-z)), m[c]["calibrator"].asDict())
        assert np.allclose([got[(c, i)] for i in range(100)], want)


def test_transfer_ablation_importance(scored):
    t = learn.transfer(scored, COLS, ["a", "b"]).collect()
    assert {(r["source"], r["target"]) for r in t} == {("a", "b"), ("b", "a")} and all(r["pr_auc"] > 0.4 for r in t)
    ab = {(r["community"], r["family"]): r for r in learn.ablation(scored, COLS, {"lead": ["f1"], "noise": ["f3"]}).collect()}
    assert ab[("a", "lead")]["pr_auc_drop"] > ab[("a", "noise")]["pr_auc_drop"] and ab[("a", "lead")]["n_features_removed"] == 1
    rws = learn.labeled_rows(scored, COLS)
    models = learn.fit_variants(rws, None, 3)
    perm = {(r["community"], r["feature"]): r["importance"] for r in learn.permutation_importance(rws, models, COLS).collect()}
    assert perm[("a", "f1")] > perm[("a", "f3")]
    att = {(r["community"], r["feature"]): r["importance"] for r in learn.linear_attribution(rws, models, COLS).collect()}
    assert att[("b", "f1")] > att[("b", "f3")] >= 0


def test_trees(scored):
    rws = learn.labeled_rows(scored, COLS)
    best, trials = learn.tune_gbt(rws, [{"depth": 2, "trees": 5}, {"depth": 3, "trees": 8}])
    assert len(trials) == 2 and best["score"] == max(t["score"] for t in trials)


def test_calibrators():
    few = fits.fit_calibrator(np.array([.1, .2, .3]), np.array([0., 1., 0.]))
    assert few["type"] == "identity"
    rng = np.random.default_rng(3)
    p = rng.uniform(size=120)
    y = (rng.uniform(size=120) < p).astype(float)
    for method in ("platt", "isotonic"):
        c = fits.fit_calibrator(p, y, method)
        out = fits.calibrate(p, c)
        assert c["type"] == method and ((out >= 0) & (out <= 1)).all()
        assert (np.diff(out[np.argsort(p)]) >= -1e-12).all()
    # Platt: gradient of the penalised loss vanishes.
    c = fits.fit_calibrator(p, y, "platt")
    q = fits.calibrate(p, c)
    assert abs((q - y).sum()) < 1e-5 and abs((p * (q - y)).sum() + c["coef"]) < 1e-5


def test_calibrator_expression_equals_numpy(spark):
    p = np.linspace(0, 1, 41)
    for c in (fits.fit_calibrator(p, (p > .4).astype(float), "isotonic"), {"type": "platt", "coef": 2.0, "intercept": -1.0, "x": [], "y": []},
              {"type": "identity", "coef": 1.0, "intercept": 0.0, "x": [], "y": []}):
        df = spark.createDataFrame([(float(v), c) for v in p], f"p double, cal {learn.CALIBRATOR}")
        got = [r[0] for r in df.select(metrics.apply_calibrator(F.col("p"), F.col("cal"))).collect()]
        assert np.allclose(got, fits.calibrate(p, c))


def test_batch_score(spark, scored):
    m = learn.final_models(scored, COLS)
    out = serve.score_batch(scored, m.select("community", "model"), COLS, stats.train_stats(scored, COLS), m.select("community", "calibrator"),
                            monitoring_only=["b"], max_sigma=2.0)
    r = out.collect()
    assert len(r) == 200 and all(x["predicted_state"] is None for x in r if x["community"] == "b" or x["violations"])
    assert any(x["violations"] for x in r) and all(x["prediction_available"] for x in r if x["community"] == "a" and not x["violations"])


def test_evaluate_job(scored):
    out = jobs.evaluate(scored, COLS, {"f2": 1.0}, sequence_length=3)
    m = {r["model"] for r in out["metrics"].collect()}
    assert m == {"tabular", "sequence", "ensemble"}
    assert out["lead_time"].count() == 6
    assert out["diagnostics"].count() == 2 and out["usefulness"].count() == 2 * 3 * 4


def test_pooled_trees_has_the_operator_defaults(spark, sf, monkeypatch):
    asked, fit = [], learn.fit_gbt
    monkeypatch.setattr(learn, "fit_gbt", lambda rows, **options: asked.append(options) or fit(rows, depth=1, trees=1))
    checks_learn.pooled_trees(spark, sf)
    assert asked == [{}]


def test_tabular_search_runs_by_default(scored, monkeypatch):
    """The penalty of a final model is the one with the best recall over the time splits, out of several."""
    assert len(learn.L2_GRID) > 1
    default, searched, single = (learn.final_models(scored, COLS, **o) for o in ({}, {"l2_grid": (1.0, 0.1, 10.0)}, {"l2_grid": (1.0,)}))
    coef = lambda m: rows(m, "community", "model.coef")
    assert coef(default) == coef(searched) != coef(single)


@pytest.fixture(scope="module")
def planted(spark):
    """Two communities whose next week's score is one of four steps, told by the two weeks before."""
    frames = []
    for c, seed in (("a", 5), ("b", 6)):
        rng = np.random.default_rng(seed)
        step = rng.integers(0, 4, 130)
        f1 = np.append(step[1:], 0) + 0.2 * rng.normal(size=130)
        frames.append(pd.DataFrame({"community": c, "week_start": W[:130], "distress_score": step - 1.5, "f1": f1, "f2": rng.normal(size=130)}))
    return spark.createDataFrame(pd.concat(frames)).cache()


@pytest.mark.parametrize("l2", [1.0, 1e-2, 1e-4])
@pytest.mark.parametrize("width", [1, 3, 12, 36])
def test_softmax_fit_is_a_minimum(l2, width):
    rng = np.random.default_rng(width)
    x, y = rng.normal(size=(80, width)) * rng.uniform(0.1, 50, width), rng.choice([0, 1, 3], 80)
    coef, b, converged = fits.fit_classes(x, y, l2=l2, tolerance=1e-6, rounds=50000)
    assert converged and np.isfinite(coef).all()
    low, span = x.min(axis=0), np.ptp(x, axis=0)
    s, n = (x - low) / span - 0.5, np.bincount(y, minlength=4)
    w = np.array([1 / n[k] if n[k] else 0 for k in range(4)])[y]
    w /= w.sum()

    def loss(a, c):
        z = s @ a.T + c
        z = z - z.max(axis=1, keepdims=True)
        return w @ (np.log(np.exp(z).sum(axis=1)) - z[np.arange(80), y]) + l2 / 2 * (a * a).sum()

    a, c = coef * span, b + coef @ (low + 0.5 * span)
    at = loss(a, c)
    for _ in range(30):
        da, dc = rng.normal(size=a.shape) * 0.02, rng.normal(size=4) * 0.02
        da[2], dc[2] = 0, 0  # the class never seen
        assert loss(a + da, c + dc) > at - 1e-7
    with pytest.raises(ArithmeticError):
        fits.fit_classes(np.array([[np.nan], [1.0]]), np.array([0, 1]))


def test_sequence_models_tell_planted_classes(planted):
    w = learn.walk_forward(planted, ["f1", "f2"], sequence_length=3, cuts=(-0.6, 0.0, 0.6)).where("not skipped AND actual IS NOT NULL").toPandas()
    assert w.converged.all() and w.prob.std() > 0.1
    recall = [(w.pred[w.actual == k] == k).mean() for k in range(4)]
    assert np.mean(recall) > 0.6


def test_search_by_halving_finds_the_best_of_the_grid(planted):
    """All candidates in one rung are the full grid; halving ends with its winner here."""
    o = dict(lengths=(2, 4), l2_grid=(1e-3, 3.0), cuts=(-0.6, 0.0, 0.6))
    full = learn.search_sequence(planted, ["f1", "f2"], rungs=1, **o).toPandas()
    some = learn.search_sequence(planted, ["f1", "f2"], rungs=3, **o).toPandas()
    assert len(full) == 8 and full.groupby("community").kept.sum().tolist() == [1, 1]
    assert some.groupby(["community", "rung"]).size().tolist() == [4, 2, 1] * 2
    last = some[(some.rung == 2) & some.kept].set_index("community").recall
    assert np.allclose(last, full.groupby("community").recall.max())
    assert some[some.rung == 0].n_fit.max() < some[some.rung == 2].n_fit.min()


def test_communities_with_too_little_have_no_model(spark, scored):
    few = scored.where("community = 'a'").limit(6).withColumn("community", F.lit("few")).withColumn("distress_score", F.lit(1.0))
    rws = learn.labeled_rows(few, COLS)
    assert learn.fit_variants(rws, None, 3).collect() == []
    flat = scored.where("community = 'a'").withColumn("distress_score", -F.abs("f3") * 0)
    assert learn.final_models(flat, COLS, cuts=(1e9, 2e9, 3e9)).count() <= 1 and learn.final_models(few, COLS, min_train=1, holdout=1).count() <= 1


def test_topics_are_inferred_once_per_post(spark):
    from tidewatch.operators import topics

    words = ["storm rain cloud wind", "bread flour oven yeast", "goal match team ball"]
    posts = spark.createDataFrame([(f"p{k}", "c", 1_600_000_000 + k, f"{words[k % 3]} {words[k % 3]} number{k % 5}") for k in range(60)], "post_id string, community string, t long, clean_text string")
    posts = posts.select("post_id", "community", F.timestamp_seconds("t").alias("ts"), "clean_text").coalesce(1)
    model = learn.fit_topics(posts, k=3, rounds=2)
    plan = topics.topic_counts(learn.assign_topics(posts, model))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Filter") + plan.count("Filter (") > 0 and not [x for x in plan.splitlines() if "Filter" in x and "UDF(" in x]
    counted = learn.word_counts(posts).select("post_id", "features").localCheckpoint()  # the counts alone give the same topics
    again = learn.fit_topics(counted, k=3, rounds=2)
    assert rows(learn.assign_topics(counted, again), "post_id", "topic_id") == rows(learn.assign_topics(posts, model), "post_id", "topic_id")
    assert learn.fit_topics(counted.limit(3)) is None
