import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewatch.functions import special
from tidewatch.operators import decide, folds, metrics, monitor, narrate, scoring, serve, stats, weekly

D = dt.date
W = [D(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(120)]


def panel(spark, **cols):
    n = len(next(iter(cols.values())))
    pdf = pd.DataFrame({"community": "a", "week_start": W[:n], **{k: np.asarray(v, dtype=float) for k, v in cols.items()}})
    return spark.createDataFrame(pdf)


def test_drift_against_pandas(spark):
    rng = np.random.default_rng(1)
    neg, hope = rng.normal(size=40), rng.normal(size=40)
    neg[20:23] += 6
    hope[25:28] -= 6
    df = panel(spark, avg_negative=neg, hopelessness_density=hope)
    got = monitor.drift(df).orderBy("week_start").toPandas()
    for name, v in (("avg_negative", neg), ("hopelessness_density", hope)):
        want = [0.0 if t < 2 else (v[t] - v[max(0, t - 12):t].mean()) / v[max(0, t - 12):t].std(ddof=1) for t in range(40)]
        assert np.allclose(got[f"z_{name}"], want)
    top = np.maximum(got["z_avg_negative"].abs(), got["z_hopelessness_density"].abs())
    assert list(got["aggregate_level"]) == [int(sum(z >= c for c in (1, 2, 3))) for z in top]
    changes = rows(monitor.level_changes(monitor.drift(df)), "change")
    assert ("escalation",) in changes and ("de-escalation",) in changes


def test_flat_baseline_gives_zero(spark):
    df = panel(spark, avg_negative=[0.1] * 12 + [5.0])
    r = monitor.drift(df).orderBy(F.desc("week_start")).first()
    assert r["z_avg_negative"] == 0 and r["alert_level_name"] == "normal" and r["dominant_signal"] == "avg_negative"


def test_drift_without_signals(spark):
    assert monitor.drift(panel(spark, other=[1, 2])).select("dominant_signal").distinct().first()[0] == "none"


def test_escalations_need_two_known_states(spark):
    df = spark.createDataFrame([("a", W[i], s, float(i), 1.0, 9.0) for i, s in enumerate((0, 2, None, 3, 1, 3))],
                               "community string, week_start date, state int, score double, avg_negative double, post_volume double")
    got = rows(monitor.escalations(df), "from_state", "to_state", "dominant_signal")
    assert got == [(0, 2, "post_volume"), (1, 3, "post_volume")]


def test_guardrail(spark):
    st = spark.createDataFrame([("a", "x", 0.04, 0.01)], "community string, feature string, mean double, std double")
    v = spark.createDataFrame([("a", W[0], "x", 0.99), ("a", W[1], "x", 0.04), ("a", W[2], "y", 7.0)], "community string, week_start date, feature string, value double")
    assert {r["week_start"]: r["violation"] for r in monitor.guardrail(v, st).collect()} == {W[0]: True, W[1]: False, W[2]: False}
    c = {r["week_start"]: r["value"] for r in monitor.guardrail(v, st, clip=True).collect()}
    assert c[W[0]] == pytest.approx(0.09) and c[W[1]] == 0.04
    w = monitor.drift_warnings(v, st).collect()
    assert [r["week_start"] for r in w] == [W[0]] and w[0]["warning"] == "x: value 0.9900 is 95.0 std from training mean (0.0400)"


def test_score_and_labels(spark):
    df = panel(spark, avg_negative=[1, 2, 3, 4], hopelessness_density=[5, 5, 5, 5])
    raw = scoring.composite_score(df, normalize=False).orderBy("week_start").collect()
    assert [r["distress_score"] for r in raw] == pytest.approx([1.25, 1.5, 1.75, 2.0])
    z = [r["distress_score"] for r in scoring.composite_score(df).orderBy("week_start").collect()]
    assert z == pytest.approx(list(0.25 * (np.arange(4) - 1.5) / np.std([1, 2, 3, 4])))
    s = scoring.fit_states(panel(spark, distress_score=[0, 0, 0, 0, 5])).orderBy("week_start").collect()
    assert s[3]["label"] >= 1 and s[4]["label"] is None
    t = scoring.fit_thresholds(panel(spark, distress_score=[.1, .2, .3, .5, .8, .1, .2])).first()
    assert t["t1"] > t["mean"]


def test_two_ways_to_label_agree(spark):
    df = panel(spark, distress_score=np.random.default_rng(2).normal(size=50))
    cols = ("week_start", "state", "label", "is_crisis_week")
    assert rows(scoring.fit_states(df), *cols) == rows(scoring.states(df, scoring.fit_thresholds(df)), *cols)


@pytest.mark.parametrize("n,lo,gap", [(20, 5, 1), (20, 5, 2), (20, 10, 1), (6, 5, 1)])
def test_folds(spark, n, lo, gap):
    g = folds.fold_grid(panel(spark, x=range(n)), lo, gap).orderBy("fold_i").collect()
    assert len(g) == max(0, n - lo - gap)
    assert all(r["train_end"] == r["test_idx"] - gap and r["train_end"] >= lo for r in g)


def test_fold_statistics_match_slices(spark):
    v = np.random.default_rng(3).normal(size=40)
    df = panel(spark, distress_score=v)
    t = folds.fold_thresholds(df, folds.fold_grid(df, 10, 2), 2).orderBy("fold_i").collect()
    for r in t:
        train = v[: r["train_end"]]
        assert r["t1"] == pytest.approx(train.mean() + 0.5 * train.std(ddof=1))
    lab = {r["fold_i"]: r for r in folds.fold_labels(df, folds.fold_thresholds(df, folds.fold_grid(df, 10, 2), 2)).collect()}
    for r in t:
        nxt = v[1: r["train_end"]]
        assert lab[r["fold_i"]]["n_crisis_train"] == int((nxt >= r["t2"]).sum()) and lab[r["fold_i"]]["n_train"] == len(nxt)


def test_split_sizes(spark):
    df = spark.createDataFrame([(10,), (28,), (30,), (200,)], "n int")
    got = [tuple(r) for r in df.select("n", folds.dev_rows(F.col("n"), 12, 27), folds.calibration_rows(F.col("n"), 0.2, 20)).orderBy("n").collect()]
    assert got == [(10, 10, 9), (28, 28, 20), (30, 28, 20), (200, 188, 40)]


def preds(spark, pred=None, prob=None, actual=None, model="m", community="a"):
    n = len(next(v for v in (pred, prob, actual) if v is not None))
    get = lambda v, i: None if v is None else v[i]
    return spark.createDataFrame([(community, model, i, get(pred, i), None if get(prob, i) is None else float(prob[i]), get(actual, i)) for i in range(n)],
                                 "community string, model string, week_idx int, pred int, prob double, actual int")


def test_top_k(spark):
    p = preds(spark, [1] * 5, [.9, .1, .8, .2, .7], [1, 0, 1, 0, 1])
    k = {r["k"]: r for r in metrics.top_k_recall(p, (1, 3)).collect()}
    assert (k[1]["captured"], k[1]["recall"]) == (1, pytest.approx(1 / 3)) and (k[3]["captured"], k[3]["recall"]) == (3, 1.0)
    none = metrics.decision_usefulness(preds(spark, [0] * 5, [0.0] * 5, [0] * 5)).collect()
    assert all(r["recall"] == r["random_recall"] == r["persistence_recall"] == 0 for r in none)


def test_random_and_persistence(spark):
    p = preds(spark, [0] * 10, [0.0] * 10, [1, 1] + [0] * 8)
    r = metrics.decision_usefulness(p, (2,)).first()
    assert r["random_recall"] == pytest.approx(0.2) and r["total_positives"] == 2 and r["persistence_captured"] >= 1


def test_areas_with_ties(spark):
    y, p = [1, 0, 1, 0, 1, 0], [.9, .9, .5, .5, .5, .1]
    r = metrics.metric_pack(preds(spark, [int(v >= .5) for v in p], p, y)).first()
    assert r["pr_auc"] == pytest.approx(1 / 3 * 1 / 2 + 2 / 3 * 3 / 5)
    wins = sum((a > b) + 0.5 * (a == b) for a, ya in zip(p, y) if ya for b, yb in zip(p, y) if not yb)
    assert r["roc_auc"] == pytest.approx(wins / 9)
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 2, 0, 1)
    one_class = metrics.metric_pack(preds(spark, [0, 1], [.1, .9], [0, 0])).first()
    assert one_class["pr_auc"] == 0 and one_class["roc_auc"] is None


def test_lead_time(spark):
    p = preds(spark, [1, 2, 2, 1, 3], [0.5] * 5, [1, 1, 2, 1, 3])
    assert rows(metrics.lead_times(p, 2), "week_idx", "lead") == [(2, 1), (4, 0)]
    r = metrics.lead_time_summary(p, 2).first()
    assert (r["n_onsets"], r["mean"], r["p50"], r["p75"]) == (2, 0.5, 0.5, 0.75)
    assert metrics.lead_time_summary(preds(spark, [1], [0.5], [0])).first()["n_onsets"] == 0


def test_calibration_keeps_null(spark):
    df = spark.createDataFrame([(None, {"type": t, "coef": 1.0, "intercept": 0.0, "x": [0.1, 0.5], "y": [0.0, 1.0]}) for t in ("identity", "platt", "isotonic")],
                               "p double, cal struct<type:string,coef:double,intercept:double,x:array<double>,y:array<double>>")
    assert rows(df.select(metrics.apply_calibrator(F.col("p"), F.col("cal")))) == [(None,)] * 3


def test_reliability_edges(spark):
    p = preds(spark, [0] * 4, [0.0, 0.3, 0.999, 1.0], [0, 0, 1, 1])
    assert rows(metrics.reliability(p), "bin", "n") == [(0, 1), (3, 1), (9, 2)]
    assert metrics.calibration_verdict(p).first()["verdict"] == "insufficient_data"


def test_merge_rules(spark):
    a = preds(spark, [1, 3, None], [.2, .4, None], [1, None, None])
    b = preds(spark, [3, None, None], [.8, .6, .5], [2, 1, None])
    got = rows(metrics.merge_models(a, b), "week_idx", "pred", F.round("prob", 3), "actual")
    assert got == [(0, 3, .5, 1), (1, 3, .5, 1), (2, None, .5, None)]
    m = spark.createDataFrame([("a", "x", .4), ("a", "y", .6)], "community string, model string, recall double")
    assert metrics.average_metrics(m, ("recall",)).first()["recall"] == pytest.approx(.5)


def test_scored_ensemble(spark):
    seq = preds(spark, [0] * 7, [.2, .4, .6, .8, .1, .9, None], [0, 1, 2, 3, 0, None, None])
    tab = preds(spark, [0] * 7, [.4, .4, .2, .6, .1, .3, .5], [0, 0, 1, 1, 0, 1, None])
    e = metrics.ensemble(seq, tab, 0.5).orderBy("week_idx").collect()
    assert [r["pred"] for r in e] == [0, 0, 0, 2, 0, 2, 2]
    assert [r["actual"] for r in e] == [0, 1, 2, 3, 0, 2, None]
    assert metrics.ensemble(seq.limit(3), tab.limit(3)).count() == 0


def test_array_results_pad_and_trim(spark):
    df = spark.createDataFrame([("a", [1.0, float("nan")], [0.5, 0.6], [1.0, 0.0])], "community string, predictions array<double>, probabilities array<double>, actuals array<double>")
    size = lambda n: spark.createDataFrame([("a", n)], "community string, n_weeks int")
    assert rows(metrics.explode_arrays(df, size(3)), "week_idx", "pred", "prob") == [(0, 1.0, 0.5), (1, None, 0.6), (2, None, None)]
    assert metrics.explode_arrays(df, size(1)).count() == 1
    assert metrics.explode_arrays(df).count() == 2


def test_profiles_against_pandas(spark):
    v = np.random.default_rng(5).gamma(2, size=30)
    r = stats.feature_profile(panel(spark, x=v), ["x"]).first()
    s = pd.Series(v)
    for k, want in (("mean", s.mean()), ("std", s.std()), ("skew", s.skew()), ("q1", s.quantile(.25)), ("median", s.median()), ("q3", s.quantile(.75))):
        assert r[k] == pytest.approx(want)


def test_outliers_and_trend(spark):
    df = panel(spark, x=[1, 2, 3, 2, 1, 2, 3, 50], flat=[1] * 8)
    assert rows(stats.iqr_outliers(df, ["x", "flat"]), "feature", "value", "direction") == [("x", 50.0, "high")]
    t = stats.trend(panel(spark, distress_score=[1, 2, 3, 4, 5])).first()
    assert t["slope"] == pytest.approx(1) and t["direction"] == "rising" and t["sigma_change"] == pytest.approx(4 / np.std([1, 2, 3, 4, 5]))
    assert stats.trend(panel(spark, distress_score=[1, 2, 3])).first()["direction"] == "insufficient_data"


def test_spearman_against_pandas(spark):
    rng = np.random.default_rng(6)
    x, y = np.round(rng.normal(size=40), 1), rng.integers(0, 4, 40)
    df = panel(spark, x=x, label=y)
    r = stats.with_p_value(stats.spearman_label(df, ["x"])).first()
    want = pd.Series(x).rank().corr(pd.Series((y >= 2).astype(float)).rank())
    assert r["spearman_rho"] == pytest.approx(want) and 0 < r["p_value"] < 1


def test_collinear(spark):
    x = np.random.default_rng(7).normal(size=30)
    got = stats.collinear_pairs(panel(spark, x=x, y=np.exp(x), z=np.random.default_rng(8).normal(size=30)), ["x", "y", "z"]).collect()
    assert [(r["feature_a"], r["feature_b"], r["spearman_rho"]) for r in got] == [("x", "y", pytest.approx(1.0))]


def test_collinear_beside_an_absent_feature(spark):
    x = np.random.default_rng(7).normal(size=30)
    df = panel(spark, x=x, y=np.exp(x), z=np.random.default_rng(8).normal(size=30)).withColumn("gone", F.lit(None).cast("double"))
    df = df.unionByName(df.withColumn("community", F.lit("other")).withColumn("gone", F.col("z")))
    got = stats.collinear_pairs(df, ["x", "y", "gone", "z"]).collect()
    assert sorted((r["community"] == "other", r["feature_a"], r["feature_b"]) for r in got) == [(False, "x", "y"), (True, "gone", "z"), (True, "x", "y")]


def test_tail_probabilities():
    assert special.f_tail(6.3342, 1, 360) == pytest.approx(0.0123, abs=5e-5)
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07339, abs=1e-5)
    assert special.f_tail(0.0, 2, 10) == 1.0


def test_granger_against_least_squares(spark):
    rng = np.random.default_rng(9)
    n = 80
    x, y = rng.normal(size=n), np.zeros(n)
    for t in range(2, n):
        y[t] = 0.3 * y[t - 1] + 0.8 * x[t - 2] + 0.2 * rng.normal()
    rowsx = [("x", W[i], float(x[i])) for i in range(n)] + [("y", W[i], float(y[i])) for i in range(5, n)]
    df = spark.createDataFrame(rowsx, "community string, week_start date, distress_score double")
    g = {(r["source"], r["lag"]): r for r in stats.granger(df, ["x", "y"], 3).collect()}
    xs, ys = x[5:], y[5:]
    for k in (1, 2, 3):
        m = len(ys) - k
        own = np.column_stack([np.ones(m)] + [ys[k - i:k - i + m] for i in range(1, k + 1)])
        full = np.column_stack([own] + [xs[k - i:k - i + m] for i in range(1, k + 1)])
        ssr = lambda a: ((ys[k:] - a @ np.linalg.lstsq(a, ys[k:], rcond=None)[0]) ** 2).sum()
        f = ((ssr(own) - ssr(full)) / k) / (ssr(full) / (m - 2 * k - 1))
        assert g[("x", k)]["f_stat"] == pytest.approx(f)
    assert g[("x", 2)]["p_value"] < 1e-6 < g[("y", 2)]["p_value"]
    short = stats.granger(df.where(F.col("week_start") < W[10]), ["x", "y"], 3).collect()
    assert all(r["f_stat"] is None and r["reason"] == "series_too_short" for r in short)


def test_allocation_published_example(spark):
    latest = spark.createDataFrame([(c, p, 2, e) for c, p, e in (("a", .3, .6), ("b", .2, .7), ("c", .9, .9), ("d", .1, .6), ("e", .4, .65))],
                                   "community string, probability double, state int, effectiveness double")
    h = {r["community"]: r["hours"] for r in decide.allocate(latest).collect()}
    assert h == {"a": .5, "b": .5, "c": 8.0, "d": .5, "e": .5}
    tight = decide.allocate(latest, 1.0).agg(F.sum("hours")).first()[0]
    assert tight == pytest.approx(1.0)
    zero = decide.allocate(latest.withColumn("probability", F.lit(0.0))).agg(F.sum("hours")).first()[0]
    assert zero == pytest.approx(2.5)
    tie = decide.allocate(latest.withColumn("probability", F.lit(.5)).withColumn("effectiveness", F.lit(.5)))
    assert rows(tie.where("hours > 1"), "community") == [("a",)]
    assert decide.allocate_pro_rata(latest).agg(F.sum("hours")).first()[0] == pytest.approx(10.0, abs=0.03)


def test_feature_selection(spark):
    imp = spark.createDataFrame([("f1", 1.0), ("f2", .3), ("f3", .05), ("f4", .9)], "feature string, importance double")
    known = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "feature string")
    assert rows(decide.select_features(imp, known, .2, 2, 10), "feature") == [("f1",), ("f2",)]
    assert rows(decide.select_features(imp, known, .9, 3, 10), "feature") == [("f1",), ("f2",), ("f3",)]
    assert rows(decide.select_features(imp, known, .01, 1, 1), "feature") == [("f1",)]


def test_scenarios_and_events(spark):
    df = panel(spark, hopelessness_density=[2.0], n_posts=[10.0])
    s = decide.apply_scenarios(df, [{"scenario": "s", "hopelessness": 50, "post_volume": -10}]).first()
    assert (s["hopelessness_density"], s["n_posts"]) == (3.0, 9.0)
    ev = spark.createDataFrame([("ok", "2024-01-03"), ("", "2024-01-03"), ("bad", "soon"), ("late", "2030-01-01")], "label string, date string")
    assert decide.valid_events(ev).count() == 2
    assert rows(decide.events_in_range(decide.valid_events(ev), panel(spark, x=range(3))), "label") == [("ok",)]


def test_replay_and_triage(spark):
    df = weekly.with_week_index(panel(spark, x=range(5))).withColumn("iso_year", F.lit(2024)).withColumn("iso_week", F.weekofyear("week_start")).where("week_idx <> 2")
    at = lambda w: decide.replay_rows(df, w).first()["week_idx"]
    assert [at("2024-01-17"), at("2024-01-23"), at("2020-01-01"), at("2030-01-01")] == [1, 3, 0, 4]
    s = spark.createDataFrame([("a", 1, .9), ("b", 3, .1), ("c", None, None), ("d", 3, .5)], "community string, state int, prob double")
    assert [r["community"] for r in decide.triage(s).collect()] == ["d", "b", "a", "c"]


def test_model_choice(spark):
    p = preds(spark, [1], [.5], [1], "tabular").unionByName(preds(spark, [1], [.5], [1], "sequence")).unionByName(preds(spark, [1], [.5], [1], "tabular", "b"))
    assert rows(decide.choose_model(p)) == [("a", "ensemble"), ("b", "tabular")]
    assert rows(decide.choose_model(p, "sequence")) == [("a", "sequence"), ("b", "tabular")]


def test_briefs(spark):
    df = weekly.with_week_index(panel(spark, a=[10, 10, 30], b=[5, 5, 5], distress_score=[0, 1, 3])).withColumn("iso_year", F.lit(2025)).withColumn("iso_week", F.weekofyear("week_start"))
    moves = [r for r in narrate.feature_moves(df, ["a", "b"], 2).orderBy("week_start", "rank").collect()][-2:]
    assert [(r["feature"], r["direction"], r["delta_pct"]) for r in moves] == [("a", "up", 200.0), ("b", "flat", 0.0)]
    ctx = narrate.brief_context(df, preds(spark, [0, 2, None], [.1, .5, None], [0, 0, 0]), ["a", "b"]).orderBy("week_idx").collect()
    assert [(r["week"], r["predicted_state"], r["previous_state"]) for r in ctx] == [("2025-W01", "Stable", "n/a"), ("2025-W02", "Elevated Distress", "Stable")]
    book = spark.createDataFrame([("# P\n\n## Elevated Distress\n\n- Pin a thread.\n- More.\n\n## Stable\nno bullet\n",)], "value string")
    acts = narrate.playbook_actions(book)
    assert rows(acts, "heading", "action") == [("Elevated Distress", "Pin a thread.")]
    b = {r["week"]: r["brief"] for r in narrate.template_brief(narrate.brief_context(df, preds(spark, [0, 2, None], [.1, .5, None], [0, 0, 0]), ["a", "b"]), acts).collect()}
    assert b["2025-W02"].endswith("Recommended action: Pin a thread.") and "+1.0000" in b["2025-W02"]
    assert b["2025-W01"].endswith("Review the moderation playbook for this signal level.")


def test_log_summary(spark):
    log = spark.createDataFrame([("depression", .7, None, True), ("depression", .9, .2, False), ("anxiety", .6, 0.0, False)],
                                "community string, tabular_prob double, ensemble_prob double, has_drift boolean")
    s = {r["community"]: r for r in serve.log_summary(log).collect()}
    assert (s["TOTAL"]["n_predictions"], s["depression"]["n_predictions"], s["anxiety"]["n_predictions"]) == (3, 2, 1)
    assert s["TOTAL"]["elevated_rate"] == 0.6667 and s["TOTAL"]["drift_rate"] == 0.3333


def test_requests(spark):
    r = spark.createDataFrame([(1, "a", "2024-01-01", {"x": 1.0}), (2, "z", "2024-01-01", {"x": 1.0}), (3, "a", "never", {"x": 1.0}),
                               (4, "a", "2024-01-01", {"x": float("nan")}), (5, "a", "2024-01-01", {"y": 1.0})],
                              "request_id int, community string, week_start string, features map<string,double>")
    got = rows(serve.check_requests(r, ["a"], ["x"]), "request_id", "skip_reason")
    assert got == [(1, None), (2, "unknown_community"), (3, "bad_date"), (4, "non_finite_feature"), (5, "missing_features")]


def test_collinear_pairs_need_eight_weeks(spark):
    x = np.arange(7.0)
    assert stats.collinear_pairs(panel(spark, x=x, y=x * 2), ["x", "y"]).collect() == []
    assert len(stats.collinear_pairs(panel(spark, x=x, y=x * 2), ["x", "y"], min_weeks=7).collect()) == 1
