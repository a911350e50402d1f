import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewatch.operators import boost, learn, metrics

COLS = ["f1", "f2"]


def brute(x, y, w, depth, rate, l2, min_weight, bins, trees):
    """Trees by trying every split of every node, and the margins of the rows."""
    n, margin, out = len(y), np.zeros(len(y)), []
    bin_of = np.array([[(v[None, :] < v[:, None]).sum(axis=1) * bins // n] for v in x.T])[:, 0].T
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = w * (p - y), w * p * (1 - p), np.ones(n, dtype=int)
        for level in range(depth):
            for k in range(2**level, 2 ** (level + 1)):
                at = np.flatnonzero(node == k)
                best = None
                for f in range(x.shape[1]):
                    for b in np.unique(bin_of[at, f]):
                        low, up = at[bin_of[at, f] < b], at[bin_of[at, f] >= b]
                        hl, hu = h[low].sum(), h[up].sum()
                        if round(hl, 9) < min_weight or round(hu, 9) < min_weight:
                            continue
                        worth = lambda i: g[i].sum() ** 2 / (h[i].sum() + l2)
                        gain = round(worth(low) + worth(up) - worth(at), 9)
                        if gain > 0 and (best is None or gain > best[0] + 1e-8):
                            best = (gain, f, x[up, f].min())
                if best:
                    out.append((t, k, best[1], round(best[2], 6), round(best[0], 6)))
                    node[at] = 2 * k + (x[at, best[1]] >= best[2])
        for k in np.unique(node):
            margin[node == k] -= rate * g[node == k].sum() / (h[node == k].sum() + l2)
    return out, margin


@pytest.fixture(scope="module")
def models(spark):
    """Two models with ties and another number of rows each, and rows that are scored only."""
    frames = []
    for name, n in (("a", 90), ("b", 41)):
        rng = np.random.default_rng(n)
        x = np.round(rng.normal(size=(n + 5, 3)), 1)
        y = (np.abs(x[:, 0]) + 0.3 * rng.normal(size=n + 5) > 0.8).astype(int)
        frames.append(pd.DataFrame({"m": name, "row": range(n + 5), "x": list(map(list, x)), "y": y, "w": np.where(y == 1, 1.5, 1.0), "fit": np.arange(n + 5) < n}))
    return pd.concat(frames), spark.createDataFrame(pd.concat(frames))


def test_trees_equal_brute_force(models):
    pdf, df = models
    state, trees = boost.boost(df, ["m"], trees=3, depth=3, bins=8)
    margins = {(r["m"], r["row"]): r["margin"] for r in state.collect()}
    probs = {(r["m"], r["row"]): r["prob"] for r in boost.score(df, trees, ["m"]).collect()}
    assert len(margins) == len(pdf) and all(abs(probs[k] - 1 / (1 + np.exp(-v))) < 1e-12 for k, v in margins.items())
    for name, g in pdf.groupby("m"):
        fit = g[g["fit"]]
        want, margin = brute(np.vstack(fit["x"]), fit["y"].to_numpy(), fit["w"].to_numpy(), 3, 0.3, 1.0, 1.0, 8, 3)
        got = trees.where((F.col("m") == name) & F.col("feature").isNotNull())
        assert rows(got, "tree", "node", "feature", F.round("threshold", 6), F.round("gain", 6)) == sorted(want, key=repr)
        assert np.allclose([margins[(name, i)] for i in fit["row"]], margin)


def test_models_without_a_split(spark):
    """One class only, constant inputs, no row of the fit, no rows at all."""
    schema = "m string, row int, x array<double>, y int, w double, fit boolean"
    data = [("one", i, [float(i)], 1, 1.0, True) for i in range(20)] + [("flat", i, [2.0], i % 2, 1.0, True) for i in range(20)] + [("none", 0, [1.0], None, None, False)]
    state, trees = boost.boost(spark.createDataFrame(data, schema), ["m"], trees=1)
    got = {m: v for m, v in rows(state.groupBy("m").agg(F.max("margin")))}
    # Halving the rows of one class gains nothing here: 5 x 5 / (2.5 + 1) twice is less than 10 x 10 / (5 + 1).
    assert got["none"] == 0 and got["flat"] == 0 and got["one"] > 0
    assert trees.where("feature IS NOT NULL").count() == 0
    state, trees = boost.boost(spark.createDataFrame([], schema), ["m"], trees=1)
    assert state.count() == 0 and trees.count() == 0


@pytest.fixture(scope="module")
def scored(spark):
    """The next score is high where f1 is far from zero on either side, which no line through f1 tells."""
    rng = np.random.default_rng(5)
    n = 90
    far = rng.random(n) < 0.35
    f1 = np.where(far, np.where(rng.random(n) < 0.5, -2.0, 2.0), 0.0) + 0.3 * rng.normal(size=n)
    score = np.append(0.0, far[:-1].astype(float)) + 0.05 * rng.normal(size=n)
    weeks = [dt.date(2020, 1, 6) + dt.timedelta(weeks=i) for i in range(n)]
    return spark.createDataFrame(pd.DataFrame({"community": "a", "week_start": weeks, "distress_score": score, "f1": f1, "f2": rng.normal(size=n)})).cache()


def test_walk_forward(scored):
    t = boost.walk_forward(scored, COLS, trees=6).cache()
    w = learn.walk_forward(scored, COLS).cache()
    same = ("community", "fold_i", "week_idx", "n_train", "n_crisis_train", "actual")
    assert rows(t, *same) == rows(w, *same) and len(rows(t)) == 78 - 27
    assert all(0 <= r["prob"] <= 1 and r["pred"] in (0, 1) for r in t.where("NOT skipped").collect())
    area = lambda df: metrics.metric_pack(df.where("NOT skipped").withColumn("model", F.lit("m"))).first()["roc_auc"]
    assert area(t) > area(w) + 0.2


def test_later_weeks_do_not_change_earlier_folds(scored):
    early = scored.where("week_start < date'2021-06-07'")
    late = scored.withColumn("f1", F.when(F.col("week_start") >= "2021-05-03", 99.0).otherwise(F.col("f1")))
    pick = lambda df: rows(boost.walk_forward(df, COLS, trees=1, holdout=0).where("week_idx < 60"), "fold_i", F.round("raw", 9))
    assert pick(early) == pick(late.where("week_start < date'2021-06-07'"))


def test_tasks_follow_the_rows(spark, models):
    """Few rows are not dealt over all partitions of a session: a tree is a dozen jobs."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        state, _ = boost.boost(models[1], ["m"], trees=1, depth=1, bins=8)
        assert len(state.inputFiles()) == 1 and state.count() == len(models[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
