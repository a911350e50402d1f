"""Importance resampling: ratios and draw against brute force, held-out separation, edge rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import importance, queries


def test_against_brute_force(spark, sf):
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    grams, raw, target = importance.Hashed(importance.BUCKETS), Counter(), Counter()
    for i, t in texts.items():
        raw.update(grams(t).tolist())
        target.update(grams(t).tolist() if i in good else ())
    n, m, b = sum(raw.values()), sum(target.values()), importance.BUCKETS
    want = {i: sum(math.log((target[g] + 1) / (m + b)) - math.log((raw[g] + 1) / (n + b)) for g in grams(t).tolist()) for i, t in texts.items()}
    got = importance.resampled(docs, labels.where("quality = 1"), k=70).collect()
    assert all(abs(r.log_weight - want[r.doc_id]) < 1e-6 for r in got) and len(got) == len(texts)
    order = sorted(got, key=lambda r: -r.gumbel_key)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in order[:70]}


def test_draw_follows_the_weights(spark):
    df = spark.range(40000).select((F.col("id") % 2 * math.log(3) + importance.gumbel(F.col("id"), 1)).alias("key"), "id")
    edge = importance.kth_largest(df.select("key"), 100)
    top = df.where(F.col("key") >= edge)
    assert top.count() == 100 and 60 <= top.where("id % 2 = 1").count() <= 90


@pytest.mark.parametrize("k", [1, 3, 5, 9])
def test_kth_with_ties(spark, k):
    keys = [5.0, 5.0, 5.0, 1.0, -2.0, 7.5, 7.5, 0.0, 1e9]
    df = spark.createDataFrame([(x,) for x in keys], "key double")
    assert importance.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_separates_junk(spark):
    sf = "/root/testdata/sf0.1"
    labels = queries.table(spark, sf, "labels")
    got = importance.resampled(queries.table(spark, sf, "documents"), labels.where("quality = 1 AND doc_id % 2 = 0"), share=0.86)
    x = got.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept").toPandas()
    assert x.kept[x.quality == 1].mean() > 0.9 and x.kept[x.quality == 0].mean() < 0.25


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "good words here"), (4, "w " * 50000), (5, "junk")]
    df = spark.createDataFrame([(*r, False) for r in rows], "doc_id long, text string, is_target boolean")
    ids = spark.createDataFrame([(3,), (None,), (3,), (77,)], "doc_id long")
    for k in (0, 1, 4, 7, 50):
        got = importance.resampled(df, ids, k=k).collect()
        assert len(got) == 7 and sum(r.kept for r in got) == min(k, 7)
    assert all(np.isfinite(r.gumbel_key) for r in got) and [r.log_weight for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert importance.resampled(df, ids.limit(0), share=0.5).count() == 7
    assert importance.resampled(df.limit(0), ids, share=0.5).collect() == []
