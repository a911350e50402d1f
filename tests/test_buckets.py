"""Bucketed keyed tables: only touched buckets are written, replays and lost writers change nothing."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewatch.sources import buckets
from tidewatch.streaming import jobs


def files(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def numbered(spark, lo, hi, at, word="v"):
    return spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(at).cast("long").alias("at"), F.concat(F.lit(word), F.sha2(F.col("id").cast("string"), 256)).alias("v"))


def test_bytes_follow_the_batch(spark, tmp_path):
    t = f"{tmp_path}/t"
    assert buckets.load(spark, t) is None
    assert buckets.upsert(numbered(spark, 0, 20000, 1), t, ["k"], "at", buckets=32) == 1
    before = files(f"{t}/data")
    assert buckets.upsert(numbered(spark, 7, 8, 2, "new"), t, ["k"], "at") == 2
    after = files(f"{t}/data")
    written = {f: n for f, n in after.items() if f not in before}
    assert all(after[f] == n for f, n in before.items()) and len({os.path.dirname(f) for f in written}) == 1
    assert sum(written.values()) < sum(before.values()) / 16
    got = buckets.load(spark, t)
    assert got.count() == 20000 and got.where("k = 7").first()["v"].startswith("new") and got.where("v LIKE 'new%'").count() == 1


def test_latest_clock_nulls_ties_and_new_columns(spark, tmp_path):
    t, schema = f"{tmp_path}/t", "k string, j int, at int, v string"
    up = lambda data, s=schema: buckets.upsert(spark.createDataFrame(data, s), t, ["k", "j"], "at", buckets=4)
    up([("a", 1, 5, "old"), ("a", None, 1, "n"), (None, None, None, "null clock"), ("b", 1, 1, "b"), ("b", 1, 2, "b2")])
    up([("a", 1, 4, "older"), ("a", None, 1, "tie"), (None, None, 0, "clock"), ("c", 1, None, "c")])
    assert rows(buckets.load(spark, t)) == sorted([("a", 1, 5, "old"), ("a", None, 1, "tie"), (None, None, 0, "clock"), ("b", 1, 2, "b2"), ("c", 1, None, "c")], key=repr)
    up([("c", 1, 9, "c9", 1.5)], schema + ", extra double")
    assert rows(buckets.load(spark, t).where("k IN ('b', 'c')")) == [("b", 1, 2, "b2", None), ("c", 1, 9, "c9", 1.5)]
    wanted = spark.createDataFrame([("a", None), (None, None), ("zz", 1)], "k string, j int")
    assert rows(buckets.lookup(spark, t, wanted, ["k", "j"]), "v") == [("clock",), ("tie",)]
    up([("a", 1, 7, "typed")], "k string, j long, at long, v string")  # the key's hash stays that of an int
    assert buckets.load(spark, t).where("k = 'a' AND j = 1").count() == 1


def test_replays_and_empty_batches(spark, tmp_path):
    t, df = f"{tmp_path}/t", numbered(spark, 0, 50, 1)
    assert buckets.upsert(df, t, ["k"], "at", "s", 3, 4) == 1
    seen = files(t)
    assert buckets.upsert(df.withColumn("at", F.lit(9)), t, ["k"], "at", "s", 3) == 1 and buckets.upsert(df, t, ["k"], "at", "s", 2) == 1
    assert files(t) == seen
    assert buckets.upsert(df.where("false"), t, ["k"], "at", "s", 4) == 1
    assert buckets.upsert(df, t, ["k"], "at", "other", 0) == 2 and buckets.upsert(df, t, ["k"], "at", "s", 5) == 3
    assert buckets.load(spark, t).count() == 50


def test_lost_writer_leaves_the_last_commit(spark, tmp_path, monkeypatch):
    t = f"{tmp_path}/t"
    buckets.upsert(numbered(spark, 0, 50, 1), t, ["k"], "at", "s", 0, 4)
    want = rows(buckets.load(spark, t))
    lost = F.udf(lambda v: 1 // 0, "string")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        buckets.upsert(numbered(spark, 0, 50, 2).withColumn("v", lost("v")), t, ["k"], "at", "s", 1)
    assert rows(buckets.load(spark, t)) == want
    with monkeypatch.context() as m:  # lost between the rows and the log
        m.setattr(buckets, "json", SimpleNamespace(loads=json.loads, dumps=lambda _: 1 // 0))
        with pytest.raises(ZeroDivisionError):
            buckets.upsert(numbered(spark, 0, 50, 2, "w"), t, ["k"], "at", "s", 1)
    assert rows(buckets.load(spark, t)) == want
    assert buckets.upsert(numbered(spark, 0, 50, 2, "w"), t, ["k"], "at", "s", 1) == 2
    assert buckets.load(spark, t).where("v LIKE 'w%'").count() == 50


def test_stream_sink(spark, tmp_path):
    for i in range(3):
        numbered(spark, 0, 40 * (i + 1), i, f"b{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    jobs.start(s, f"{tmp_path}/c", each=buckets.sink(f"{tmp_path}/t", ["k"], "at", "s", 8)).awaitTermination()
    got = buckets.load(spark, f"{tmp_path}/t")
    assert got.count() == 120 and got.where("at = 2").count() == 120
