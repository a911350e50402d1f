import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from tidewatch.operators import monitor, weekly
from tidewatch.sources import ledger
from tidewatch.streaming import jobs


def drain(stream, folder, each=None):
    q = jobs.start(stream, f"{folder}/checkpoint", None if each else f"{folder}/out", each)
    q.awaitTermination()
    return f"{folder}/out"


def posts(spark, n, seed=0):
    return spark.range(n).select(
        F.col("id").cast("string").alias("post_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("community"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 36000).alias("ts"), (F.col("id") % 7).cast("double").alias("score"))


def test_weekly_stream_equals_batch(spark, tmp_path):
    p = posts(spark, 200)
    p.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    out = spark.read.parquet(drain(jobs.weekly_stream(s), tmp_path))
    batch = weekly.weekly_metrics(p)
    closed = batch.join(out.select("community", "week_start"), ["community", "week_start"], "left_semi")
    cols = ("community", "week_start", "post_count", "avg_score", "hour_counts")
    assert out.count() > 10 and rows(out, *cols) == rows(closed, *cols)
    newest = p.agg(F.max("ts")).first()[0].date()
    assert batch.where(F.col("week_start") <= F.lit(newest - dt.timedelta(days=15))).count() <= out.count()


def test_restart_reads_only_new_files(spark, tmp_path):
    p = posts(spark, 50)
    p.write.parquet(f"{tmp_path}/in")
    s = lambda: jobs.unique_posts(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in"), "3650 days")
    out = drain(s(), tmp_path)
    assert spark.read.parquet(out).count() == 50
    p.write.mode("append").parquet(f"{tmp_path}/in")  # the same posts again
    drain(s(), tmp_path)
    assert spark.read.parquet(out).count() == 50


def test_drift_state_survives_restart(spark, tmp_path):
    week0 = dt.date(2024, 1, 1)
    data = [(c, week0 + dt.timedelta(weeks=i), float((i * 7 + k) % 11)) for i in range(40) for k, c in enumerate("ab")]
    panel = spark.createDataFrame(data, "community string, week_start date, post_volume double")
    s = lambda: spark.readStream.schema(panel.schema).parquet(f"{tmp_path}/in")
    for lo, hi in ((0, 20), (20, 40)):
        panel.where((F.col("week_start") >= F.lit(week0 + dt.timedelta(weeks=lo))) & (F.col("week_start") < F.lit(week0 + dt.timedelta(weeks=hi)))).write.mode("append").parquet(f"{tmp_path}/in")
        out = drain(jobs.drift_stream(s(), ["post_volume"]), tmp_path)
    cols = ("community", "week_start", F.round("z_post_volume", 9), "aggregate_level", "dominant_signal")
    assert rows(spark.read.parquet(out), *cols) == rows(monitor.drift(panel, ["post_volume"]), *cols)


def test_transitions(spark, tmp_path):
    data = [("a", dt.date(2024, 1, 1) + dt.timedelta(weeks=i), s, float(i)) for i, s in enumerate((0, 2, None, 3, 1, 3))]
    states = spark.createDataFrame(data, "community string, week_start date, state int, score double")
    states.write.parquet(f"{tmp_path}/in")
    out = drain(jobs.transition_stream(spark.readStream.schema(states.schema).parquet(f"{tmp_path}/in")), tmp_path)
    assert rows(spark.read.parquet(out), "from_state", "to_state") == rows(monitor.escalations(states), "from_state", "to_state") == [(0, 2), (1, 3)]


def test_upsert_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, at int")
    write = jobs.upsert_sink(f"{tmp_path}/t", ["k"], "at")
    write(df, 0)
    write(df, 0)
    assert rows(ledger.load_table(spark, f"{tmp_path}/t")) == [("a", 2), ("b", 1)]
