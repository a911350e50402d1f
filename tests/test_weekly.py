import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewatch.functions import dates
from tidewatch.operators import clean, features, temporal, topics, weekly

D = dt.date


def posts(spark, data, schema="community string, ts string, author_hash string"):
    return spark.createDataFrame(data, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def test_new_authors(spark):
    p = posts(spark, [("a", f"2024-01-0{d} 00:00:00", x) for d, x in ((1, "a"), (1, "b"), (1, "c"), (8, "a"), (8, "b"), (9, "d"))])
    w = {r["week_start"]: r for r in weekly.weekly_panel(p).collect()}
    assert w[D(2024, 1, 1)]["new_author_ratio"] == 1.0
    assert w[D(2024, 1, 8)]["new_author_ratio"] == pytest.approx(1 / 3)
    assert w[D(2024, 1, 8)]["unique_authors"] == 3


def test_gap_week_is_a_zero_row(spark):
    p = posts(spark, [("a", "2024-01-01 05:00:00", "x"), ("a", "2024-01-15 07:00:00", "x"), ("b", "2024-02-01 00:00:00", "y")])
    w = weekly.weekly_panel(p)
    assert rows(w, "community", "week_start", "post_count", "is_missing_week") == [
        ("a", D(2024, 1, 1), 1, False), ("a", D(2024, 1, 15), 1, False), ("a", D(2024, 1, 8), 0, True), ("b", D(2024, 1, 29), 1, False)]
    assert w.where("is_missing_week").first()["hour_counts"] == [0] * 24


def test_mixed_clocks(spark):
    p = spark.createDataFrame([(1704067200, dt.datetime(2024, 1, 1)), (1704672000, None), (None, None)], "created_utc long, created_utc_dt timestamp")
    p = clean.resolve_clock(p.withColumn("community", F.lit("a")))
    assert weekly.weekly_panel(p).agg(F.count("*"), F.sum("post_count")).first()[:] == (2, 2)


def test_one_hot_author_and_week(spark):
    p = spark.range(3000).select(
        F.lit("a").alias("community"), (F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 3) * 7 * 86400)).alias("ts"),
        F.when(F.col("id") % 3 != 2, "anonymous").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("author_hash"))
    got = rows(weekly.author_weeks(p), "week_start", "unique_authors", "new_authors")
    assert got == [(D(2024, 1, 1), 1, 1), (D(2024, 1, 15), 1000, 1000), (D(2024, 1, 8), 1, 0)]


def test_completeness(spark):
    c = spark.createDataFrame([("a", D(2024, 1, 1), 100), ("a", D(2024, 1, 8), 110), ("a", D(2024, 1, 15), 20)], "community string, week_start date, post_count long")
    r = weekly.completeness(c).orderBy("week_start").collect()
    assert [x["is_gap"] for x in r] == [False, False, True]
    assert r[2]["completeness_score"] == pytest.approx(20 / (230 / 3))


def test_missing_weeks(spark):
    c = spark.createDataFrame([("a", D(2024, 1, 1)), ("a", D(2024, 1, 15))], "community string, week_start date")
    assert rows(weekly.missing_weeks(c, "2024-01-01", "2024-01-22")) == [("a", D(2024, 1, 22)), ("a", D(2024, 1, 8))]


def test_cross_source(spark):
    data = [("a", "2024-01-01 00:00:00", "s")] * 5 + [("a", "2024-01-02 00:00:00", "t")] * 2 + [("a", "2024-01-09 00:00:00", "s")]
    p = posts(spark, data, "community string, ts string, data_source string")
    r = weekly.cross_source(p).first()
    assert (r["ratio"], r["discrepant"], r["sources"]) == (2.5, True, {"s": 5, "t": 2})
    r = weekly.cross_source_report(p).first()
    assert (r["sources_present"], r["total_weeks"], r["weeks_with_multiple_sources"], r["n_discrepancies"]) == (["s", "t"], 2, 1, 1)


def test_clock_units(spark):
    df = spark.createDataFrame([("s", "1704067200"), ("ms", "1704067200000"), ("ns", "1704067200000000000"), ("d", "2024-01-01"), ("d", "x")], "k string, c string")
    got = rows(dates.to_unix_seconds(df, "c", by="k"), "k", "created_utc")
    assert got == [("d", 1704067200.0), ("d", None), ("ms", 1704067200.0), ("ns", 1704067200.0), ("s", 1704067200.0)]
    assert rows(dates.to_unix_seconds(df.where("k = 'ms'"), "c"), "created_utc") == [(1704067200.0,)]


def test_iso_week_edges(spark):
    df = spark.createDataFrame([(D(2024, 12, 30),), (D(2021, 1, 3),), (D(2020, 12, 31),)], "d date")
    got = df.select(dates.iso_year(F.col("d")), dates.iso_week(F.col("d")), dates.week_start(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(2025, 1, D(2024, 12, 30)), (2020, 53, D(2020, 12, 28)), (2020, 53, D(2020, 12, 28))]
    back = spark.createDataFrame([(2020, 53), (2025, 3)], "y int, w int").select(dates.iso_monday(F.col("y"), F.col("w")), dates.week_key(F.col("y"), F.col("w")))
    assert [tuple(r) for r in back.collect()] == [(D(2020, 12, 28), "2020-W53"), (D(2025, 1, 13), "2025-W03")]


def test_hour_entropy(spark):
    p = posts(spark, [("a", f"2024-01-01 {h:02d}:00:00", "x") for h in (1, 1, 5, 9)])
    e = weekly.weekly_panel(p).select(features.behavioral_columns()["posting_time_entropy"]).first()[0]
    assert e == pytest.approx(-(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25)))


def test_temporal(spark):
    p = spark.createDataFrame([("a", 2024, i, D(2024, 1, 1) + dt.timedelta(weeks=i - 1), float(v)) for i, v in enumerate((1, 3, 8), 1)], "community string, iso_year int, iso_week int, week_start date, x double")
    t = temporal.add_temporal(p).orderBy("week_start").collect()
    assert [r["x_delta"] for r in t] == [0.0, 2.0, 5.0]
    assert [r["x_roll2w"] for r in t] == [1.0, 2.0, 5.5]
    assert [r["x_roll4w"] for r in t] == [1.0, 2.0, 4.0]
    assert t[0]["week_sin"] == pytest.approx(math.sin(2 * math.pi / 52))


def test_topic_weeks(spark):
    def week(i, *ids):
        return [("a", f"{D(2024, 1, 1) + dt.timedelta(weeks=i)} 00:00:00", t) for t in ids]

    data = week(0, 0, 0, 1, 1) + week(1, -1) + week(2, 1, 1) + week(3, 2) + week(4, 0) + week(5, 0, 1)
    f = topics.topic_features(topics.topic_counts(posts(spark, data, "community string, ts string, topic_id int"))).orderBy("week_start").collect()
    assert [r["dominant_topic"] for r in f] == [0, 1, 2, 0, 0]
    assert f[0]["topic_entropy"] == pytest.approx(1.0) and f[0]["topic_shift_jsd"] == 0
    assert f[2]["topic_shift_jsd"] == pytest.approx(math.sqrt(math.log(2)))
    assert f[4]["topic_shift_jsd_4w"] == pytest.approx(0.0, abs=1e-9) and f[3]["topic_shift_jsd_4w"] == 0


def test_weekly_cap_is_stable_and_bounded(spark):
    p = spark.range(500).select(F.col("id").cast("string").alias("post_id"), F.lit("a").alias("community"), F.timestamp_seconds(F.lit(1704067200)).alias("ts"))
    a, b = (rows(topics.cap_per_week(p.repartition(n), 20), "post_id") for n in (1, 7))
    assert a == b and len(a) == 20


def test_dedupe_and_merge(spark):
    df = spark.createDataFrame([("1", 5, "b"), ("1", 3, "a"), ("2", 9, "c")], "post_id string, created_utc int, selftext string")
    assert rows(clean.keep_first(df, ["post_id"], [F.col("created_utc")])) == [("1", 3, "a"), ("2", 9, "c")]
    fill = spark.createDataFrame([("1", 1, "z"), ("3", 1, "d")], "post_id string, created_utc int, selftext string")
    assert rows(clean.merge_with_fill(df, fill)) == [("1", 3, "a"), ("2", 9, "c"), ("3", 1, "d")]


def test_source_compatibility(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", "2")], "data_source string, created_utc string")
    assert rows(clean.source_compatibility(df), "data_source", "compatible") == [("a", False), ("b", True)]


def test_keep_first_moves_only_repeated_rows(spark):
    """Rows of single keys reach no exchange, copies of a hot key are combined before theirs; both ways agree."""
    n = F.col("id")
    df = spark.range(0, 20000, 1, 4).select(
        F.when(n % 3 == 0, "hot").when(n % 1000 == 1, F.lit(None)).otherwise(n.cast("string")).alias("post_id"),
        (20000 - n).cast("int").alias("created_utc"), F.concat(F.lit("text "), n.cast("string")).alias("selftext"))
    want = df.groupBy("post_id").agg(F.min("created_utc").alias("t"))
    small, large = (clean.keep_first(df, ["post_id"], [F.col("created_utc")], most) for most in (1 << 20, 0))
    assert rows(small) == rows(large) and rows(small, "post_id", "created_utc") == rows(want)
    plan = small._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "LeftAnti" in plan and plan.count("partial_min_by") == 1
    single, repeated = plan.split("partial_min_by")[0], plan.split("partial_min_by")[1]
    assert "Exchange hashpartitioning" in single and "LeftSemi" in repeated and "Exchange hashpartitioning" not in repeated
    assert "LeftAnti" not in large._jdf.queryExecution().executedPlan().toString()
