"""The stream of weeks with authors beside the batch panel."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from tidewatch.operators import weekly
from tidewatch.streaming import authors

SHOWN = ("community", "week_start", "post_count", "avg_score", "total_comments", "hour_counts", "unique_authors", "new_authors")


def posts(spark, n):
    """A hot community and a hot author, null authors, weeks without a post."""
    i = F.col("id")
    author = F.when(i % 3 == 0, F.lit("hot")).when(i % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), ((i * i) % 47).cast("string")))
    return spark.range(n).select(
        F.when(i % 3 == 1, "b").otherwise("a").alias("community"), author.alias("author_hash"),
        F.timestamp_seconds(F.lit(1704067200) + i * 9000 + F.when(i > n // 2, 40 * 86400).otherwise(0)).alias("ts"),
        (i % 7).cast("double").alias("score"), (i % 5).alias("num_comments"))


def batch(p):
    base = weekly.with_week(p).groupBy("community", "week_start").agg(*weekly.base_aggregates(p.columns))
    return base.join(weekly.author_weeks(p), ["community", "week_start"])


def run(spark, p, folder, name="one", **kw):
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/in")
    q = authors.start(authors.author_weeks(s, **kw), f"{folder}/{name}-checkpoint", f"{folder}/{name}")
    q.awaitTermination()
    return authors.read_weeks(spark, f"{folder}/{name}"), authors.open_weeks(spark, f"{folder}/{name}-checkpoint")


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    p = posts(spark, 600).cache()
    cut = F.lit(dt.datetime(2024, 2, 5))
    p.where(F.col("ts") < cut).coalesce(1).write.parquet(f"{tmp_path}/in")
    done, waiting = run(spark, p, tmp_path, shards=4)
    first = done.count()
    assert first > 2 and waiting.count() >= 2
    later = F.lit(dt.datetime(2024, 3, 27))  # the middle of a week
    p.where((F.col("ts") >= cut) & (F.col("ts") < later)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    p.where(F.col("ts") >= later).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    done, waiting = run(spark, p, tmp_path, shards=4)  # the same checkpoint: goes on from its state
    assert done.count() > first and waiting.count() >= 2
    both = done.unionByName(waiting)
    assert rows(both, *SHOWN) == rows(batch(p), *SHOWN)
    assert both.where("new_author_ratio < 0 OR new_author_ratio > 1").isEmpty()


def test_initial_state(spark, tmp_path):
    p = posts(spark, 600).cache()
    cut = F.lit(dt.datetime(2024, 2, 5))  # a Monday
    old, new = p.where(F.col("ts") < cut), p.where(F.col("ts") >= cut)
    new.coalesce(1).write.parquet(f"{tmp_path}/in")
    expected = rows(batch(p).where(F.col("week_start") >= cut.cast("date")), *SHOWN)
    done, waiting = run(spark, p, tmp_path, "table", shards=4, known=authors.first_weeks(old))
    assert rows(done.unionByName(waiting), *SHOWN) == expected
    known = authors.stored_authors(spark, f"{tmp_path}/table-checkpoint")
    assert rows(known) == rows(authors.first_weeks(p))
    done, waiting = run(spark, p, tmp_path, "other", shards=7, known=known.where(F.col("first_week") < cut.cast("date")))
    assert rows(done.unionByName(waiting), *SHOWN) == expected


def test_order_within_the_watermark_and_late_posts(spark, tmp_path):
    """A first week that turns out earlier moves; a post beyond the watermark is left out; odd rows are in no week."""
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    schema = "community string, author_hash string, ts timestamp"
    batches = [[("a", "x", day(8)), ("a", "y", day(9)), (None, "x", day(9)), ("a", "z", None)], [("a", "x", day(3)), ("a", "x", day(8))], [("a", "y", day(30))],
               [("a", "q", day(2)), ("a", "x", day(31))]]
    out = None
    for b in batches:
        p = spark.createDataFrame(b, schema)
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = run(spark, p, tmp_path, delay="7 days", shards=2)
    got = rows(out[0].unionByName(out[1]), "week_start", "post_count", "unique_authors", "new_authors")
    assert got == [(dt.date(2024, 1, 1), 1, 1, 1), (dt.date(2024, 1, 29), 2, 2, 0), (dt.date(2024, 1, 8), 3, 2, 1)]


def test_empty_table(spark, tmp_path):
    p = posts(spark, 10).where("false")
    p.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    authors.start(authors.author_weeks(s), f"{tmp_path}/c", f"{tmp_path}/out").awaitTermination()
    assert authors.whole_weeks(spark.createDataFrame([], authors.PART)).count() == 0
