"""Weekly topic mix: dominant topic, entropy and shift against earlier weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions import mathx
from tidewatch.operators import weekly


def cap_per_week(posts: DataFrame, per_week: int = 200, seed: int = 42, key: str = "post_id") -> DataFrame:
    """Deterministic sample of at most ``per_week`` posts per community-week.

    A sampling operator.  A week keeps the posts with the smallest hash.  Spark turns
    the ``row_number <= n`` filter into a group limit on both sides of the shuffle, so
    a task forwards at most ``per_week`` rows of a huge week, texts included, and no
    second pass over the posts is needed.
    """
    week = Window.partitionBy("community", "week_start").orderBy("_h", key)
    ranked = weekly.with_week(posts).withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_r", F.row_number().over(week))
    return ranked.where(F.col("_r") <= per_week).select(*posts.columns)


def topic_counts(posts: DataFrame, topic: str = "topic_id") -> DataFrame:
    """Posts per community-week and topic, the outlier topic (-1) excluded."""
    return (
        weekly.with_week(posts).where(F.col(topic) >= 0)
        .groupBy("community", "week_start", F.col(topic).cast("int").alias("topic"))
        .agg(F.count("*").alias("n"))
    )


def topic_mix(counts: DataFrame) -> DataFrame:
    """One row per non-empty community-week: topic shares as a map (as many entries as topics)."""
    total = F.sum("n").over(Window.partitionBy("community", "week_start"))
    shares = counts.withColumn("share", F.col("n") / total)
    return shares.groupBy("community", "week_start").agg(
        F.map_from_entries(F.collect_list(F.struct("topic", "share"))).alias("mix"),
        F.max_by("topic", F.struct(F.col("n"), -F.col("topic"))).alias("dominant_topic"),
        F.sum(-F.col("share") * F.log2("share")).alias("topic_entropy"),
    )


def topic_features(counts: DataFrame) -> DataFrame:
    """Dominant topic, entropy (log2) and Jensen-Shannon shift vs 1 and 4 non-empty weeks back."""
    order = Window.partitionBy("community").orderBy("week_start")
    mixed = topic_mix(counts).withColumn("_p1", F.lag("mix", 1).over(order)).withColumn("_p4", F.lag("mix", 4).over(order))
    shift = lambda c: F.when(F.col(c).isNotNull(), mathx.jensen_shannon(F.col(c), F.col("mix"))).otherwise(F.lit(0.0))
    return mixed.select(
        "community", "week_start",
        F.col("dominant_topic").cast("int").alias("dominant_topic"),
        F.col("topic_entropy"),
        shift("_p1").alias("topic_shift_jsd"),
        shift("_p4").alias("topic_shift_jsd_4w"),
    )


def attach_topics(panel: DataFrame, features: DataFrame) -> DataFrame:
    """Topic columns on the panel; weeks without topics get zeros."""
    cols = ("dominant_topic", "topic_entropy", "topic_shift_jsd", "topic_shift_jsd_4w")
    return panel.join(features, ["community", "week_start"], "left").fillna(0, list(cols)).select(*panel.columns, *cols)


def no_topics(panel: DataFrame) -> DataFrame:
    """Layout without a topic model: three zero columns."""
    return panel.select(
        "*", F.lit(0).alias("dominant_topic"), F.lit(0.0).alias("topic_entropy"), F.lit(0.0).alias("topic_shift_jsd")
    )
