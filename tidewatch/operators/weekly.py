"""Community-week aggregates, gap filling and collection quality.

Sizes: posts are large, the panel is not.  A panel has one row per community and
calendar week, so a community owns at most a few thousand rows however many posts it
has; windows by community are used on panels only, never on posts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import dates, mathx
from tidewatch.session import cut_lineage

BY_WEEK = ("community", "week_start")


def with_week(posts: DataFrame) -> DataFrame:
    return posts.withColumn("week_start", dates.week_start(F.col("ts")))


def hour_histogram(ts: Column) -> Column:
    """24 counters in one array, bounded whatever the number of posts."""
    return F.array(*[F.count_if(F.hour(ts) == h) for h in range(24)])


def author_weeks(posts: DataFrame) -> DataFrame:
    """Distinct authors and authors never seen before, per community-week.

    Reads three narrow columns.  The first aggregate reduces every author to one row
    per week, so even an author with a third of all posts is a few rows by the window.
    """
    seen = with_week(posts).select(*BY_WEEK, "author_hash").distinct()
    first = F.min("week_start").over(Window.partitionBy("community", "author_hash"))
    return (
        seen.withColumn("is_new", (first == F.col("week_start")).cast("int"))
        .groupBy(*BY_WEEK)
        .agg(F.count("*").alias("unique_authors"), F.sum("is_new").alias("new_authors"))
    )


def base_aggregates(columns: list[str]) -> list[Column]:
    score = F.coalesce(F.avg(F.col("score").cast("double")), F.lit(0.0)) if "score" in columns else F.lit(0.0)
    comments = F.coalesce(F.sum(F.col("num_comments").cast("double")), F.lit(0.0)) if "num_comments" in columns else F.lit(0.0)
    return [
        F.count("*").alias("post_count"),
        score.alias("avg_score"),
        comments.alias("total_comments"),
        hour_histogram(F.col("ts")).alias("hour_counts"),
    ]


def fill_gaps(weekly: DataFrame, zeros: Mapping[str, object]) -> DataFrame:
    """Missing weeks between a community's first and last week become rows of defaults.

    Every row emits itself and the empty weeks up to the next observed one: one window
    over the panel, no calendar table and no join.
    """
    upcoming = F.lead("week_start").over(Window.partitionBy("community").orderBy("week_start"))
    stop = F.coalesce(F.date_sub(upcoming, 7), F.col("week_start"))
    spread = weekly.withColumn("_stop", stop).withColumn(
        "_week", F.explode(F.sequence(F.col("week_start"), F.col("_stop"), F.expr("interval 7 days")))
    )
    observed = F.col("_week") == F.col("week_start")
    out = spread.select(
        "community",
        F.col("_week").alias("week_start"),
        *[
            F.when(observed, F.col(c)).otherwise(F.lit(v)).alias(c)
            if not isinstance(v, list)
            else F.when(observed, F.col(c)).otherwise(F.array(*[F.lit(x) for x in v])).alias(c)
            for c, v in zeros.items()
        ],
        (~observed).alias("is_missing_week"),
    )
    return out.select(
        "community",
        dates.iso_year(F.col("week_start")).alias("iso_year"),
        dates.iso_week(F.col("week_start")).alias("iso_week"),
        "week_start",
        *zeros.keys(),
        "is_missing_week",
    )


WEEKLY_ZEROS = {
    "post_count": 0,
    "avg_score": 0.0,
    "total_comments": 0.0,
    "unique_authors": 0,
    "new_author_ratio": 0.0,
    "hour_counts": [0] * 24,
}


def weekly_metrics(posts: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Observed community-weeks: the base aggregates plus any extra aggregate columns.

    One pass over the wide rows whose shuffle carries one partial row per
    community-week and task, and one pass over (community, ts, author).
    """
    extra = dict(extra or {})
    base = with_week(posts).groupBy(*BY_WEEK).agg(
        *base_aggregates(posts.columns), *[c.alias(n) for n, c in extra.items()]
    )
    if "author_hash" in posts.columns:
        out = base.join(author_weeks(posts.where(F.col("author_hash").isNotNull())), list(BY_WEEK), "left")
    else:
        out = base.withColumn("unique_authors", F.lit(0)).withColumn("new_authors", F.lit(0))
    return out.select(
        *BY_WEEK,
        "post_count",
        "avg_score",
        "total_comments",
        F.coalesce("unique_authors", F.lit(0)).cast("long").alias("unique_authors"),
        mathx.ratio(F.col("new_authors"), F.col("unique_authors")).alias("new_author_ratio"),
        "hour_counts",
        *extra.keys(),
    )


def weekly_panel(posts: DataFrame, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Gap-filled weekly aggregate per community."""
    extra = dict(extra or {})
    zeros = {**WEEKLY_ZEROS, **{n: 0.0 for n in extra}}
    return fill_gaps(weekly_metrics(posts, extra), zeros)


def with_week_index(panel: DataFrame) -> DataFrame:
    """Position of a week inside its community, from 0."""
    w = Window.partitionBy("community").orderBy("week_start")
    return panel.withColumn("week_idx", F.row_number().over(w) - 1)


# --- collection quality ------------------------------------------------------


def weekly_counts(posts: DataFrame) -> DataFrame:
    return with_week(posts).groupBy(*BY_WEEK).agg(F.count("*").alias("post_count"))


def completeness(counts: DataFrame, rolling_window: int = 4, gap_below: float = 0.5) -> DataFrame:
    """Posts against the mean of the last observed weeks, the current one included."""
    w = Window.partitionBy("community").orderBy("week_start").rowsBetween(-(rolling_window - 1), 0)
    rolling = F.nullif(F.avg("post_count").over(w), F.lit(0.0))
    score = F.coalesce(F.col("post_count") / F.col("rolling_avg_post_count"), F.lit(0.0))
    return (
        counts.withColumn("rolling_avg_post_count", rolling)
        .withColumn("completeness_score", score)
        .withColumn("is_gap", F.col("completeness_score") < gap_below)
    )


def missing_weeks(counts: DataFrame, start: str, end: str) -> DataFrame:
    """Expected Mondays of the range that a community never posted in."""
    first = F.date_trunc("week", F.date_add(F.lit(start).cast("date"), 6)).cast("date")
    expected = counts.select("community").distinct().select(
        "community", F.explode(F.sequence(first, F.lit(end).cast("date"), F.expr("interval 7 days"))).alias("week_start")
    )
    return expected.join(counts, list(BY_WEEK), "left_anti")


def source_weeks(posts: DataFrame, source: str = "data_source") -> DataFrame:
    return with_week(posts).groupBy(*BY_WEEK, F.col(source).alias("source")).agg(F.count("*").alias("n"))


def cross_source(posts: DataFrame, source: str = "data_source", max_ratio: float = 2.0) -> DataFrame:
    """Weeks fed by more than one source, their counts and the flag for a large ratio."""
    per_week = source_weeks(posts, source).groupBy(*BY_WEEK).agg(
        F.count("*").alias("n_sources"),
        (F.max("n") / F.min("n")).alias("ratio"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"),
    )
    return per_week.where(F.col("n_sources") > 1).withColumn("discrepant", F.col("ratio") > max_ratio)


def cross_source_report(posts: DataFrame, source: str = "data_source", max_ratio: float = 2.0) -> DataFrame:
    """One row per community: sources, weeks, overlapping weeks, discrepancies."""
    return _source_report(source_weeks(posts, source), max_ratio)


def _source_report(by_source: DataFrame, max_ratio: float) -> DataFrame:
    per_week = by_source.groupBy(*BY_WEEK).agg(
        F.collect_set("source").alias("ws"), (F.max("n") / F.min("n")).alias("ratio"), F.count("*").alias("k")
    )
    return per_week.groupBy("community").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ws")))).alias("sources_present"),
        F.count("*").alias("total_weeks"),
        F.count_if(F.col("k") > 1).alias("weeks_with_multiple_sources"),
        F.count_if((F.col("k") > 1) & (F.col("ratio") > max_ratio)).alias("n_discrepancies"),
    )


def quality_report(posts: DataFrame, start: str, end: str, source: str = "data_source") -> DataFrame:
    """Weeks seen, gaps, missing weeks, mean completeness and source discrepancies.

    All parts come from one small table, posts per week and source, so the posts are read and shuffled once.
    """
    by_source = cut_lineage(source_weeks(posts, source))
    counts = by_source.groupBy(*BY_WEEK).agg(F.sum("n").alias("post_count"))
    seen = completeness(counts).groupBy("community").agg(
        F.count("*").alias("total_weeks_observed"),
        F.count_if("is_gap").alias("gap_weeks"),
        F.avg("completeness_score").alias("avg_completeness"),
    )
    absent = missing_weeks(counts, start, end).groupBy("community").agg(F.count("*").alias("missing_week_count"))
    cross = _source_report(by_source, 2.0).select("community", "n_discrepancies")
    return (
        seen.join(absent, "community", "left")
        .join(cross, "community", "left")
        .fillna(0, ["missing_week_count", "n_discrepancies"])
    )


def stage_summary(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Loaded, cleaned and dropped posts and weeks per community, with a TOTAL row."""
    loaded = raw.groupBy("community").agg(F.count("*").alias("loaded"))
    weeks = with_week(clean).groupBy(*BY_WEEK).agg(F.count("*").alias("n"))
    cleaned = weeks.groupBy("community").agg(F.sum("n").alias("cleaned"), F.count("*").alias("week_rows"))
    both = loaded.join(cleaned, "community", "left").fillna(0, ["cleaned", "week_rows"])
    return both.rollup("community").agg(
        F.sum("loaded").alias("loaded"),
        F.sum("cleaned").alias("cleaned"),
        F.sum("week_rows").alias("week_rows"),
    ).select(
        F.coalesce("community", F.lit("TOTAL")).alias("community"),
        "loaded",
        "cleaned",
        (F.col("loaded") - F.col("cleaned")).alias("dropped"),
        "week_rows",
        mathx.ratio(F.col("cleaned"), F.col("week_rows")).alias("avg_posts_per_week"),
    )
