"""Weeks with their authors on a stream: who is new, who posted, and when a week is done.

The state of a community is split by a hash of the author, so a community with a third of all posts is many groups.
Posts are combined by author and week in the task that reads them, before any shuffle, so an author with a third of
all posts sends a few rows per task.  What a group keeps lives in the RocksDB store of the executor: one small record for
every author ever seen (first week, and the open weeks with a post) and one counter row for every open week.  A timer per
week fires when the watermark has passed its end; all parts of a week fire in the same micro-batch.

A null author counts as one author, as in the batch panel; a post without community, or without time, is in no week and
is left out.  Columns ``score`` and ``num_comments`` may be absent, as in the batch panel.  Posts that come later than the
watermark allows may be left out; all others are in their week, in whatever order they come.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions import dates
from tidewatch.operators.weekly import BY_WEEK

SHARDS = 64
EPOCH, DAY_MS = dt.date(1970, 1, 1), 86_400_000
COUNTERS = "post_count long, score_sum double, score_n long, total_comments double, hour_counts array<long>, unique_authors long, new_authors long"
COMBINED = "community string, shard int, author string, week int, ts timestamp, post_count long, score_sum double, score_n long, total_comments double, hour_counts array<long>"
PART = "community string, week_start date, " + COUNTERS


def _author(c: Column) -> Column:
    """Author as a map key, which can't be null."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def _shard(author: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(author), F.lit(shards)).cast("int")


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if rows.empty:
            continue
        by = rows.groupby(["community", "shard", "author", "week"], sort=False)
        out = by.agg(ts=("ts", "max"), post_count=("ts", "size"), score_sum=("score", "sum"), score_n=("score", "count"), total_comments=("num_comments", "sum"))
        hours = np.zeros((len(out), 24), dtype=np.int64)
        np.add.at(hours, (by.ngroup().to_numpy(), rows["hour"].to_numpy()), 1)
        out["hour_counts"] = list(hours)
        yield out.reset_index()


class AuthorWeeks(StatefulProcessor):
    """Counters of one (community, shard): ``authors`` has (first week, open weeks), ``weeks`` the counters of a week."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.authors = handle.getMapState("authors", "author string", "first int, open array<int>")
        self.weeks = handle.getMapState("weeks", "week int", COUNTERS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        unclosed = {k[0] for k in self.weeks.keys()}  # the watermark of this batch may have passed weeks that close at its end
        counts: dict[int, list] = {}
        posted: dict[str, set] = {}
        for part in rows:
            for r in part.itertuples(index=False):
                c = counts.setdefault(int(r.week), [0, 0.0, 0, 0.0, np.zeros(24, dtype=np.int64), 0, 0])
                c[0] += int(r.post_count)
                c[1] += float(r.score_sum)
                c[2] += int(r.score_n)
                c[3] += float(r.total_comments)
                c[4] += np.asarray(r.hour_counts)
                posted.setdefault(r.author, set()).add(int(r.week))
        for author, weeks in posted.items():
            known = self.authors.getValue((author,))
            first, still = (known[0], unclosed.intersection(known[1])) if known else (None, set())
            for w in weeks - still:
                counts[w][5] += 1
            earliest = min(weeks) if first is None else min(first, min(weeks))
            if earliest != first:
                counts[earliest][6] += 1
                if first in still:  # its first week so far was a later one, and that is open yet
                    counts.setdefault(first, [0, 0.0, 0, 0.0, np.zeros(24, dtype=np.int64), 0, 0])[6] -= 1
            if earliest != first or weeks - still:
                self.authors.updateValue((author,), (earliest, sorted(still | weeks)))
        for w, c in counts.items():
            old = self.weeks.getValue((w,))
            if old:
                c = [c[0] + old[0], c[1] + old[1], c[2] + old[2], c[3] + old[3], c[4] + np.asarray(old[4]), c[5] + old[5], c[6] + old[6]]
            else:
                self.handle.registerTimer((w + 7) * DAY_MS)
            self.weeks.updateValue((w,), (*c[:4], [int(v) for v in c[4]], *c[5:]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        week = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 7
        c = self.weeks.getValue((week,))
        if c:
            self.weeks.removeKey((week,))
            yield pd.DataFrame([(key[0], EPOCH + dt.timedelta(days=week), *c[:4], list(c[4]), *c[5:])], columns=_names(PART))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            self.authors.updateValue((r.author,), (int(r.first), []))

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _day(week: Column) -> Column:
    return F.datediff(week, F.lit(EPOCH))


def author_weeks(posts: DataFrame, delay: str = "7 days", shards: int = SHARDS, known: DataFrame | None = None) -> DataFrame:
    """Parts of weeks, each out once the watermark has passed its week; ``whole_weeks`` adds them up.

    ``posts`` is a stream with community, ts and author_hash.  ``known`` (community, author_hash, first_week) says who
    was there before the stream begins: a batch history (``first_weeks``) or the state of an older run (``stored_authors``), which may
    have had another number of shards.
    """
    author, week = _author(F.col("author_hash")), dates.week_start(F.col("ts"))
    number = lambda c: F.col(c).cast("double") if c in posts.columns else F.lit(0.0)
    narrow = posts.where(F.col("community").isNotNull() & F.col("ts").isNotNull()).select(
        "community", _shard(author, shards).alias("shard"), author.alias("author"), _day(week).alias("week"), "ts", F.hour("ts").alias("hour"),
        number("score").alias("score"), number("num_comments").alias("num_comments"))
    rows = narrow.mapInPandas(_combine, COMBINED).withWatermark("ts", delay)
    start = None
    if known is not None:
        a = _author(F.col("author_hash"))
        start = known.select("community", _shard(a, shards).alias("shard"), a.alias("author"), _day(F.col("first_week")).alias("first")).groupBy("community", "shard")
    return rows.groupBy("community", "shard").transformWithStateInPandas(AuthorWeeks(), PART, "append", "eventTime", start)


def whole_weeks(parts: DataFrame) -> DataFrame:
    """One row per community and week from its parts, in the columns of the batch panel."""
    sums = [F.sum(c).alias(c) for c in ("post_count", "score_sum", "score_n", "total_comments", "unique_authors", "new_authors")]
    hours = F.array(*[F.sum(F.col("hour_counts")[h]) for h in range(24)]).alias("hour_counts")
    return parts.groupBy(*BY_WEEK).agg(*sums, hours).select(
        *BY_WEEK, "post_count", F.coalesce(F.try_divide("score_sum", "score_n"), F.lit(0.0)).alias("avg_score"), "total_comments", "hour_counts",
        "unique_authors", "new_authors", (F.col("new_authors") / F.col("unique_authors")).alias("new_author_ratio"))


def week_sink(path: str):
    """foreachBatch writer of whole weeks: a folder per micro-batch, written over when the batch is run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        whole_weeks(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def read_weeks(spark: SparkSession, path: str) -> DataFrame:
    """The weeks that ``week_sink`` has written."""
    return spark.read.parquet(path).drop("batch")


def start(parts: DataFrame, checkpoint: str, path: str, once: bool = True, partitions: int | None = None):
    """Runs ``author_weeks`` into ``week_sink``; the query keeps its state in RocksDB whatever the session's store is.

    A micro-batch uploads its changes, not the whole state.  ``partitions`` of the state (by default the session's shuffle
    partitions) are settled by the first run of a checkpoint; each has a store of its own, some megabytes even when
    it is empty, so more of them than communities times shards are of no use.
    """
    store = "spark.sql.streaming.stateStore."
    wanted = {store + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              store + "rocksdb.changelogCheckpointing.enabled": "true"}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    conf = parts.sparkSession.conf
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        w = parts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(week_sink(path))
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def open_weeks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped run has counted of the weeks that its watermark has not let out, read from its state, not from the posts."""
    s = _state(spark, checkpoint, "weeks")
    week = F.date_add(F.lit(EPOCH), F.col("user_map_key.week")).alias("week_start")
    return whole_weeks(s.select(F.col("key.community").alias("community"), week, "user_map_value.*"))


def stored_authors(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every author that a stopped run knows, with the first week: ``known`` of a run that goes on elsewhere.

    The weeks that are still open there are not handed on; the next run has to begin at or after them, or read them again.
    """
    s = _state(spark, checkpoint, "authors")
    name = F.col("user_map_key.author")
    return s.select(
        F.col("key.community").alias("community"), F.when(name != "", F.expr("substring(user_map_key.author, 2)")).alias("author_hash"),
        F.date_add(F.lit(EPOCH), F.col("user_map_value.first")).alias("first_week"))


def first_weeks(posts: DataFrame) -> DataFrame:
    """The same from a batch table of posts: one row per community and author, combined before the shuffle."""
    return posts.where(F.col("community").isNotNull() & F.col("ts").isNotNull()).groupBy("community", F.col("author_hash").cast("string").alias("author_hash")).agg(
        F.min(dates.week_start(F.col("ts"))).alias("first_week"))
