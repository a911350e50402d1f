"""Incremental twins of the batch operators on Structured Streaming.

State is bounded everywhere: weekly counters die at the watermark, de-duplication keeps
ids for the watermark only, and the per-community states hold at most twelve weeks of
signals or one state id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions import dates
from tidewatch.functions.mathx import FLAT_STD
from tidewatch.operators import weekly
from tidewatch.operators.monitor import Z_DIGITS
from tidewatch.schemas import LEVEL_CUTS, LEVEL_NAMES
from tidewatch.sources import ledger


def read_stream(spark, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """File source: its checkpoint is the record of ingested files, so a file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).option(
        "recursiveFileLookup", "true").parquet(path)


def unique_posts(posts: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row per post id within the watermark."""
    return posts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["post_id"])


def weekly_stream(posts: DataFrame, delay: str = "7 days", watermarked: bool = False) -> DataFrame:
    """Monday-aligned tumbling aggregate; a week is emitted once its watermark has passed."""
    p = posts if watermarked else posts.withWatermark("ts", delay)
    week = F.window("ts", "7 days", "7 days", "4 days")
    out = p.groupBy("community", week.alias("w")).agg(*weekly.base_aggregates(posts.columns))
    return out.select("community", F.col("w.start").cast("date").alias("week_start"), F.col("w.start").alias("week_ts"),
                      "post_count", "avg_score", "total_comments", "hour_counts")


def close_open_weeks(posts: DataFrame, closed: DataFrame) -> DataFrame:
    """At the end of a bounded run: the weeks that the watermark has not let out yet, in the layout of the stream's sink.

    ``posts`` is the batch reading of the stream's source.  Weeks before the last closed one of any community are not
    looked at, unless a community has none; late posts beyond the watermark stay out, as in the stream.
    """
    last = closed.groupBy("community").agg(F.max("week_start").alias("_last"))
    rows = weekly.with_week(posts).join(last, "community", "left").where(F.col("_last").isNull() | (F.col("week_start") > F.col("_last")))
    out = rows.groupBy("community", "week_start").agg(*weekly.base_aggregates(posts.columns))
    return out.select("community", "week_start", F.col("week_start").cast("timestamp").alias("week_ts"), "post_count", "avg_score", "total_comments", "hour_counts")


def _drift_step(signals: Sequence[str], baseline: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = [np.array(v) for v in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("week_start")
        out = []
        for r in rows.itertuples(index=False):
            now = np.array([float(getattr(r, s)) for s in signals])
            z = np.zeros(len(signals))
            if len(past) >= 2:
                hist = np.vstack(past)
                std = hist.std(axis=0, ddof=1)
                z = np.where(std > FLAT_STD, (now - hist.mean(axis=0)) / np.where(std > FLAT_STD, std, 1.0), 0.0)
            size = np.round(np.abs(z), Z_DIGITS)
            level = int(sum(size.max() >= c for c in LEVEL_CUTS))
            out.append((key[0], r.week_start, *z.tolist(), level, LEVEL_NAMES[level], signals[int(np.argmax(size))]))
            past = (past + [now])[-baseline:]
        state.update(([p.tolist() for p in past],))
        names = ["community", "week_start", *[f"z_{s}" for s in signals], "aggregate_level", "alert_level_name", "dominant_signal"]
        yield pd.DataFrame(out, columns=names)

    return run


def drift_stream(panel: DataFrame, signals: Sequence[str], baseline_weeks: int = 12) -> DataFrame:
    """Drift levels of panel rows that arrive in week order per community (closed weeks do)."""
    schema = "community string, week_start date, " + ", ".join(f"z_{s} double" for s in signals)
    schema += ", aggregate_level int, alert_level_name string, dominant_signal string"
    return panel.groupBy("community").applyInPandasWithState(
        _drift_step(list(signals), baseline_weeks), schema, "past array<array<double>>", "append", GroupStateTimeout.NoTimeout)


def _transition_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    out = []
    for r in pd.concat(list(batches)).sort_values("week_start").itertuples(index=False):
        now = None if pd.isna(r.state) else int(r.state)
        if last is not None and now is not None and now > last:
            out.append((key[0], r.week_start, last, now, float(r.score)))
        last = now
    state.update((last,))
    yield pd.DataFrame(out, columns=["community", "week_start", "from_state", "to_state", "distress_score"])


def transition_stream(states: DataFrame) -> DataFrame:
    """Escalations of a stream of weekly states (null = unknown week)."""
    return states.groupBy("community").applyInPandasWithState(
        _transition_step, "community string, week_start date, from_state int, to_state int, distress_score double",
        "last int", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, keys: Sequence[str], clock: str):
    """foreachBatch writer that keeps one row per key, latest clock; replays change nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        old = ledger.load_table(batch.sparkSession, path)
        ledger.rewrite(ledger.upsert(old, batch, keys, clock), path)

    return write


def panel_update_sink(panel_path: str, out_path: str, operator):
    """foreachBatch writer: merge closed weeks into the panel table, rerun a panel operator.

    The panel is a few hundred rows per community, so recomputing it is cheaper than
    keeping state, and it tolerates weeks that arrive out of order.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        old = ledger.load_table(batch.sparkSession, panel_path)
        ledger.rewrite(ledger.upsert(old, batch.withColumn("_at", F.current_timestamp()), ["community", "week_start"], "_at"), panel_path)
        ledger.rewrite(operator(ledger.load_table(batch.sparkSession, panel_path)), out_path)

    return write


def start(stream: DataFrame, checkpoint: str, path: str | None = None, each=None, once: bool = True):
    """Start a query with its checkpoint; ``once`` drains what is there and stops."""
    w = stream.writeStream.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.foreachBatch(each).start() if each else w.format("parquet").outputMode("append").start(path)


def with_iso(panel: DataFrame) -> DataFrame:
    return panel.withColumn("iso_year", dates.iso_year(F.col("week_start"))).withColumn("iso_week", dates.iso_week(F.col("week_start")))
