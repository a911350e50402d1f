"""Queries that run a Structured Streaming job over a driver table to its end and read its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import monitor, weekly
from tidewatch.plans import bindings as b
from tidewatch.plans.checks_panel import DRIFT
from tidewatch.plans.registry import query, shown
from tidewatch.session import shared_folder
from tidewatch.sources import buckets, ledger
from tidewatch.streaming import authors, jobs


def work_folder(spark) -> str:
    """A new folder in the shared place of the cluster."""
    return f"{shared_folder(spark)}/tidewatch-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _posts(df):
    return df.select(
        F.col("event_id").cast("string").alias("post_id"), F.col("event_type").alias("community"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("score"))


def _run(spark, stream, each=None, out=None):
    folder = work_folder(spark)
    q = jobs.start(stream, f"{folder}/checkpoint", None if each else f"{folder}/out", each(folder) if each else None)
    q.awaitTermination()
    return f"{folder}/{out or 'out'}"


@query("weekly_stream", """WITH w AS (SELECT event_type AS community, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS post_count, round(avg(value), 6) AS avg_score FROM events GROUP BY ALL)
SELECT w.* FROM w""")
def weekly_stream(spark, sf):
    """The stream's closed weeks, and those that were still open when the run ended."""
    closed = spark.read.parquet(_run(spark, jobs.weekly_stream(_posts(_stream(spark, sf, "events")))))
    rest = jobs.close_open_weeks(_posts(b.table(spark, sf, "events")), closed)
    return shown(closed.unionByName(rest).select("community", "week_start", "post_count", "avg_score"))


@query("unique_post_stream", "SELECT event_type AS community, count(DISTINCT user_id) AS n FROM events WHERE user_id IS NOT NULL GROUP BY event_type")
def unique_post_stream(spark, sf):
    """De-duplication on (community, user) ids inside one long watermark."""
    e = _stream(spark, sf, "events").select(
        F.concat_ws("/", "event_type", "user_id").alias("post_id"), F.col("event_type").alias("community"), F.col("ts").cast("timestamp").alias("ts"))
    path = _run(spark, jobs.unique_posts(e, "60 days"))
    return spark.read.parquet(path).groupBy("community").agg(F.count("*").alias("n"))


@query("provenance_stream", "SELECT o_orderstatus AS source, max(o_orderdate) AS logged_at FROM orders GROUP BY 1")
def provenance_stream(spark, sf):
    o = _stream(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderdate").alias("logged_at"))
    path = _run(spark, o, lambda folder: jobs.upsert_sink(f"{folder}/table", ["source"], "logged_at"), "table")
    return ledger.load_table(spark, path).select("source", "logged_at")


def _panel_stream(spark, sf):
    """The order panel written once and replayed as a stream of closed weeks."""
    path = f"{work_folder(spark)}/panel"
    p = b.state_panel(spark, sf).select("community", "week_start", "state", F.col("distress_score").alias("score"), *b.SIGNALS)
    p.write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@query("drift_stream", "WITH " + DRIFT + " SELECT community, week_start, " + ", ".join(f"round(z_{c}, 5) + 0.0 AS z_{c}" for c in b.SIGNALS) + """,
 CAST(aggregate_level AS BIGINT) AS aggregate_level, ['normal', 'warning', 'alert', 'critical'][aggregate_level + 1] AS alert_level_name, dominant_signal FROM drift""")
def drift_stream(spark, sf):
    path = _run(spark, jobs.drift_stream(_panel_stream(spark, sf), b.SIGNALS))
    return shown(spark.read.parquet(path), 5)


@query("transition_stream", "WITH " + b.STATES + """, prior AS (SELECT *, lag(state) OVER (PARTITION BY community ORDER BY week_start) AS from_state FROM states)
SELECT community, week_start, CAST(from_state AS BIGINT) AS from_state, CAST(state AS BIGINT) AS to_state, round(distress_score, 6) AS distress_score FROM prior WHERE state > from_state""")
def transition_stream(spark, sf):
    path = _run(spark, jobs.transition_stream(_panel_stream(spark, sf)))
    return shown(spark.read.parquet(path))


@query("panel_drift_stream", "WITH " + DRIFT + " SELECT community, week_start, CAST(aggregate_level AS BIGINT) AS aggregate_level, dominant_signal FROM drift")
def panel_drift_stream(spark, sf):
    """The foreachBatch form: panel table kept up to date, drift recomputed from it."""
    panel = _panel_stream(spark, sf)
    path = _run(spark, panel, lambda folder: jobs.panel_update_sink(f"{folder}/panel", f"{folder}/drift", lambda p: monitor.drift(p, b.SIGNALS)), "drift")
    return shown(ledger.load_table(spark, path).select("community", "week_start", "aggregate_level", "dominant_signal"))


_AUTHOR_WEEKS = "WITH " + b.DOCUMENTS.split(",\ncleaned AS")[0] + """,
weeks AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week_start FROM posts),
first_seen AS (SELECT community, author_hash, min(week_start) AS week_start FROM weeks GROUP BY ALL),
newcomers AS (SELECT community, week_start, count(*) AS new_authors FROM first_seen GROUP BY ALL)
SELECT w.community, w.week_start, count(*) AS post_count, round(avg(score), 6) AS avg_score, CAST(sum(num_comments) AS DOUBLE) AS total_comments,
  count(DISTINCT author_hash) AS unique_authors, coalesce(any_value(new_authors), 0) AS new_authors,
  round(coalesce(any_value(new_authors), 0)::DOUBLE / count(DISTINCT author_hash), 6) AS new_author_ratio
FROM weeks w LEFT JOIN newcomers n USING (community, week_start)"""


def _author_weeks(spark, posts, known=None):
    """A drained run: the weeks it has closed and those that are open in its state."""
    folder = work_folder(spark)
    parts = authors.author_weeks(posts, known=known, shards=8)
    authors.start(parts, f"{folder}/checkpoint", f"{folder}/weeks", partitions=32).awaitTermination()  # four languages times eight shards
    done = authors.read_weeks(spark, f"{folder}/weeks").unionByName(authors.open_weeks(spark, f"{folder}/checkpoint"))
    return shown(done.drop("hour_counts"))


def _document_stream(spark, sf, files=1000):
    """The documents, a file or a folder of files: a stream takes a plain file only by a pattern."""
    schema = b.table(spark, sf, "documents").schema
    return b.posts_of_documents(spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(f"{sf}/documents.parque[t]"))


@query("author_weeks_stream", _AUTHOR_WEEKS + " GROUP BY w.community, w.week_start")
def author_weeks_stream(spark, sf):
    return _author_weeks(spark, _document_stream(spark, sf))


@query("author_weeks_resumed", _AUTHOR_WEEKS + " WHERE w.week_start >= DATE '2018-07-02' GROUP BY w.community, w.week_start")
def author_weeks_resumed(spark, sf):
    """The second half of the year as a stream, whose first state is who posted in the first half (a batch table)."""
    half = F.lit("2018-07-02").cast("timestamp")
    known = authors.first_weeks(b.document_posts(spark, sf).where(F.col("ts") < half))
    return _author_weeks(spark, _document_stream(spark, sf).where(F.col("ts") >= half), known)


_LATEST = "WITH " + b.DOCUMENTS.split(",\ncleaned AS")[0] + """ SELECT community, data_source, author_hash, arg_max(post_id, doc_id) AS post_id, max(doc_id) AS at,
 round(arg_max(score, doc_id), 6) AS score FROM posts GROUP BY ALL"""
_AUTHOR = ("community", "data_source", "author_hash")


@query("bucket_upsert_stream", _LATEST)
def bucket_upsert_stream(spark, sf):
    """Latest post of every author, kept by a stream in a table of buckets, a file of documents in each micro-batch."""
    folder = work_folder(spark)
    posts = _document_stream(spark, sf, 1).select(*_AUTHOR, "post_id", F.substring("post_id", 2, 20).cast("long").alias("at"), "score")
    jobs.start(posts, f"{folder}/checkpoint", each=buckets.sink(f"{folder}/table", _AUTHOR, "at", "documents", 16)).awaitTermination()
    return shown(buckets.load(spark, f"{folder}/table"))


@query("bucket_lookup", _LATEST.replace("FROM posts GROUP", "FROM posts WHERE author_hash = 'u1' GROUP"))
def bucket_lookup(spark, sf):
    """Upsert of all documents, then the rows of one author, read from the buckets that may hold them."""
    path = f"{work_folder(spark)}/table"
    posts = b.document_posts(spark, sf).select(*_AUTHOR, "post_id", F.substring("post_id", 2, 20).cast("long").alias("at"), "score")
    buckets.upsert(posts, path, _AUTHOR, "at", buckets=16)
    wanted = posts.where("author_hash = 'u1'").select(*_AUTHOR)
    return shown(buckets.lookup(spark, path, wanted, _AUTHOR))
