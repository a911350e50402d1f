"""Queries that write a driver table through a sink to the shared folder and read it back through a reader."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import clean
from tidewatch.plans import bindings as b
from tidewatch.plans.checks_stream import work_folder
from tidewatch.plans.registry import query, shown
from tidewatch.sources import files, ledger

#: Bytes of the stored documents that a file of `manifest_status` holds, about.
FILE_BYTES = 64 << 20


def _documents(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("text").alias("body"), (F.col("doc_id") + 1514764800).alias("created"), F.col("lang").alias("subreddit"), F.col("source").alias("author"), "doc_id")


@query("file_layouts", """SELECT lang AS community, 'd' || doc_id AS post_id, 1514764800 + doc_id AS created_utc, sha256(text) AS text_hash,
  CASE WHEN doc_id % 5 = 4 THEN '[deleted]' ELSE source END AS author FROM documents""")
def file_layouts(spark, sf):
    """Documents as five layouts below one folder: two CSV column orders, JSON lines, and two Parquet schemas."""
    d, folder = _documents(spark, sf), f"{work_folder(spark)}/raw"
    part = lambda k: d.where(F.col("doc_id") % 5 == k)
    one = part(0).select(F.col("created").alias("date"), "subreddit", F.col("body").alias("post"), "author", "id")
    two = part(1).select("id", "author", "body", F.col("created").alias("created_utc"), "subreddit")
    for df, name in ((one, "a"), (two, "b")):
        df.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(f"{folder}/{name}")
    part(2).select("id", "body", "created", "subreddit", "author").write.json(f"{folder}/c")
    part(3).select(F.col("id").alias("post_id"), F.col("body").alias("selftext"), F.col("created").alias("created_utc"), F.col("subreddit").alias("community"), "author").write.parquet(f"{folder}/d")
    part(4).select("subreddit", F.col("created").alias("timestamp"), F.col("body").alias("text"), "id").write.parquet(f"{folder}/e")
    frames = files.read_files(spark, folder)
    communities = [r[0] for r in d.select("subreddit").distinct().orderBy("subreddit").collect()]
    posts = clean.union_sources([files.load_community(frames, c) for c in communities])
    return posts.select("community", "post_id", "created_utc", F.sha2("selftext", 256).alias("text_hash"), "author")


@query("file_status_counts", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 'read' AS status FROM documents")
def file_status_counts(spark, sf):
    folder = f"{work_folder(spark)}/raw"
    _documents(spark, sf).write.parquet(folder)
    return files.file_status(spark, folder, files.read_files(spark, folder)).groupBy("status").agg(F.sum("rows").alias("n_rows"))


@query("stored_posts", "SELECT 'd' || doc_id AS post_id, lang AS community, 1514764800 + doc_id AS created_utc, length(text) AS n FROM documents WHERE lang IN ('en', 'fr')")
def stored_posts(spark, sf):
    """Posts saved by community and loaded for two of them."""
    folder = f"{work_folder(spark)}/posts"
    d = _documents(spark, sf)
    files.save_posts(d.select(F.col("id").alias("post_id"), F.col("created").alias("created_utc"), F.col("body").alias("selftext"), F.col("subreddit").alias("community")), folder)
    return shown(files.load_posts(spark, folder, ["en", "fr"]).select("post_id", "community", "created_utc", F.length("selftext").alias("n")))


@query("artifact_round_trip", "SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ALL")
def artifact_round_trip(spark, sf):
    folder = work_folder(spark)
    files.save_artifact(b.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")), f"{folder}/a")
    if files.load_artifact(spark, f"{folder}/none") is not None:
        raise ValueError("an artifact that was never written")
    return files.load_artifact(spark, f"{folder}/a")


@query("csv_report", "SELECT lang, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY lang")
def csv_report(spark, sf):
    folder = f"{work_folder(spark)}/report"
    files.write_csv(b.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), folder)
    return spark.read.option("header", "true").csv(folder)


@query("json_report", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def json_report(spark, sf):
    folder = f"{work_folder(spark)}/report"
    files.write_json(b.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), folder)
    return spark.read.json(folder)


@query("manifest_status", "SELECT 0 AS n_changed, 1 AS n_new, 64 AS hash_chars FROM (SELECT count(*) AS n FROM documents) WHERE n > 0")
def manifest_status(spark, sf):
    """The manifest of the documents' files: nothing changes between two readings, one file more is one new file.

    The folder ends up with the documents twice, in files of about FILE_BYTES; the new file is a share of the second copy.
    """
    folder = f"{work_folder(spark)}/files"
    docs = b.table(spark, sf, "documents")
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf}/documents.parquet")
    n = max(3, math.ceil((stored.agg(F.sum("length")).first()[0] or 0) / FILE_BYTES))
    late = F.pmod(F.xxhash64(*docs.columns), F.lit(n)) == 0
    docs.repartition(n).write.parquet(folder)
    docs.where(~late).write.mode("append").parquet(folder)
    first = b.stored(ledger.file_manifest(spark, folder, "*.parquet"))
    again = b.stored(ledger.changed_files(ledger.file_manifest(spark, folder, "*.parquet"), first).agg(F.count("*").alias("n_changed")))
    docs.where(late).repartition(1).write.mode("append").parquet(folder)
    later = ledger.changed_files(ledger.file_manifest(spark, folder, "*.parquet"), first).agg(F.count("*").alias("n_new"), F.min(F.length("sha256")).alias("hash_chars"))
    return shown(again.withColumn("k", F.lit(1)).join(later.withColumn("k", F.lit(1)), "k").drop("k"))


@query("lexicon_files", "SELECT lang AS family, count(DISTINCT lower(source)) AS n_terms FROM documents GROUP BY lang")
def lexicon_files(spark, sf):
    """One text file per family, read as a table of terms."""
    folder = f"{work_folder(spark)}/lexicon"
    terms = b.table(spark, sf, "documents").select("lang", F.upper("source").alias("value")).distinct()
    terms.repartition(1, "lang").write.partitionBy("lang").text(folder)
    raw = spark.read.option("basePath", folder).text(f"{folder}/*")
    named = raw.select(F.col("lang").alias("family"), F.lower(text.strip_unicode(F.col("value"))).alias("term")).where("term <> ''")
    return named.groupBy("family").agg(F.count("*").alias("n_terms"))


@query("brief_files", "SELECT lang AS community, '2018-W' || lpad(CAST(doc_id % 50 + 1 AS VARCHAR), 2, '0') AS week_key, count(*) AS n FROM documents GROUP BY ALL")
def brief_files(spark, sf):
    """Briefs as text files per community and week."""
    folder = f"{work_folder(spark)}/briefs"
    week = F.concat(F.lit("2018-W"), F.lpad((F.col("doc_id") % 50 + 1).cast("string"), 2, "0"))
    files.write_briefs_text(b.table(spark, sf, "documents").select(F.col("lang").alias("community"), week.alias("week_key"), F.concat(F.lit("brief "), "doc_id").alias("text")), folder)
    back = spark.read.option("basePath", folder).text(f"{folder}/*/*")
    return back.groupBy("community", "week_key").agg(F.count("*").alias("n"))


@query("first_non_blank", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS shown FROM documents")
def first_non_blank(spark, sf):
    d = b.table(spark, sf, "documents")
    blank = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, F.lit("  "))).otherwise(F.col("lang"))
    return d.select("doc_id", text.first_non_blank(blank, F.col("source")).alias("shown"))
