"""Readers and writers: archives, dumps, partitioned post tables, reports, lexicons."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewatch.functions import dates, text
from tidewatch.operators import clean

# Archive file name = prefix_community_YYYYMM_YYYYMM.jsonl
ARCHIVE_NAME = r"^arctic_shift_([A-Za-z0-9_]+)_(\d{6})_(\d{6})\.jsonl$"

# Column aliases, first match wins.
POST_ALIASES = {
    "community": ("community", "subreddit"),
    "selftext": ("post", "selftext", "body", "text"),
    "created_utc": ("date", "created_utc", "created", "timestamp"),
    "author": ("author_hash", "author", "user", "username"),
    "post_id": ("post_id", "id", "submission_id"),
}

# Renames of the CSV dumps (only when the target is absent).
DUMP_ALIASES = {
    "body": "selftext",
    "content": "selftext",
    "text": "selftext",
    "created": "created_utc",
    "posted_at": "created_utc",
    "author_name": "author",
    "submission_id": "post_id",
    "id": "post_id",
    "ups": "score",
    "subreddit": "community",
}

ARCHIVE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created_utc", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def archive_community(file_name: Column) -> Column:
    """Community in an archive file name, null when the name has another shape."""
    return F.nullif(F.lower(F.regexp_extract(file_name, ARCHIVE_NAME, 1)), F.lit(""))


def archive_period(file_name: Column) -> tuple[Column, Column]:
    part = lambda i: F.nullif(F.regexp_extract(file_name, ARCHIVE_NAME, i), F.lit(""))
    return part(2), part(3)


def read_archive(spark: SparkSession, path: str, community: str | None = None, min_chars: int = 10) -> DataFrame:
    """JSON-lines archive with ``skip_reason`` and file name per row; malformed lines are kept as rows."""
    raw = (
        spark.read.schema(ARCHIVE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
        .withColumnsRenamed({"id": "post_id", "subreddit": "community"})
        .withColumn("file", F.col("_metadata.file_name"))
    )
    return clean.apply_row_rules(raw, community, min_chars)


def archive_posts(ruled: DataFrame, data_source: str = "arctic_shift") -> DataFrame:
    return clean.canonical_archive_rows(ruled, data_source)


def archive_counts(ruled: DataFrame) -> DataFrame:
    return clean.row_rule_counts(ruled, "file")


SUFFIXES = ("csv", "parquet", "json", "jsonl")


def _csv(reader):
    """Post bodies contain line breaks inside quotes, so CSV files are read whole-record and not split."""
    return reader.option("header", "true").option("multiLine", "true").option("escape", '"')


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str] = SUFFIXES, name_glob: str = "") -> DataFrame:
    """path, file, suffix and bytes of every file below ``path``; no content is read."""
    globs = f"{name_glob or '*'}.{{{','.join(suffixes)}}}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs).load(path)
    return found.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.regexp_extract("path", r"[^.]*$", 0).alias("suffix"), F.col("length").alias("bytes"))


def first_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """First line with a character of each text file."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.where((F.trim("value") != "")).groupBy("path", F.spark_partition_id().alias("part")).agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at"))
    # Splits of a file lie in partitions of any order, so the split at its start is told by its block.
    starts = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.spark_partition_id().alias("part")).where("_metadata.file_block_start = 0").distinct()
    return {r.path: r.value.lstrip("\ufeff") for r in lines.join(starts, ["path", "part"]).select("path", "value").collect()}


def read_files(spark: SparkSession, path: str, suffixes: Sequence[str] = SUFFIXES, name_glob: str = "") -> list[DataFrame]:
    """The files below ``path``, a DataFrame per layout, each with the column ``file``.

    Files of one layout are read together and no file is read by another's: CSV files are grouped by their own header
    line, JSON files by whether they hold an array or an object per line, Parquet files by the schema in their footer.
    ``name_glob`` narrows the file names (for example ``lonely_2019*``).
    """
    groups: dict[tuple, list[str]] = {}
    listed = list_files(spark, path, suffixes, name_glob).where("bytes > 0").select("path", "suffix").collect()
    text_like = [r.path for r in listed if r.suffix != "parquet"]
    heads = first_lines(spark, text_like) if text_like else {}
    for r in sorted(listed):
        if r.suffix == "csv":
            layout = (heads.get(r.path, "").rstrip("\r"),)
        elif r.suffix == "parquet":
            layout = (_parquet_layout(spark, r.path),)
        else:
            layout = (heads.get(r.path, "").lstrip().startswith("["),)
        groups.setdefault((r.suffix, *layout), []).append(r.path)
    out = []
    for (suffix, layout), paths in groups.items():
        if suffix == "csv" and layout:
            names = next(csv.reader([layout]))
            df = _csv(spark.read).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(paths)
        elif suffix == "parquet" and layout:
            df = spark.read.schema(T.StructType.fromJson(json.loads(layout))).parquet(*paths)
        elif suffix in ("json", "jsonl"):
            df = spark.read.option("multiLine", str(layout).lower()).json(paths)
        else:
            continue  # no header or no footer: file_status says so
        if df.columns:
            out.append(df.withColumn("file", F.col("_metadata.file_name")))
    return out


def _parquet_layout(spark: SparkSession, path: str) -> str:
    try:
        return spark.read.option("ignoreCorruptFiles", "true").parquet(path).schema.json()
    except PySparkException:
        return ""


def file_status(spark: SparkSession, path: str, frames: Sequence[DataFrame], suffixes: Sequence[str] = SUFFIXES, name_glob: str = "") -> DataFrame:
    """path, file, bytes, rows and status of every file with content below ``path``: read, or skipped (nothing in it could be read).

    ``frames`` come from ``read_files``.  Rows are counted by path, so files of one name in several folders are told apart.
    """
    counts = [f.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows")) for f in frames]
    rows = reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "path string, rows long")
    status = F.when(F.coalesce("rows", F.lit(0)) > 0, "read").otherwise("skipped")
    plain = lambda c: F.regexp_replace(F.col(c), "^file:/+", "file:/")  # noqa: E731  both spellings of a local path
    found = list_files(spark, path, suffixes, name_glob).withColumn("_at", plain("path"))
    found = found.join(rows.select(plain("path").alias("_at"), "rows").groupBy("_at").agg(F.sum("rows").alias("rows")), "_at", "left")
    return found.select("path", "file", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def selected_files(file: Column, community: str, timeframes: Sequence[str]) -> Column:
    """Files of a community, one of the time frames, with precomputed features in the name."""
    name = F.lower(file)
    return F.startswith(name, F.lit(f"{community.lower()}_")) & F.contains(name, F.lit("_features_")) & F.reduce(
        F.array(*[F.contains(name, F.lit(t.lower())) for t in timeframes]), F.lit(False), lambda a, b: a | b
    )


def pick_column(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def normalize_posts(df: DataFrame, community: str, data_source: str = "zenodo_covid") -> DataFrame | None:
    """Any post table to the canonical six columns; None without a body and a clock column.

    Row numbers are not stable in a distributed read, so rows without an id get a hash
    of their content.
    """
    found = {k: pick_column(df.columns, v) for k, v in POST_ALIASES.items()}
    if not found["selftext"] or not found["created_utc"]:
        return None
    rows = df
    if found["community"]:
        rows = rows.where(F.lower(F.col(found["community"]).cast("string")) == community.lower())
    clock = found["created_utc"]
    if dict(df.dtypes)[clock].startswith(("timestamp", "date")):
        rows = rows.withColumn("_unix", F.unix_micros(F.col(clock).cast("timestamp")) / F.lit(1.0e6))
    else:
        rows = dates.to_unix_seconds(rows, clock, "_unix")
    shaped = rows.select(
        (F.col(found["post_id"]).cast("string") if found["post_id"] else F.lit("")).alias("post_id"),
        F.col("_unix").alias("created_utc"),
        F.col(found["selftext"]).cast("string").alias("selftext"),
        F.lit(community).alias("community"),
        (F.col(found["author"]).cast("string") if found["author"] else F.lit("[deleted]")).alias("author"),
        F.lit(data_source).alias("data_source"),
    )
    return clean.repair_ids(shaped.withColumn("created_utc", F.col("created_utc").cast("long")))


def load_community(frames: Iterable[DataFrame], community: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Many files of one community: normalise, union, date filter, one row per id."""
    shaped = [n for n in (normalize_posts(f, community) for f in frames) if n is not None]
    posts = clean.union_sources(shaped).where(F.col("created_utc").isNotNull() & F.col("selftext").isNotNull())
    first = clean.keep_first(clean.between_dates(posts, start, end), ["post_id"], [F.col("created_utc"), F.col("selftext")])
    return first.withColumn("created_utc_dt", F.timestamp_seconds("created_utc"))


def read_dump(spark: SparkSession, path: str, community: str | None = None) -> DataFrame:
    """CSV dump with alias renames; unusable clocks are dropped, a missing column is an error."""
    df = _csv(spark.read).csv(path)
    for alias, target in DUMP_ALIASES.items():
        if alias in df.columns and target not in df.columns:
            df = df.withColumnRenamed(alias, target)
    for c in ("created_utc", "selftext"):
        if c not in df.columns:
            raise ValueError(f"dump is missing required column {c!r}; available: {df.columns}")
    if community and "community" not in df.columns:
        df = df.withColumn("community", F.lit(community))
    df = df.withColumn("created_utc", dates.number_or_null(F.col("created_utc")))
    return df.where(F.col("created_utc").isNotNull()).withColumn("created_utc_dt", F.timestamp_seconds("created_utc"))


def spread_by_community(posts: DataFrame) -> DataFrame:
    """Rows of a community together; adaptive execution splits a hot one by its bytes, so several tasks write it."""
    return posts.hint("rebalance", F.col("community"))


def save_posts(posts: DataFrame, path: str) -> None:
    clean.validate(posts, "raw")
    spread_by_community(posts).write.mode("overwrite").partitionBy("community").parquet(path)


def load_posts(spark: SparkSession, path: str, communities: Sequence[str] | None = None) -> DataFrame:
    """Stored posts; the community filter prunes partitions.  No match at all is an error."""
    df = spark.read.parquet(path)
    if communities is None:
        return df
    out = df.where(F.col("community").isin(*[c.lower() for c in communities], *communities))
    if out.limit(1).count() == 0:
        raise FileNotFoundError(f"no stored posts for {list(communities)}")
    return out


def save_artifact(df: DataFrame, path: str, artifact: str | None = None) -> None:
    if artifact:
        clean.validate(df, artifact)
    df.write.mode("overwrite").parquet(path)


def load_artifact(spark: SparkSession, path: str) -> DataFrame | None:
    """Artifact, or None when it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_briefs_text(briefs: DataFrame, path: str) -> None:
    """One folder per community and week, text inside."""
    safe = F.regexp_replace("week_key", "/", "-")
    briefs.select("community", safe.alias("week_key"), F.trim("text").alias("value")).write.mode("overwrite").partitionBy(
        "community", "week_key").text(path)


def read_legacy_briefs(spark: SparkSession, path: str) -> DataFrame:
    """One text file per week: key from the file name, community from the folder above."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    file = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(file, r"([^/]+)/[^/]+/[^/]+\.txt$", 1).alias("community"),
        F.regexp_extract(file, r"([^/]+)\.txt$", 1).alias("week_key"), F.trim("value").alias("text"),
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(family, term) from one text file per family; blanks dropped, terms lower-cased."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(path)
    family = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return df.select(family.alias("family"), F.lower(text.strip_unicode(F.col("value"))).alias("term")).where(F.col("term") != "")


def lexicon_terms(table: DataFrame) -> dict[str, list[str]]:
    """Term lists of a hand-kept lexicon, for the expressions that take lists; a large one stays a table (``features.lexicon_hits``)."""
    out: dict[str, list[str]] = {}
    for r in table.collect():
        out.setdefault(r["family"], []).append(r["term"])
    return out


def read_playbook(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path)


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    """Prediction log; malformed lines are skipped."""
    schema = (
        "timestamp string, request_id string, community string, week_start string, tabular_prob double, sequence_state int, "
        "ensemble_prob double, predicted_state_label string, drift_warnings array<string>, has_drift boolean, latency_ms double, _bad string"
    )
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.where(F.col("_bad").isNull()).drop("_bad")


# Model names of stored results.
MODEL_KEYS = {"xgb": "tabular", "lstm": "sequence", "ensemble": "ensemble"}
_SERIES = "struct<predictions:array<double>,probabilities:array<double>,actuals:array<double>>"
_RESULT = f"struct<error:string,recall:double,precision:double,f1:double,pr_auc:double,roc_auc:double,n_crisis_actual:int,per_week:{_SERIES}>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored evaluation results ({community: {model: {...}}}) as one row per community and model."""
    whole = spark.read.option("wholetext", "true").text(path)
    parsed = F.from_json("value", f"map<string,map<string,{_RESULT}>>", {"allowNonNumericNumbers": "true"})
    per_community = whole.select(F.explode(parsed).alias("community", "models"))
    names = F.create_map(*[F.lit(x) for kv in MODEL_KEYS.items() for x in kv])
    rows = per_community.select("community", F.explode("models").alias("key", "r"))
    return rows.select("community", F.coalesce(F.element_at(names, F.col("key")), F.col("key")).alias("model"), "r.*")


def result_series(results: DataFrame) -> DataFrame:
    """Weekly series of stored results in long form, NaN as null."""
    from tidewatch.operators.metrics import explode_arrays

    arrays = results.where(F.col("per_week").isNotNull()).select("community", "model", "per_week.*")
    return explode_arrays(arrays)
