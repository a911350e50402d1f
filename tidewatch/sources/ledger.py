"""Small keyed tables: manifests, provenance, briefs, transitions, run telemetry."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import spread
from tidewatch.sources.files import load_artifact

#: Stores that a task opens itself (Spark's name: its name), and how much of a file it holds at a time.
STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
HASH_BYTES = 8 << 20


def upsert(old: DataFrame | None, new: DataFrame, keys: Sequence[str], clock: str) -> DataFrame:
    """One row per key, the latest clock wins; on equal clocks the new row does."""
    rows = new.withColumn("_new", F.lit(1))
    if old is not None:
        rows = old.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, "_new")]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(clock), F.col("_new"))).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows plus the new rows whose key is unknown."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size and sha256 of every file below a path, hashed in the tasks that own the paths.

    A task streams a file in pieces of HASH_BYTES, so its size does not matter.  A store that only Spark opens is read
    through Spark, which takes files up to 2 GiB.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    named = [F.col("path"), F.col("length").alias("size_bytes")]
    some = df.select("path").head()
    if some and some[0].partition(":")[0] not in STORES:
        return df.select(*named, F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"))

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_sha256(p) for p in b.column(0).to_pylist()], pa.string())], [*b.schema.names, "sha256"])

    listed = df.select(*named, F.col("modificationTime").alias("modified_at"))
    out = spread(listed, "path").mapInArrow(hashed, "path string, size_bytes long, modified_at timestamp, sha256 string")
    return out.select("path", "size_bytes", "sha256", "modified_at")


def _sha256(path: str) -> str:
    scheme, _, rest = path.partition(":")
    store, inside = fs.FileSystem.from_uri(f"{STORES[scheme]}://{'/' * (scheme == 'file')}{quote(rest.lstrip('/'), safe='/:@')}")
    digest = hashlib.sha256()
    with store.open_input_stream(inside) as f:
        while part := f.read(HASH_BYTES):
            digest.update(part)
    return digest.hexdigest()


def changed_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose size or hash differs from the manifest."""
    return current.join(manifest.select("path", "size_bytes", "sha256"), ["path", "size_bytes", "sha256"], "left_anti")


def ingestion_record(posts: DataFrame) -> DataFrame:
    return posts.groupBy("community").agg(
        F.count("*").alias("rows"), F.min("created_utc").alias("min_created_utc"), F.max("created_utc").alias("max_created_utc"),
    ).withColumn("status", F.lit("ok"))


def fingerprint(manifest: DataFrame, config_json: str) -> DataFrame:
    """One hash over every input file and the configuration.

    The per-file hashes are combined order-free by adding their 32-bit parts, so no list
    of files is collected; the count guards against an empty or shortened input.
    """
    word = lambda i: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "sha256"), 256), i, 8), 16, 10).cast("decimal(38,0)"))
    parts = [F.coalesce(word(i), F.lit(0)).cast("string") for i in (1, 9, 17, 25)]
    return manifest.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts, F.lit(config_json)), 256).alias("fingerprint"))


def is_current(spark: SparkSession, stored: str, now: DataFrame) -> bool:
    """Does the stored fingerprint table equal the one just computed (two single rows)."""
    old = load_table(spark, stored)
    return old is not None and old.select("fingerprint").first() == now.select("fingerprint").first()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_latest(log: DataFrame, path: str, n: int = 1000, clock: str = "timestamp") -> None:
    log.orderBy(F.desc(clock)).limit(n).write.mode("overwrite").json(path)


def _slots(spark: SparkSession, path: str) -> list[tuple[int, str, DataFrame | None]]:
    """(version, folder, rows) of the two copies of a table, the current one first."""
    found = []
    for name in ("even", "odd"):
        folder = f"{path.rstrip('/')}/{name}"
        df = load_artifact(spark, folder)
        version = df.agg(F.max("_version")).first()[0] if df is not None else None
        found.append((version or 0, folder, df if version else None))
    return sorted(found, key=lambda x: -x[0])


def load_table(spark: SparkSession, path: str) -> DataFrame | None:
    """Current copy of a table kept by ``rewrite``; None when there is none."""
    _, _, df = _slots(spark, path)[0]
    return df.drop("_version") if df is not None else None


def rewrite(df: DataFrame, path: str) -> None:
    """Replace a small table by its next version.

    A table lives in two folders.  The next version goes into the older one, so the
    current copy stays readable while it is written (``df`` may be computed from it)
    and a job that is lost half way leaves it untouched.
    """
    (version, _, _), (_, older, _) = _slots(df.sparkSession, path)
    df.withColumn("_version", F.lit(version + 1)).write.mode("overwrite").parquet(older)


def recent_or(spark: SparkSession, path: str, fallback: str, n: int = 20, clock: str = "timestamp") -> DataFrame | None:
    """Latest n transitions of the log table, else of its JSON export, else None."""
    log = load_artifact(spark, path)
    if log is None:
        try:
            log = spark.read.json(fallback)
        except AnalysisException:
            return None
    return log.orderBy(F.desc(clock)).limit(n)


def inserted_rows(before: DataFrame, after: DataFrame, by: str = "community") -> DataFrame:
    """Rows a gap fill really added: rows after de-duplication minus rows before."""
    a = before.groupBy(by).agg(F.count("*").alias("_a"))
    b = after.groupBy(by).agg(F.count("*").alias("_b"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return b.join(a, by, "full").select(by, (n(F.col("_b")) - n(F.col("_a"))).alias("inserted_rows"))


def flatten_profile(profile: DataFrame) -> DataFrame:
    """Nested run telemetry to rows: stage steps, community runs, and plain records."""
    steps = profile.where(F.col("steps").isNotNull()).select(F.explode("steps").alias("s")).select(
        F.col("s.stage").alias("stage"), F.col("s.elapsed_seconds").alias("elapsed_seconds"), F.lit(None).cast("long").alias("rows_processed"))
    runs = profile.where(F.col("steps").isNull() & F.col("community_runs").isNotNull()).select(F.explode("community_runs").alias("r")).select(
        F.concat_ws(":", F.coalesce("r.stage", F.lit("collect")), F.col("r.community")).alias("stage"),
        F.col("r.elapsed_seconds").alias("elapsed_seconds"), F.col("r.rows_processed").alias("rows_processed"))
    plain = profile.where(F.col("steps").isNull() & F.col("community_runs").isNull()).select("stage", "elapsed_seconds", "rows_processed")
    return steps.unionByName(runs).unionByName(plain)


def stage_record(stage: Column, seconds: Column, rows: Column) -> list[Column]:
    return [stage.alias("stage"), seconds.alias("elapsed_seconds"), rows.alias("rows_processed"),
            F.try_divide(rows.cast("double"), seconds).alias("throughput_rows_per_sec")]


def brief_for(briefs: DataFrame, community: str, week_key: str) -> DataFrame:
    return briefs.where((F.col("community") == community) & (F.col("week_key") == week_key)).select("text")
