"""Keyed tables of any size: rows lie in hash buckets, an upsert rewrites only the buckets that it touches.

A table is a folder with ``data`` and ``log``.  An upsert writes the new rows of its buckets into a folder of its own and then
one file of the log, which names the folder of every bucket: that file is the commit.  Readers follow the latest log file,
so they see whole commits only; what a lost writer has left behind is named by none.  A table has one writer at a time.

The number of buckets is settled by the first commit.  Choose it so that a bucket is some hundred megabytes; the log file has a
row per bucket, which is all that the driver ever holds.  Rows of a key are reduced to one before any shuffle, so a hot key is
one row; a bucket that is too large for a task is written by several.

Keys may be null (null is a value like any other).  A null clock is older than every other.  Columns that only some batches
have are null elsewhere.  An empty batch changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewatch.sources import ledger

BUCKETS = 256
LOG = "bucket int, folder string, rows_schema string, writers map<string, long>, version long"


def _commit(spark: SparkSession, path: str) -> tuple[int, dict[int, str | None], T.StructType | None, dict[str, int]]:
    """(version, folder by bucket, schema, last batch by writer) of the latest commit; version 0 where there is none."""
    try:
        log = spark.read.schema(LOG).parquet(f"{path.rstrip('/')}/log/*")
        newest = log.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None:
        return 0, {}, None, {}
    rows = log.where(F.col("version") == newest).collect()  # one row per bucket
    return newest, {r["bucket"]: r["folder"] for r in rows}, T.StructType.fromJson(json.loads(rows[0]["rows_schema"])), dict(rows[0]["writers"])


def _read(spark: SparkSession, path: str, folders: dict[int, str | None], schema: T.StructType, only: set[int] | None = None) -> DataFrame:
    paths = [f"{path.rstrip('/')}/data/{f}/_bucket={b}" for b, f in sorted(folders.items()) if f and (only is None or b in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of its latest commit; None when there is none."""
    version, folders, schema, _ = _commit(spark, path)
    return _read(spark, path, folders, schema) if version else None


def lookup(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Rows whose key is in ``wanted``; only the buckets that may hold one are read."""
    version, folders, schema, _ = _commit(spark, path)
    if not version:
        return None
    named = wanted.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in keys]).distinct()
    only = {r[0] for r in named.select(_bucket(keys, len(folders)).alias("b")).distinct().collect()}
    rows = _read(spark, path, folders, schema, only).alias("t")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    return rows.join(named.alias("w"), same, "left_semi")


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(batch: DataFrame, path: str, keys: Sequence[str], clock: str, writer: str = "batch", batch_id: int | None = None, buckets: int = BUCKETS) -> int:
    """One row per key, the latest clock wins, on equal clocks the new row; returns the version of the table.

    A batch of a writer whose ``batch_id`` is not above its last committed one is a replay and changes nothing.  Keys and clock
    keep the types of the first commit, which the hash of a key depends on.
    """
    spark, root = batch.sparkSession, path.rstrip("/")
    version, folders, schema, writers = _commit(spark, path)
    if batch_id is not None and writers.get(writer, -1) >= batch_id:
        return version
    folders = folders or dict.fromkeys(range(buckets))
    if schema is not None:
        typed = {f.name: f.dataType for f in schema}
        batch = batch.select(*[F.col(f"`{c}`").cast(typed[c]).alias(c) if c in typed else F.col(f"`{c}`") for c in batch.columns])
    name = uuid.uuid4().hex
    at = f"{root}/staged/{name}"  # the batch is read twice from here, its source once
    new = ledger.upsert(None, batch, keys, clock).withColumn("_bucket", _bucket(keys, len(folders)))
    new.write.parquet(at)
    new = spark.read.schema(new.schema).parquet(at)
    touched = {r[0] for r in new.select("_bucket").distinct().collect()}
    if not touched:
        return version
    rows = new.drop("_bucket")
    if version:
        rows = ledger.upsert(_read(spark, path, folders, schema, touched), rows, keys, clock)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    rows.withColumn("_bucket", _bucket(keys, len(folders))).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{root}/data/{name}")
    folders |= dict.fromkeys(touched, name)
    if batch_id is not None:
        writers[writer] = batch_id
    text = json.dumps(schema.jsonValue())
    log = spark.createDataFrame([(b, f, text, writers, version + 1) for b, f in folders.items()], LOG)
    log.coalesce(1).write.parquet(f"{root}/log/{version + 1:020d}")  # one file, so the commit is there or not
    return version + 1


def sink(path: str, keys: Sequence[str], clock: str, writer: str, buckets: int = BUCKETS):
    """foreachBatch writer; a micro-batch that is run again is a replay.  ``writer`` names the stream, one name per checkpoint."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, keys, clock, writer, batch_id, buckets)

    return write
