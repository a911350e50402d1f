"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidewatch", cpus: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks.  A cluster supplies its own session."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    parts = shuffle_partitions or int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the driver and all executors see, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session on one machine gets a fresh folder; on a cluster a folder of one machine would lose
    what another executor wrote, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="tidewatch-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names.

    ``spark.checkpoint.dir`` (or a directory already set on the context) is used as it is.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    For loops of joins: a checkpoint is computed twice and hands the plan's inferred constraints on, which multiply
    from round to round until the optimizer no longer ends; a file has none.
    """
    path = f"{shared_folder(df.sparkSession)}/tables-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Hash-partition small rows that are expensive to work on.

    Adaptive execution sizes partitions by bytes and would put a whole panel into one
    task; a given number of partitions is kept as it is, and a grouped fit on the same
    keys needs no further shuffle.  ``most`` bounds the number where the rows are too few for the session's.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(parts, most or parts), *keys)
