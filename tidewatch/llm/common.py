"""What the operators share: scratch tables in the shared folder, size-checked broadcasts, word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import shared_folder

#: White space of the contracts: space and the control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of at most this many bytes may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application; call it when no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, row_bytes: int) -> bool:
    """Whether the rows of ``df`` (a stored table), at ``row_bytes`` each, fit BROADCAST_BYTES; at most one more is counted."""
    most = BROADCAST_BYTES // row_bytes
    return df.limit(most + 1).count() <= most


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint when it fits, else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, row_bytes) else df


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Has this session send at most ``rows`` rows to Python at once, for functions of whole texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; ``lower`` does just that to a text without other letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, gaps: str) -> Column:
    """Maximal runs of what ``gaps`` (a pattern of the characters between words) doesn't match; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gaps), lambda w: w != "")
