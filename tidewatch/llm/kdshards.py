"""Sharding by a K-d tree over document metadata, cut at weighted medians until leaves reach a target size.

Every document is a point: its metadata columns as whole numbers, its weight the bytes of its text.  A node with
several leaves to come is cut along the dimension in which it is widest (as a part of that dimension's range over all
rows), where the bytes below the cut are the share that half of its leaves should have.  The median is found by
histograms: a job counts the bytes of all nodes of a level in BUCKETS stretches of their dimension, the stretch with
the median is cut into stretches again, and where one value holds too much its rows are ordered by a hash in which
equal texts are neighbours.  So a value, source or text that holds a third of all rows is cut like any other.

Only a narrow table (no texts) takes part; a level rewrites it once.  Everything is DataFrame functions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from tidewatch.llm.common import BROADCAST_BYTES, small_side, stored

BUCKETS = 4096
#: A stretch with less than this part of a node's bytes is left whole.
FINEST = 1 / 4096
#: Ties are below this number.
TIES = 1 << 56
DIMS = ("source", "lang", "n_chars", "size")


def coordinate(column: Column, kind: T.DataType) -> Column:
    """A column as a whole number that keeps its order: numbers rounded down, texts by their first seven bytes; null comes first."""
    if isinstance(kind, T.StringType):
        head = F.hex(F.substring(column.cast("binary"), 1, 7))
        return F.coalesce(F.conv(F.rpad(head, 14, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))
    lowest, wide = F.lit(-(1 << 62)).cast("long"), F.lit(float(1 << 61))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.floor(F.greatest(F.least(column.cast("double"), wide), -wide)), lowest)
    return F.coalesce(F.greatest(F.least(column.cast("long"), F.lit(1 << 61)), F.lit(-(1 << 61))), lowest)


def points(docs: DataFrame, dims: tuple[str, ...] = DIMS, uid: str | None = None) -> DataFrame:
    """uid (unique), doc_id, size, text_crc32, at (coordinates), node (the root), tie: the narrow table of ``docs``, written once so that uid stays.

    ``size`` names the weight, any other name a column of ``docs``.  uid counts within each written partition, whose
    number is in its upper bits; a stored column of such numbers can be named instead.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long"))
    at = [size if d == "size" else coordinate(F.col(d), docs.schema[d].dataType) for d in dims]
    rows = docs.select((F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), F.col("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.array(*at).alias("at"),
                       F.lit(0).cast("long").alias("node"))
    return stored(rows.withColumn("tie", F.expr("text_crc32 * 16777216 + (xxhash64(uid) & 16777215)")), "points")


Cut = dict[str, int]


def _table(spark: SparkSession, nodes: list[Cut], schema: str) -> DataFrame:
    """A row per node of a level, broadcast as long as that many rows are small."""
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(nodes)), f"array<struct<{schema}>>")))
    return F.broadcast(rows) if len(nodes) * 128 <= BROADCAST_BYTES else rows


def tree(rows: DataFrame, leaves: int, dims: int) -> tuple[DataFrame, list[Cut]]:
    """``rows`` (of ``points``) with shard 0 to ``leaves`` - 1 in order of the tree, and the cuts of its inner nodes.

    The tree is the model that the driver keeps: a few numbers per leaf, however many rows there are.  A node is named
    by its first leaf.  Halves miss their share by at most half a row or FINEST of the node's bytes.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("leaves", F.lit(leaves).cast("long"))
    every: list[Cut] = []
    spread: list[float] = []
    for _ in range(math.ceil(math.log2(leaves))):
        low, high = F.array(*[F.min(F.col("at")[d]) for d in range(dims)]), F.array(*[F.max(F.col("at")[d]) for d in range(dims)])
        nodes = rows.where("leaves > 1").groupBy("node", "leaves").agg(F.sum("size").alias("bytes"), low.alias("low"), high.alias("high")).collect()
        spread = spread or [float(h - w) or 1.0 for r in nodes for w, h in zip(r.low, r.high)]
        state = []
        for r in nodes:
            wide = [(r.high[d] - r.low[d]) / spread[d] for d in range(dims)]
            d = wide.index(max(wide))
            state.append({"node": r.node, "leaves": r.leaves, "bytes": r.bytes, "goal": max(1, r.bytes * (r.leaves // 2) // r.leaves), "dim": d, "lo": r.low[d], "hi": r.high[d], "below": 0, "tied": 0, "value": 0})
        cuts: list[Cut] = []
        while state:  # all open nodes of the level in one job a round
            state = [_narrowed(s, hit) for s, hit in _hits(rows, state)]
            cuts += [s for s in state if "cut_value" in s]
            state = [s for s in state if "cut_value" not in s]
        if not cuts:
            break
        every += cuts
        value = F.col("at")[F.col("dim")]
        below = (value < F.col("cut_value")) | ((value == F.col("cut_value")) & (F.col("tie") < F.col("cut_tie")))
        half = F.expr("leaves div 2")
        rows = rows.join(_table(spark, cuts, "node long, dim int, cut_value long, cut_tie long"), "node", "left").select(
            "uid", "doc_id", "size", "text_crc32", "at", "tie",
            F.when(F.col("dim").isNull() | below, F.col("node")).otherwise(F.col("node") + half).alias("node"),
            F.when(F.col("dim").isNull(), F.col("leaves")).when(below, half).otherwise(F.col("leaves") - half).alias("leaves"),
        )
        rows = stored(rows, "level")
    return rows.withColumn("shard", F.col("node").cast("int")).drop("node", "leaves"), every


def _hits(rows: DataFrame, state: list[Cut]) -> Iterator[tuple[Cut, Row]]:
    """Each node of ``state`` with the one of the BUCKETS stretches of lo..hi in which its bytes reach the goal."""
    width = f"((hi - lo) div {BUCKETS} + 1)"
    nodes = _table(rows.sparkSession, state, "node long, dim int, goal long, lo long, hi long, below long, tied int, value long")
    value = F.col("at")[F.col("dim")]
    key = F.when(F.col("tied") == 1, F.col("tie")).otherwise(value)
    inside = (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")) & ((F.col("tied") == 0) | (value == F.col("value")))
    counted = rows.join(nodes, "node").withColumn("key", key).where(inside).withColumn("bucket", F.expr(f"(key - lo) div {width}"))
    counted = counted.groupBy("node", "goal", "below", "bucket").agg(F.sum("size").alias("held"), F.count("*").alias("count"), F.min("key").alias("low"), F.max("key").alias("high"))
    upto = F.col("below") + F.sum("held").over(Window.partitionBy("node").orderBy("bucket"))
    found = counted.withColumn("upto", upto).where("upto >= goal AND upto - held < goal").select("node", "held", "count", "low", "high", "upto")
    hits = {r.node: r for r in found.collect()}
    return ((s, hits[s["node"]]) for s in state)


def _narrowed(s: Cut, hit: Row) -> Cut:
    """A node after a round: cut beside the stretch if that is fine enough, else the stretch's own range, or the ties of its one value."""
    s = s | {"below": hit.upto - hit.held, "lo": hit.low, "hi": hit.high}
    one = hit.low == hit.high
    if hit["count"] == 1 or hit.held <= s["bytes"] * FINEST or (one and s["tied"]):
        over = s["goal"] - s["below"] > hit.upto - s["goal"]  # the end above the stretch is nearer to the goal
        edge = hit.high + 1 if over else hit.low
        return s | {"cut_value": s["value"] if s["tied"] else edge, "cut_tie": edge if s["tied"] else 0, "bytes_below": hit.upto if over else s["below"]}
    return s | ({"tied": 1, "value": hit.low, "lo": 0, "hi": TIES - 1} if one else {})


def slots(rows: DataFrame) -> DataFrame:
    """``rows`` with slot, gapless from 0 in each shard.

    Rows are numbered within their shard and written partition, which a split of the input bounds; a small table says
    where each such run begins.
    """
    part = F.shiftright("uid", 33)
    runs = rows.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"))
    begin = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("shard", "part", begin.alias("begin")), "runs")
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1
    return rows.withColumn("part", part).withColumn("inner", inner).join(small_side(runs, 32), ["shard", "part"]).withColumn("slot", F.col("begin") + F.col("inner"))


def shards(docs: DataFrame, target_bytes: int | None = None, leaves: int | None = None, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, slot.

    Leaves are cut until their number is the total by ``target_bytes``, or ``leaves``.  A null text has size 1 and
    checksum 0 like an empty one; null metadata comes before all values; a null doc_id is kept; repeated rows are
    documents of their own, very long texts weigh what they have.  With fewer documents than leaves some shards are
    empty; an empty table gives no rows.  Columns of other names aren't read, so they can't clash.
    """
    rows = points(docs, dims)
    if leaves is None:
        leaves = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed, _ = tree(rows, leaves, len(dims))
    return slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, target_bytes: int | None = None, leaves: int | None = None, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Writes ``docs`` with all their columns as Parquet below ``path``, a folder ``shard=k`` for each leaf, and reads them back.

    Documents are written once beside their narrow table and joined to their leaves by uid; the rebalance splits a
    large shard over tasks.  A column named shard or __uid is an error, as folders carry that name.
    """
    if {"shard", "__uid"} & {c.lower() for c in docs.columns}:
        raise ValueError("shard and __uid are names of the result")
    whole = stored(docs.withColumn("__uid", F.monotonically_increasing_id()), "documents")
    rows = points(whole, dims, "__uid")
    leaves = leaves or max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed, _ = tree(rows, leaves, len(dims))
    out = whole.join(placed.select(F.col("uid").alias("__uid"), "shard"), "__uid").drop("__uid")
    out.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType())])
    return docs.sparkSession.read.schema(schema).parquet(path)
