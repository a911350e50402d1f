"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed words and word pairs, one of the target text and one of all raw text, give every
document the log of their ratio; adding Gumbel noise and keeping the k largest draws k documents without replacement
in proportion to the ratio.  The noise depends on the document's id and the seed only.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import small_side, stored

WORD = re.compile(r"\w+|[^\w\s]")
BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Word hashes that a worker keeps between batches.
KEPT_WORDS = 500_000
#: The k-th largest key is searched in this many bins a pass, until one bin holds no more keys than this.
BINS = 4096


class Hashed:
    """Buckets of the words and word pairs of a text."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh32_intdigest(w.encode())
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) >> np.uint64(7)
        return np.concatenate([h, pairs]) % np.uint64(self.buckets)


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw and target: n-grams of all ``docs`` and of those whose column ``is_target`` is true.

    Every task adds its own texts up first, so a task sends at most one row per bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Hashed(buckets), np.zeros((2, buckets), dtype=np.int64)
        for b in batches:
            for text, target in zip(b.column(0), b.column(1).to_pylist()):
                n = np.bincount(grams(text.as_py()).astype(np.int64), minlength=buckets)
                sums[0] += n
                if target:
                    sums[1] += n
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0, some]), pa.array(sums[1, some])], ["bucket", "raw", "target"])

    each = docs.select("text", "is_target").mapInArrow(run, "bucket long, raw long, target long")
    return each.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of every bucket; its length is the parameter ``buckets``."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in gram_counts(docs, buckets).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    share = lambda n: np.log(n + SMOOTHING) - math.log(n.sum() + SMOOTHING * buckets)
    return share(target) - share(raw)


def log_weight(ratios: np.ndarray) -> Column:
    held: list[Hashed] = []

    @F.arrow_udf("double")
    def weigh(text: pa.Array) -> pa.Array:
        if not held:
            held.append(Hashed(len(ratios)))
        return pa.array([float(ratios[held[0](t.as_py()).astype(np.int64)].sum()) for t in text], pa.float64())

    return weigh("text")


def gumbel(key: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column ``key``; passes of counts over ever narrower ranges, then one small bin."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return low
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        counts = sorted(inside.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect(), reverse=True)
        for r in counts:
            if above + r.n >= k:
                break
            above += r.n
        low, high = r.a, r.b
        if r.n <= BINS:
            return sorted((x.key for x in inside.where((F.col("key") >= low) & (F.col("key") <= high)).collect()), reverse=True)[k - above - 1]


def resampled(docs: DataFrame, target_ids: DataFrame, k: int | None = None, share: float | None = None, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, log_weight, gumbel_key and kept (among the k largest keys) of every row of ``docs``.

    ``target_ids`` has the doc_id of target documents; ``k`` or a ``share`` of the rows is drawn.  Null and empty texts
    have log weight 0.  Rows that repeat id and text have equal keys; where keys tie at the border, the rows with the
    least doc_id are kept.  A null doc_id is never a target.  Without targets, or with an empty table, nothing fails:
    the weights are those of a uniform target.
    """
    ids = stored(target_ids.select(F.col("doc_id").cast("long").alias("target_id")).where("target_id IS NOT NULL").distinct(), "targets")
    ids = ids.withColumn("is_target", F.lit(True))
    marked = docs.select("doc_id", "text").join(small_side(ids, 16), F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", "is_target")
    weighed = docs.select("doc_id", log_weight(log_ratios(marked, buckets)).alias("log_weight"))
    weighed = stored(weighed.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "gumbel-keys")
    n = weighed.count()
    k = min(n, round(share * n) if k is None else k)
    if not k:
        return weighed.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), F.lit(False).alias("kept"))
    edge = kth_largest(weighed.select("key"), k)
    left = k - weighed.where(F.col("key") > edge).count()
    tied = weighed.where(F.col("key") == edge).withColumn("kept", F.row_number().over(Window.partitionBy("key").orderBy("doc_id")) <= left)
    rest = weighed.where(F.col("key") != edge).withColumn("kept", F.col("key") > edge)
    return rest.union(tied).select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), "kept")
