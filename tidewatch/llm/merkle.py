"""Merkle manifest of a table, with proofs handed out by a butterfly exchange.

Leaves are numbered within their group (a source), and runs of FANOUT^LEVELS of them, which lie in one task, are hashed to a
block root.  Blocks then swap roots in rounds: in round r the blocks at the same place of FANOUT neighbouring, aligned
subtrees of FANOUT^r blocks meet, and each of them hashes the parent for itself, so after the last round every block
knows its whole upper path and the group's root without a pass back down.  A meeting has FANOUT members at most,
however large a group is, and all places meet at the same time, so a group with a third of all rows is spread like any
other.  A last subtree with fewer places sends its root several times, once to each place that waits for it.  The
groups' roots go through the same exchange, ordered by group, up to the table's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.common import LOWER, UPPER, small_side, stored

FANOUT = 16
#: Levels that are hashed within a block.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def in_order(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` written in order of ``keys``, with ``nth`` that rises along them; equal keys may be parted."""
    return stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("nth", F.monotonically_increasing_id()), name)


def placed(rows: DataFrame, group: str, name: str) -> DataFrame:
    """``rows`` (of ``in_order``, first by ``group``) with place, from 0 within the group, and total.

    A group's rows in a written partition are neighbours, so a place is the distance to the run's first row and the
    length of the runs before; that table of runs has a row for each group and partition that meet.
    """
    part = F.shiftright("nth", 33)
    runs = rows.groupBy(group, part.alias("part")).agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before, whole = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    runs = runs.select(group, "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    bytes_ = 64 + (rows.agg(F.max(F.octet_length(F.col(group).cast("string")))).first()[0] or 0)
    found = rows.withColumn("part", part).join(small_side(stored(runs, name), bytes_), [group, "part"])
    return found.withColumn("place", F.col("nth") - F.col("first") + F.col("before")).drop("part", "nth", "first", "before")


def butterfly(nodes: DataFrame, group: str, rounds: int) -> DataFrame:
    """group, place, total, digest (the root) and path for each of ``nodes`` (group, place, total, digest).

    ``path`` has, from below, the run of digests that a node's subtree belongs to in each round, and its index there.
    A group of fewer nodes is done sooner and keeps its digest; ``rounds`` is the height of the largest.
    """
    state = nodes.select(group, "place", "total", "digest", F.array().cast("array<struct<own:int,run:array<string>>>").alias("path"))
    for r in range(rounds):
        size, wide = FANOUT**r, FANOUT ** (r + 1)
        q = F.expr(f"place % {size}")
        own_places = F.expr(f"least({size}, total - place div {size} * {size})")
        all_places = F.expr(f"least({size}, total - place div {wide} * {wide})")
        sent = state.withColumn("to", F.explode(F.sequence(q, all_places - 1, own_places)))  # the last subtree may have fewer places
        index = F.expr(f"cast(place div {size} % {FANOUT} as int)")
        member = F.when(F.col("to") == F.expr(f"place % {size}"), F.struct("place", index.alias("own"), "path"))
        met = sent.groupBy(group, "total", F.expr(f"place div {wide}").alias("above"), "to").agg(
            F.sort_array(F.collect_list(F.struct(index.alias("own"), "digest"))).alias("run"), F.collect_list(member).alias("members"))
        met = met.select(group, "total", F.col("run.digest").alias("run"), F.explode("members").alias("m"))
        more = F.col("total") > size
        state = met.select(
            group, F.col("m.place").alias("place"), "total",
            F.when(more, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("run")[0]).alias("digest"),
            F.when(more, F.concat("m.path", F.array(F.struct(F.col("m.own").alias("own"), "run")))).otherwise(F.col("m.path")).alias("path"),
        )
    return state


def height(total: int | None) -> int:
    """Rounds until one node of ``total`` remains."""
    n, rounds = total or 0, 0
    while n > 1:
        n, rounds = -(-n // FANOUT), rounds + 1
    return rounds


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _levels(leaves: list[str], total: int, levels: int) -> list[list[str]]:
    """Digests of a block, level by level up to its root; a block that is its whole group stops at one node."""
    out = [leaves]
    while len(out[-1]) > 1 if total <= FANOUT**levels else len(out) <= levels:
        below = out[-1]
        out.append([_hash("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)])
    return out


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block after another, from batches sorted by (grp, block); only the open block is held."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(batch["grp"].to_pylist(), batch["block"].to_pylist()))
        a = 0
        for k in range(len(keys) + 1):
            if k == len(keys) or keys[k] != key:
                if k > a:
                    held.append(batch.slice(a, k - a))
                if k < len(keys):
                    if held:
                        yield pa.Table.from_batches(held)
                    held, key, a = [], keys[k], k
    if held:
        yield pa.Table.from_batches(held)


def _roots(levels: int):
    """Function over sorted leaves: a block's root, and how many blocks its group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "place", "total", "digest"]
        for block in _by_block(batches):
            total = block["total"][0].as_py()
            root = _levels(block["leaf"].to_pylist(), total, levels)[-1][0]
            blocks = -(-total // FANOUT**levels)
            yield pa.RecordBatch.from_arrays([pa.array([block["grp"][0].as_py()]), pa.array([block["block"][0].as_py()], pa.int64()), pa.array([blocks], pa.int64()), pa.array([root])], names)

    return run


def _folded(levels: int, with_siblings: bool):
    """Function over sorted rows, a block's path first and then its leaves: proofs, and the root folded from ``seen``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            head = {c: block[c][0].as_py() for c in ("total", "path", "subroot", "root")}
            own = block.slice(1)
            leaves, seen = own["leaf"].to_pylist(), own["seen"].to_pylist()
            joined = [["".join(x[k : k + FANOUT]) for k in range(0, len(x), FANOUT)] for x in _levels(leaves, head["total"], levels)[:-1]]
            above = [("".join(p["run"]), p["own"]) for p in head["path"]]
            proofs, folded, lists = [], [], []
            for i, now in enumerate(seen):
                digest, siblings, k = hashlib.sha256(), [], i
                steps = [(runs[i // FANOUT ** (h + 1)], i // FANOUT**h % FANOUT) for h, runs in enumerate(joined)]
                for together, k in (*steps, *above):
                    left, right = together[: 64 * k], together[64 * k + 64 :]
                    digest.update((left + right).encode("ascii"))
                    now = _hash(left + now + right)
                    if with_siblings:
                        siblings.append(left + right)
                proofs.append(digest.hexdigest())
                folded.append(now)
                lists.append([[x[j : j + 64] for j in range(0, len(x), 64)] for x in siblings])
            many = own.num_rows
            out = {**{c: own[c].combine_chunks() for c in ("doc_id", "leaf", "seen")}, "subroot": pa.array([head["subroot"]] * many), "root": pa.array([head["root"]] * many),
                   "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded)}
            if with_siblings:
                out["siblings"] = pa.array(lists, pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", seen: dict[str, Column] | None = None, siblings: bool = False, levels: int = LEVELS) -> DataFrame:
    """A row per document: doc_id (the column ``order``), leaf, seen, subroot, root, proof_sha256, folded_root, verified; siblings on demand.

    A leaf hashes ``fields``.  ``seen`` replaces some of them by what a reader got, which is folded with the original
    siblings: verified says whether that gives the root.  ``siblings`` adds the proof itself, a list of digests for each
    level; ``levels`` of them are hashed within a block.  Leaves of a group rise by ``order``, null first, equal ones by leaf, so repeated rows are neighbours; null
    is a group of its own and comes first.  A text may be null, empty or as long as a row can be, only digests are
    moved.  An empty table gives no rows.  Other columns aren't read, so they can't clash.
    """
    values = {c: F.col(c) for c in fields}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("grp"), F.col(order).alias("doc_id"),
        leaf(*values.values()).alias("leaf"), leaf(*(values | (seen or {})).values()).alias("seen"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = in_order(stored(rows, "leaves"), "leaves", "grp", "doc_id", "leaf", "seen", "uid").drop("uid")
    rows = stored(placed(rows, "grp", "runs").withColumn("block", F.expr(f"place div {FANOUT**levels}")), "places")
    key = F.col("grp"), F.col("block")
    by_block = rows.select("grp", "block", "place", "total", "leaf").repartition(*key).sortWithinPartitions("grp", "block", "place")
    blocks = stored(by_block.mapInArrow(_roots(levels), "grp string, place long, total long, digest string"), "blocks")
    paths = stored(butterfly(blocks, "grp", height(blocks.agg(F.max("total")).first()[0])), "paths")

    tops = in_order(paths.where("place = 0").select("grp", F.col("digest").alias("subroot")), "groups", "grp").withColumn("every", F.lit(1))
    tops = stored(placed(tops, "every", "runs"), "groups")
    up = butterfly(tops.withColumnRenamed("subroot", "digest"), "every", height(tops.agg(F.max("total")).first()[0]))
    up = tops.select("grp", "place", "subroot").join(up.select("place", F.col("path").alias("top"), F.col("digest").alias("root")), "place").drop("place")
    heads = paths.join(up, "grp").select("grp", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.concat("path", "top").alias("path"), "subroot", "root")
    heads = stored(heads, "heads")
    size = rows.groupBy("grp", "total").agg(F.lit(1).alias("one")).select("grp", "total")
    heads = heads.join(size, "grp")

    both = rows.unionByName(heads, allowMissingColumns=True)
    both = both.select("grp", "block", "place", "total", "doc_id", "leaf", "seen", "path", "subroot", "root").repartition(*key).sortWithinPartitions("grp", "block", "place")
    kind = docs.schema[order].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, seen string, subroot string, root string, proof_sha256 string, folded_root string" + (", siblings array<array<string>>" if siblings else "")
    return both.mapInArrow(_folded(levels, siblings), schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(text: Column, doc_id: Column) -> Column:
    """Where 5 divides the checksum of the decimal id, the text with A-Z lower-cased, else the text; a null id leaves it."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)
