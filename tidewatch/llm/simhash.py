"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are 64-bit majority votes over the hashes of word shingles.  The index is a tree: an upper node is a
pattern on a set of masked bits that everything below it shares, the codes below a node are sorted by Gray rank (so
neighbours differ in few bits), cut into leaves, and leaves are gathered into nodes that factor out the bits on which
all their codes agree.  A search walks pairs of nodes downwards, adds up the differences on the bits that both have
fixed, and drops the pair with all its descendants once the sum passes the radius.

The top of the tree is dealt over the cluster: with radius r the 64 bits are cut into r + 1 runs, and two codes that
differ in at most r bits agree on one whole run, so they meet below that upper node.  A node with too many codes for a
task is cut again on the bits that are still free, by the same rule; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import stored
from tidewatch.session import spread

BITS = 64
RADIUS = 3
#: Codes below one upper node before it is cut again.  It sets the grain of the tasks, not what is found.
NODE_CODES = 4096
#: Levels of upper nodes at most.  A node of the last one is searched by one task, which holds its codes only.
LEVELS = 3
LEAF, FANOUT, PAIRS_AT_ONCE = 32, 16, 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint of one text; 0 without words.  Fewer words than a shingle are one shingle."""
    words = (text or b"").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(r), seed) for r in runs], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row of ``docs``; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence: codes next to each other there differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the leaves upwards: for each node the mask of bits that all its codes share, and their values there."""
    every, some, size, out = codes, codes, LEAF, []
    while True:
        cuts = np.arange(0, len(every), size)
        every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
        mask = ~(every ^ some)
        out.append((mask, every & mask))
        if len(every) == 1:
            return out
        size = FANOUT


def near_pairs(codes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of ``codes``, sorted by Gray rank, that differ in at most ``radius`` bits."""
    if len(codes) < 2:
        return
    levels = _levels(codes)
    zero = np.zeros(1, dtype=np.int64)
    todo = [(len(levels) - 1, zero, zero, zero)]  # level, left node, right node, differences so far
    while todo:
        level, a, b, acc = todo.pop()
        mask, pattern = levels[level]
        if level == 0:
            yield from _leaf_pairs(codes, a, b, radius)
            continue
        below_mask, below = levels[level - 1]
        step = np.arange(FANOUT)
        ca = (a[:, None, None] * FANOUT + step[None, :, None] + 0 * step[None, None, :]).ravel()
        cb = (b[:, None, None] * FANOUT + 0 * step[None, :, None] + step[None, None, :]).ravel()
        up = np.repeat(np.arange(len(a)), FANOUT * FANOUT)
        ok = (ca <= cb) & (ca < len(below)) & (cb < len(below))
        ca, cb, up = ca[ok], cb[ok], up[ok]
        fresh = below_mask[ca] & below_mask[cb] & ~(mask[a] & mask[b])[up]
        now = acc[up] + np.bitwise_count((below[ca] ^ below[cb]) & fresh)
        ok = now <= radius
        ca, cb, now = ca[ok], cb[ok], now[ok]
        size = max(1, PAIRS_AT_ONCE // (FANOUT * FANOUT)) if level > 1 else PAIRS_AT_ONCE // LEAF
        todo += [(level - 1, ca[k : k + size], cb[k : k + size], now[k : k + size]) for k in range(0, len(ca), size)]


def _leaf_pairs(codes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = np.arange(LEAF)
    i, j = a[:, None] * LEAF + step, b[:, None] * LEAF + step
    left, right = codes[np.minimum(i, len(codes) - 1)], codes[np.minimum(j, len(codes) - 1)]
    for s in range(LEAF):  # one code of the left leaf against the whole right leaf
        near = (np.bitwise_count(left[:, s, None] ^ right) <= radius) & (i[:, s, None] < j) & (j < len(codes))
        p, q = np.nonzero(near)
        if len(p):
            yield i[p, s], j[p, q]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Links that keep what ``pairs`` connects together: (member, root), at most n - 1 of them."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, q in pairs:
        for x, y in zip(p.tolist(), q.tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    members = [x for x in range(n) if root[x] != x]
    return members, [find(x) for x in members]


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links among the codes below each upper node; rows come sorted by node, and only an unfinished node is carried over."""
    rest: list[np.ndarray] = []
    for b in batches:
        table = np.stack([b.column(k).to_numpy().view(np.uint64) for k in range(3)])
        ahead = rest[-1][:2, -1:] if rest else table[:2, :1]
        cuts = np.flatnonzero((np.diff(table[:2], axis=1, prepend=ahead) != 0).any(axis=0))
        if len(cuts):
            yield from _links(np.concatenate([*rest, table[:, : cuts[-1]]], axis=1), radius)
            rest = []
        rest.append(table[:, cuts[-1] if len(cuts) else 0 :])
    if rest:
        yield from _links(np.concatenate(rest, axis=1), radius)


def _links(table: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """``table``: whole nodes, as rows of mask, pattern and code."""
    codes, n = table[2], table.shape[1]
    starts = np.flatnonzero(np.concatenate([np.ones(min(n, 1), dtype=bool), (np.diff(table[:2], axis=1) != 0).any(axis=0)]))
    sizes = np.diff(np.append(starts, n))
    left = np.append(starts, n)[np.repeat(np.arange(len(starts)), sizes) + 1] - np.arange(n)  # codes from here to the node's end
    left[np.repeat(sizes > LEAF, sizes)] = 0
    found = []
    for d in range(1, LEAF):  # a node of one leaf is scanned as it is
        i = np.flatnonzero(left > d)
        if not len(i):
            break
        i = i[np.bitwise_count(codes[i] ^ codes[i + d]) <= radius]
        found.append((codes[i], codes[i + d]))
    for lo, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        own = codes[lo : lo + size]
        own = own[np.argsort(gray_rank(own), kind="stable")]
        members, roots = _forest(size, near_pairs(own, radius))
        found.append((own[members], own[roots]))
    if any(len(a) for a, _ in found):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], ["a", "b"])


def _runs(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask`` cut into ``parts`` runs."""
    free = [k for k in range(BITS - 1, -1, -1) if not mask >> k & 1]
    return [sum(1 << k for k in run) for run in np.array_split(np.array(free, dtype=object), parts) if len(run)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _below(parents: list[int], radius: int) -> dict[int, list[int]]:
    return {m: [m | run for run in _runs(m, radius + 1)] for m in parents}


def _descend(nodes: DataFrame, tree: dict[int, list[int]]) -> DataFrame:
    """Every code of ``nodes`` once below each child of its node."""
    kids = None
    for parent, masks in tree.items():
        arr = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for m in masks])
        kids = F.when(F.col("mask") == _signed(parent), arr) if kids is None else kids.when(F.col("mask") == _signed(parent), arr)
    return nodes.select("code", F.explode(kids).alias("kid")).select("kid.mask", "kid.pattern", "code")


def links(codes: DataFrame, radius: int = RADIUS, node_codes: int = NODE_CODES) -> DataFrame:
    """Links (a, b) that connect all distinct codes within ``radius`` bits of each other; ``codes`` has a column code.

    Each upper node returns a forest over its codes, not every pair: the components are those of all pairs.
    """
    found, tree = [], _below([0], radius)
    nodes = _descend(codes.select(F.lit(0).cast("long").alias("mask"), "code"), tree)
    for level in range(LEVELS):
        nodes = stored(nodes, "simhash-nodes")
        masks = [m for kids in tree.values() for m in kids]
        last = level == LEVELS - 1
        crowded = stored(nodes.groupBy("mask", "pattern").count().where(F.col("count") > node_codes).select("mask", "pattern"), "simhash-crowded")
        cut = not last and not crowded.isEmpty()
        quiet = nodes.join(crowded, ["mask", "pattern"], "left_anti") if cut else nodes
        dealt = spread(quiet, "mask", "pattern").sortWithinPartitions("mask", "pattern").select("mask", "pattern", "code")
        found.append(stored(dealt.mapInArrow(lambda batches: _search(batches, radius), "a long, b long"), "simhash-links"))
        if not cut:
            break
        tree = _below(masks, radius)
        nodes = _descend(nodes.join(crowded, ["mask", "pattern"], "left_semi"), tree)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node and root of every node of ``edges`` (a, b): alternating large and small stars until nothing moves.

    A star with very many members is met by one row per member and a combined minimum, never by one group.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v"), F.col("v")).distinct())
        before = mark
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = stored(moved.union(least).distinct(), "stars")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3, node_codes: int = NODE_CODES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of every row of ``docs``.

    Null, empty and blank texts have fingerprint 0 and are linked like any other.  Equal texts and repeated rows share a
    fingerprint and a component.  A null doc_id is reached but never names a component, unless all of it are null.
    An empty table gives no rows; other columns are not read.
    """
    prints = stored(with_fingerprints(docs, shingle), "simhash-prints")
    classes = prints.groupBy("code").agg(F.min("doc_id").alias("rep"))
    roots = stored(connected(links(classes.select("code"), radius, node_codes)), "simhash-roots")
    linked = classes.join(roots, classes.code == roots.node).select("code", "rep", "root")
    named = linked.groupBy("root").agg(F.min("rep").alias("first"))
    groups = classes.join(linked.select("code", "root"), "code", "left").join(named, "root", "left")
    groups = stored(groups.select("code", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("first")).alias("component_id")), "simhash-groups")
    return prints.join(groups, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component: one document of each group stays.

    Rows that share a doc_id are one document and stay or go together, and stay where one of their texts names a
    component.  A row without a doc_id stays.
    """
    groups = near_duplicates(docs, radius).groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("names"))
    gone = groups.where("NOT names").select("_gone")
    return docs.join(gone, docs.doc_id == gone._gone, "left_anti")
