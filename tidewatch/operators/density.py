"""Topics as density clusters: neighbour graph, spanning forest, condensed tree, outliers, term weights.

Vectors are sorted by the signs of random projections, several times, and every window of such an order is searched as
one dense block, so a bucket of any size is cut into windows and no task holds more than one.  The neighbour graph gets
mutual-reachability distances; Boruvka rounds (joins of components with their lightest edge out) leave a spanning
forest; its merges, light edges first, give the condensed tree in which a cluster is a component of ``min_size`` points
or more.  The most stable clusters that don't hold each other are the topics, everything else is the outlier topic -1.
They are chosen on the way: a merge knows the best choice within each side, and pointer jumping over the levels of the
tree tells a cluster which chosen one holds it, so the tree may have any number of clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.session import spread, written

#: Rows of a window of the sorted order; windows overlap by half.
WINDOW = 256
#: Edges of a level of the condensed tree: what one task merges at most.  Each level joins all points once, so few are wanted.
LEVEL_EDGES = 800_000
OUTLIER = -1


def hashed_vectors(posts: DataFrame, key: str, text: str = "clean_text", dims: int = 64) -> DataFrame:
    """``key`` and ``embedding``: log counts of words hashed to ``dims`` slots, scaled to length 1; texts without words have none.

    Counts and length go through a generator each: a filter or a second use would run the tokenizer, or the sum, again.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+", minTokenLength=1)
    rows = posts.where(F.col(text).isNotNull()).select(key, text)
    counts = Pipeline(stages=[words, HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims)]).fit(rows).transform(rows)
    log = counts.select(key, F.explode(F.array(F.transform(vector_to_array("_tf"), lambda v: F.log1p(v)))).alias("_v"))
    size = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + v * v))
    sized = log.select(key, "_v", F.explode(F.array(size)).alias("_n"))
    return sized.where("_n > 0").select(key, F.transform("_v", lambda v: v / F.col("_n")).alias("embedding"))


def _sorted_copies(tables: int, dims: int, seed: int):
    """Each vector once per table with its place in that table's order: the signs of 16 projections, then one more projection.

    ``x`` goes on as the bytes of its doubles, which Spark copies as they are.
    """
    planes = np.random.default_rng(seed).standard_normal((tables, dims, 17))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            for t in range(tables):
                p = x @ planes[t]
                code = ((p[:, :16] > 0) @ (1 << np.arange(15, -1, -1))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(code), pa.array(p[:, 16]), batch.column(0), packed], ["t", "code", "p", "id", "x"])

    return run


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` least values of each row; of equal values the first columns.  In no order."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    tied = np.flatnonzero((d <= np.take_along_axis(d, near[:, k - 1 :], axis=1)).sum(axis=1) > k)
    near[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return near


def _searched(k: int, dims: int):
    """The ``k`` nearest of each row within its windows, two at most; only the open window is held."""

    def best(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest of each row; a place that isn't taken is infinitely far."""
        norms = np.square(x).sum(axis=1)
        d = np.maximum(norms[:, None] + norms - 2 * x @ x.T, 0.0)
        d[ids[:, None] == ids] = np.inf  # where one order ends and the next begins a row may be there twice
        near = _nearest(d, min(k, len(ids) - 1))
        exact = np.sqrt(np.square(x[:, None] - x[near]).sum(axis=2))
        return ids[near], np.where(ids[near] == ids[:, None], np.inf, exact)

    def both(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of two windows' lists for the same rows, each neighbour once."""
        nb, d = np.concatenate([one[0], two[0]], axis=1), np.concatenate([one[1], two[1]], axis=1)
        order = np.lexsort((nb, d), axis=1)
        nb, d = np.take_along_axis(nb, order, axis=1), np.take_along_axis(d, order, axis=1)
        d[:, 1:][(nb[:, 1:] == nb[:, :-1]) & (d[:, 1:] == d[:, :-1])] = np.inf
        return nb, np.where(np.cumsum(np.isfinite(d), axis=1) <= k, d, np.inf)

    def out(ids: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        own, at = np.nonzero(np.isfinite(found[1]))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(found[0][own, at]), pa.array(found[1][own, at])], ["id", "nb", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, fresh, half = np.zeros(0, dtype=np.int64), np.zeros((0, dims)), False, WINDOW // 2
        held = None  # what the window before found for the first rows of the open one
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            x = np.concatenate([x, np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, dims)])
            fresh = True
            while len(ids) >= WINDOW:
                nb, d = best(ids[:WINDOW], x[:WINDOW])
                first = (nb[:half], d[:half])
                yield out(ids[:half], first if held is None else both(held, first))
                held = (nb[half:], d[half:])
                ids, x, fresh = ids[half:], x[half:], len(ids) > WINDOW
        if fresh and len(ids) > 1:
            nb, d = best(ids, x)
            if held is not None:
                n = len(held[0])
                yield out(ids[:n], both(held, (nb[:n], d[:n])))
                ids, nb, d = ids[n:], nb[n:], d[n:]
            yield out(ids, (nb, d))
        elif held is not None:
            yield out(ids, held)

    return run


def neighbours(vectors: DataFrame, k: int = 10, tables: int = 8, seed: int = 7) -> DataFrame:
    """id, nb, d: the ``k`` nearest that the windows of ``tables`` orders show, of ``vectors`` (id long, x array<double>).

    What the orders found meets by id in one shuffle.
    """
    first = vectors.select(F.size("x")).first()
    dims = first[0] if first else 1
    copies = vectors.select("id", "x").mapInArrow(_sorted_copies(tables, dims, seed), "t int, code long, p double, id long, x binary")
    order = copies.repartitionByRange("t", "code", "p", "id").sortWithinPartitions("t", "code", "p", "id")
    found = order.select("id", "x").mapInArrow(_searched(k, dims), "id long, nb long, d double").repartition("id").groupBy("id", "nb").agg(F.min("d").alias("d"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "nb"))
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def neighbour_recall(vectors: DataFrame, found: DataFrame, every: int = 50) -> float:
    """Share of the true neighbours that ``found`` has, for the ids divisible by ``every`` against all vectors, in blocks."""
    k = found.groupBy("id").count().agg(F.max("count")).first()[0]
    asked = vectors.where(F.col("id") % every == 0).orderBy("id").limit(2000).toArrow()
    q, ids = np.array(asked["x"].to_pylist(), dtype=float), asked["id"].to_numpy()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, q.shape[1])
            d = np.square(q).sum(axis=1)[:, None] + np.square(x).sum(axis=1) - 2 * q @ x.T
            d[ids[:, None] == own] = np.inf
            near = np.argsort(d, axis=1)[:, :k]
            at = np.repeat(np.arange(len(ids)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(own[near.ravel()]), pa.array(d[at, near.ravel()])], ["id", "nb", "d"])

    true = vectors.select("id", "x").mapInArrow(block, "id long, nb long, d double").where("d < double('inf')")
    true = true.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("d", "nb"))).where(F.col("_r") <= k)
    both = true.select("id", "nb").join(found.select("id", "nb", F.lit(1).alias("hit")), ["id", "nb"], "left")
    return float(both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0])


def reachability(found: DataFrame) -> DataFrame:
    """a < b, w: each pair of neighbours once, with the largest of their distance and their two core distances."""
    core = found.groupBy("id").agg(F.max("d").alias("core"))
    pairs = found.select(F.least("id", "nb").alias("a"), F.greatest("id", "nb").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    pairs = pairs.join(core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
    return pairs.select("a", "b", F.greatest("d", "ca", "cb").alias("w"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, w) of the minimum spanning forest, and id, comp (smallest id of its tree) of every end.

    A round takes each component's lightest edge out, ties by (a, b), so no cycle arises but two components that take
    the same edge; the smaller one of those is the root, and the others find theirs by pointer jumping.
    """
    edges = written(edges, "density")
    comp = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")), "density")
    left = edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    forest = edges.limit(0)

    def through(pairs: DataFrame, roots: DataFrame, column: str) -> DataFrame:
        """``pairs`` with the component in ``column`` replaced by what it points to."""
        return pairs.join(roots.select(F.col("c").alias(column), F.col("to").alias("_to")), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    while not left.isEmpty():
        ends = left.select("a", "b", "w", F.inline(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("to")))))
        hooks = written(ends.groupBy("c").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("c", "e.*"), "density")
        forest = forest.unionByName(hooks.select("a", "b", "w").distinct())
        back = hooks.select(F.col("c").alias("to"), F.col("to").alias("back"))
        roots = hooks.select("c", "to").join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        while True:  # each step doubles how far up a component points, twice
            twice = through(roots, roots, "to")
            roots = written(through(twice.withColumn("before", F.col("to")), twice, "to"), "density")
            settled = roots.where("before <> to").isEmpty()
            roots = roots.select("c", "to")
            if settled:
                break
        comp = written(through(comp, roots, "comp"), "density")
        left = written(through(through(left, roots, "ca"), roots, "cb").where("ca <> cb"), "density")
    return forest, comp


def _merged(min_size: int, level: int):
    """Merges of one component within a level, light edges first: its nodes' new place, the clusters that end, what stays open.

    A cluster has ended when another begins above it, so the stability of the best choice within (``inner``) is known
    as it begins.  ``held`` is the highest cluster of the level at or above one that is no less stable than that; all
    of them lie below ``top``, which stays open.
    """

    def run(key: tuple, edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes, edges = nodes.sort_values("node"), edges.sort_values(["w", "a", "b"])
        ids = nodes.node.to_numpy()
        size, total, inner, cluster = nodes["size"].tolist(), nodes.total.tolist(), nodes.inner.tolist(), nodes.cluster.tolist()
        up, given = list(range(len(ids))), [None] * len(ids)
        after, last = [-1] * len(ids), list(range(len(ids)))  # nodes without a cluster yet, as chains that begin at their root
        ended = []

        def find(n):
            while up[n] != n:
                up[n] = up[up[n]]
                n = up[n]
            return n

        def give(n, name):
            while n >= 0:
                given[n], n = name, after[n]

        ends = zip(np.searchsorted(ids, edges.na.to_numpy()).tolist(), np.searchsorted(ids, edges.nb.to_numpy()).tolist(), edges.w.tolist())
        for k, (a, b, w) in enumerate(ends):
            a, b, density = find(a), find(b), 1.0 / max(w, 1e-12)
            if size[a] < size[b]:
                a, b = b, a
            name = f"{level}.{key[0]}.{k}"
            if cluster[a] is not None and cluster[b] is not None:  # two clusters part here, seen from above
                ended += [(cluster[c], name, size[c], total[c] - size[c] * density, inner[c]) for c in (a, b)]
                cluster[a], total[a], inner[a] = name, (size[a] + size[b]) * density, sum(max(e[3:]) for e in ended[-2:])
            elif cluster[a] is not None:
                total[a] += size[b] * density
                give(b, cluster[a])
            else:
                after[last[a]], last[a] = b, last[b]
                if size[a] + size[b] >= min_size:
                    cluster[a], total[a] = name, (size[a] + size[b]) * density
                    give(a, name)
            size[a] += size[b]
            up[b] = a
        top, held = find(0), {}
        for name, parent, _, stability, within in reversed(ended):  # what is above ends later
            held[name] = held.get(parent) or (name if stability >= within else None)
        out = [("cluster", None, *e, held[e[0]], cluster[top]) for e in ended]
        out.append(("open", int(key[0]), cluster[top], None, size[top], 0.0 if cluster[top] is None else total[top], inner[top], None, None))
        made = pd.DataFrame(out, columns=["kind", "node", "cluster", "parent", "size", "stability", "inner", "held", "top"]).astype({"node": "Int64"})
        kept = pd.DataFrame({"kind": "node", "node": pd.array(ids, dtype="Int64"), "cluster": given, "parent": None, "size": 0, "stability": 0.0, "inner": 0.0, "held": None, "top": None})
        return pd.concat([made, kept]).assign(comp=key[0])

    return run


def condensed(forest: DataFrame, trees: DataFrame, points: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """id, cluster of all ``points`` (id) and the clusters: cluster, parent, size, stability, inner, held, top (see ``_merged``).

    ``trees`` has the forest's components.  The forest's edges go in levels of at most about LEVEL_EDGES by weight.  What
    a level joins is one node of the next, with its size, its cluster, that cluster's sum of densities and the best choice
    within, so a task merges a level's edges of one component and no more.
    """
    forest = written(forest, "density")
    n = forest.count()
    steps = max(1, math.ceil(n / LEVEL_EDGES))
    bounds = [-1.0, *(forest.approxQuantile("w", [k / steps for k in range(1, steps)], 0.01) if steps > 1 else []), float("inf")]
    places = points.select("id", F.col("id").alias("node"), F.lit(None).cast("string").alias("cluster"))
    state = points.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("cluster"), F.lit(0.0).alias("total"), F.lit(0.0).alias("inner"))
    clusters = None
    for level, (low, high) in enumerate(zip(bounds, bounds[1:])):
        now = forest.where((F.col("w") > low) & (F.col("w") <= high))
        for side, name in (("a", "na"), ("b", "nb")):
            now = now.join(places.select(F.col("id").alias(side), F.col("node").alias(name)), side)
        now = written(now, "density")
        comp = trees if steps == 1 else spanning_forest(now.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "w"))[1]
        comp = comp.withColumnRenamed("id", "node")
        edges = spread(now.join(comp.withColumnRenamed("node", "na"), "na").select("comp", "a", "b", "na", "nb", "w"), "comp")
        nodes = spread(state.join(comp, "node").select(F.col("comp").alias("own"), "node", "size", "cluster", "total", "inner"), "own")
        schema = "kind string, node long, cluster string, parent string, size long, stability double, inner double, held string, top string, comp long"
        out = written(edges.groupBy("comp").cogroup(nodes.groupBy("own")).applyInPandas(_merged(min_size, level), schema), "density")
        ended = out.where("kind = 'cluster'").select("cluster", "parent", "size", "stability", "inner", "held", "top")
        clusters = ended if clusters is None else clusters.unionByName(ended)
        moved = out.where("kind = 'node'").select("node", F.col("comp").alias("to"), F.col("cluster").alias("given"))
        places = written(places.join(moved, "node", "left").select("id", F.coalesce("to", "node").alias("node"), F.coalesce("cluster", "given").alias("cluster")), "density")
        still = state.join(comp, "node", "left_anti").select("node", "size", "cluster", "total", "inner")
        state = written(still.unionByName(out.where("kind = 'open'").select("node", "size", "cluster", F.col("stability").alias("total"), "inner")), "density")
    none = F.lit(None).cast("string")
    roots = state.where("cluster IS NOT NULL").select("cluster", none.alias("parent"), "size", F.col("total").alias("stability"), "inner", F.when(F.col("total") >= F.col("inner"), F.col("cluster")).alias("held"), none.alias("top"))
    return places.select("id", "cluster"), clusters.unionByName(roots)


def chosen(clusters: DataFrame) -> DataFrame:
    """cluster, topic: the chosen cluster that holds it, for each cluster that has one.

    A cluster is chosen if it is at least as stable as the best choice within it and nothing above it is chosen; the
    only root isn't a topic but everything.  Each round doubles the levels that ``held`` and ``top`` look up.
    """
    clusters = written(clusters, "density")
    if clusters.where("parent IS NULL").limit(2).count() == 1:
        clusters = clusters.withColumn("held", F.when(F.col("parent").isNotNull(), F.col("held")))
    now = clusters.select("cluster", "held", "top")
    while not now.where("top IS NOT NULL").isEmpty():
        above = now.select(F.col("cluster").alias("top"), F.col("held").alias("_held"), F.col("top").alias("_top"))
        up = now.join(above, "top").select("cluster", F.coalesce("_held", "held").alias("held"), F.col("_top").alias("top"))
        now = written(now.where("top IS NULL").unionByName(up), "density")
    return now.where("held IS NOT NULL").select("cluster", F.col("held").alias("topic"))


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """``rows`` with their place by ``order`` as ``name``, from 0: the place within a sorted partition and the rows of those before."""
    placed = written(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "density")
    part = F.shiftright("_m", 33)
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    starts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", F.coalesce(before, F.lit(0)).alias("_s"))
    return placed.withColumn("_p", part).join(starts, "_p").withColumn(name, F.col("_s") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_m", "_s")


def density_topics(vectors: DataFrame, key: str, vector: str = "embedding", min_size: int = 10, k: int = 10, tables: int = 8, seed: int = 7) -> DataFrame:
    """``key`` and topic_id (0 for the largest topic, -1 for outliers) of every row of ``vectors``.

    Rows whose vector is null or holds a null or non-finite entry are outliers; repeated rows are points of their own;
    a null key is kept.  An empty table gives no rows.  Vectors are of one length.
    """
    usable = F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    rows = written(vectors.select(F.monotonically_increasing_id().alias("id"), F.col(key), F.when(usable, F.col(vector).cast("array<double>")).alias("x")), "density")
    points = rows.where("x IS NOT NULL").select("id", "x")
    forest, trees = spanning_forest(reachability(written(neighbours(points, k, tables, seed), "density")))
    places, clusters = condensed(forest, trees, points, min_size)
    held = chosen(clusters)
    sizes = places.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    sizes = sizes.join(held, "cluster").groupBy("topic").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    ids = numbered(sizes, "topic_id", F.desc("n"), "first").select("topic", F.col("topic_id").cast("int").alias("topic_id"))
    labels = places.join(held.join(ids, "topic").select("cluster", "topic_id"), "cluster").select("id", "topic_id")
    return rows.select("id", key).join(labels, "id", "left").select(key, F.coalesce("topic_id", F.lit(OUTLIER)).alias("topic_id"))


def topic_terms(posts: DataFrame, text: str = "clean_text", topic: str = "topic_id", top: int = 10) -> DataFrame:
    """topic_id, word, n, weight: the ``top`` words of each topic by n * ln(1 + mean words of a topic / uses of the word).

    A topic's posts are one class; outliers are one too, as their words count in the background.
    """
    words = posts.select(F.col(topic).alias("topic_id"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)(\w+)"), 1)).alias("word"))
    n = written(words.groupBy("topic_id", "word").agg(F.count("*").alias("n")), "density")
    uses = n.groupBy("word").agg(F.sum("n").alias("uses"))
    mean = n.groupBy("topic_id").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0] or 0.0
    weighed = n.join(uses, "word").withColumn("weight", F.col("n") * F.log1p(F.lit(float(mean)) / F.col("uses")))
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "word"))
    return weighed.withColumn("_r", place).where(F.col("_r") <= top).select("topic_id", "word", "n", "weight")
