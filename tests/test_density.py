"""Density topics against a plain top-down clustering of the complete graph."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewatch.operators import density, topics


def ari(a, b):
    """Adjusted Rand index."""
    pairs = lambda n: n * (n - 1) / 2
    _, ia = np.unique(a, return_inverse=True)
    _, ib = np.unique(b, return_inverse=True)
    table = np.zeros((ia.max() + 1, ib.max() + 1))
    np.add.at(table, (ia, ib), 1)
    both, sa, sb, n = pairs(table).sum(), pairs(table.sum(axis=1)).sum(), pairs(table.sum(axis=0)).sum(), pairs(len(a))
    want = sa * sb / n
    return (both - want) / ((sa + sb) / 2 - want)


def plain(x, k, m):
    """Clusters of all points: complete mutual-reachability graph, spanning tree, split from the top."""
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, k - 1]
    r = np.maximum(d, np.maximum(core[:, None], core))
    tree, inside, best, frm = [], [0], r[0].copy(), np.zeros(len(x), dtype=int)
    best[0] = np.inf
    done = np.zeros(len(x), dtype=bool)
    done[0] = True
    for _ in range(len(x) - 1):
        j = int(np.argmin(np.where(done, np.inf, best)))
        tree.append((best[j], int(frm[j]), j))
        done[j] = True
        closer = r[j] < best
        frm[closer], best = j, np.minimum(best, r[j])
    label = np.full(len(x), -1)

    def parts(points, edges):
        up = {p: p for p in points}

        def find(p):
            while up[p] != p:
                p = up[p]
            return p

        for _, a, b in edges:
            up[find(a)] = find(b)
        out = {}
        for p in points:
            out.setdefault(find(p), []).append(p)
        return list(out.values())

    def walk(points, edges, birth):
        """(stability of the best choice, clusters chosen) of a cluster."""
        stability, edges = 0.0, sorted(edges)
        start = list(points)
        while True:
            if not edges:
                return stability, [start]
            w, *_ = edges[-1]
            edges = edges[:-1]
            two = parts(points, edges)
            big = [p for p in two if len(p) >= m]
            stability += (1 / w - birth) * (sum(len(p) for p in two) if len(big) != 1 else sum(len(p) for p in two if len(p) < m))
            if len(big) == 1:
                points = big[0]
                held = set(points)
                edges = [e for e in edges if e[1] in held]
            elif not big:
                return stability, [start]
            else:
                inner = [walk(p, [e for e in edges if e[1] in set(p)], 1 / w) for p in big]
                if birth and stability >= sum(s for s, _ in inner):
                    return stability, [start]
                return sum(s for s, _ in inner), [c for _, cs in inner for c in cs]

    found = walk(list(range(len(x))), tree, 0.0)[1]
    for n, c in enumerate(found if len(found) > 1 else []):
        label[c] = n
    return label


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 6
    x = np.vstack([c + rng.normal(size=(n, 8)) * s for c, n, s in zip(centres, (90, 70, 60, 50, 40, 30), (0.5, 0.7, 0.4, 0.6, 0.5, 0.3))] + [rng.uniform(-14, 14, (40, 8))])
    return x, np.repeat(np.arange(7), (90, 70, 60, 50, 40, 30, 40))


def run(spark, x, **more):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    return np.array([r.topic_id for r in density.density_topics(df, "vec_id", **more).orderBy("vec_id").collect()])


def test_equals_plain_clustering(spark, blobs, monkeypatch):
    x, truth = blobs
    got = run(spark, x)
    assert ari(got, plain(x, 10, 10)) > 0.95 and ari(got[truth < 6], truth[truth < 6]) > 0.95
    assert 10 < (got == -1).sum() < 80 and sorted(set(got)) == [-1, 0, 1, 2, 3, 4, 5] and np.bincount(got[got >= 0]).tolist() == sorted(np.bincount(got[got >= 0]), reverse=True)
    monkeypatch.setattr(density, "LEVEL_EDGES", 200)  # the same tree when it is merged in two levels
    assert ari(run(spark, x), got) == 1.0


def walked(clusters):
    """Cluster -> the chosen cluster that holds it, by a plain walk of the tree."""
    below, score, own, out = {}, {}, set(), {}
    for r in clusters:
        below.setdefault(r.parent, []).append(r)

    def up(r):
        inner = sum(up(c) for c in below.get(r.cluster, []))
        if r.stability >= inner and (r.parent or len(below[None]) > 1):
            own.add(r.cluster)
        score[r.cluster] = max(r.stability, inner)
        return score[r.cluster]

    def down(r, held):
        held = held or (r.cluster if r.cluster in own else None)
        out.update({r.cluster: held} if held else {})
        for c in below.get(r.cluster, []):
            down(c, held)

    for r in below.get(None, []):
        up(r)
        down(r, None)
    return out


@pytest.mark.parametrize("cut", [800_000, 40])
@pytest.mark.parametrize("gap", [0.0, 1000.0])
def test_choice_follows_the_tree(spark, monkeypatch, cut, gap):
    """Clusters of one and of several trees, in one level and in many, without a look at the whole tree by the driver."""
    monkeypatch.setattr(density, "LEVEL_EDGES", cut)
    rng = np.random.default_rng(8)
    at = np.sort(rng.integers(0, 400, 120) / 4 + np.where(np.arange(120) < 50, 0, gap))  # many equal weights
    edges = [(n, n + 1, float(at[n + 1] - at[n])) for n in range(119) if at[n + 1] - at[n] < 500]
    forest, trees = density.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"))
    places, clusters = density.condensed(forest, trees, spark.range(120), 3)
    found = clusters.collect()
    got = {r.cluster: r.topic for r in density.chosen(clusters).collect()}
    assert len(found) > 10 and sum(r.parent is None for r in found) == (2 if gap else 1) and got == walked(found)
    assert len(set(got.values())) > 2 and places.count() == 120


def test_topics_do_not_depend_on_the_size_of_the_table(spark, blobs, monkeypatch):
    """A topic has ``min_size`` points or more, whatever number of points or clusters there is."""
    sizes, condensed = [], density.condensed
    monkeypatch.setattr(density, "MOST_CLUSTERS", 10, raising=False)  # a bound that this small table would be over
    monkeypatch.setattr(density, "condensed", lambda forest, trees, points, min_size: sizes.append(min_size) or condensed(forest, trees, points, min_size))
    x = np.vstack([blobs[0], np.random.default_rng(2).normal(size=(12, 8)) * 0.1 + 40])
    got = run(spark, x)
    assert sizes == [10] and len(set(got[-12:])) == 1 and got[-1] > 0 and (got == got[-1]).sum() == 12


def test_places_are_counted_over_all_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7 % 11).alias("n"), F.col("id").alias("first"))
    got = rows(density.numbered(df.repartition(5), "at", F.desc("n"), "first"), "at", "n", "first")
    assert got == sorted(((k, n, f) for k, (n, f) in enumerate(sorted(((k * 7 % 11, k) for k in range(500)), key=lambda r: (-r[0], r[1])))), key=repr)
    assert density.numbered(df.limit(0), "at", "n").collect() == []


def test_forest_is_minimal(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(60, 120, 200), rng.integers(1, 9, 200))]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values()) + [(500, 501, 1.0)]
    forest, comp = density.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"))
    up = {}

    def find(p):
        while up.setdefault(p, p) != p:
            p = up[p]
        return p

    want = 0.0
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want += w
    got = forest.collect()
    assert sum(r.w for r in got) == want and len(got) == len({(r.a, r.b) for r in got}) == len(up) - len({find(p) for p in up})
    names = {r.id: r.comp for r in comp.collect()}
    assert names.keys() == up.keys() and all((names[p] == names[q]) == (find(p) == find(q)) for p in up for q in up)


def test_neighbours_and_recall(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    v = density.hashed_vectors(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("embedding").alias("x")).cache()
    found = density.neighbours(v).cache()
    assert found.groupBy("id").count().where("count <> 10").count() == 0 and found.where("id = nb").count() == 0
    assert density.neighbour_recall(v, found) >= 0.9


def test_edges(spark):
    same = [(k, [1.0, 2.0]) for k in range(700)]  # more copies than a window holds
    bad = [(None, None), (9, [float("nan"), 1.0]), (10, [None, 1.0]), (11, [float("inf"), 0.0])]
    df = spark.createDataFrame(same + bad + [(k, [50.0 + k % 7, -3.0]) for k in range(1000, 1100)], "vec_id long, embedding array<double>")
    got = density.density_topics(df, "vec_id", tables=2).collect()
    assert len(got) == 804 and all(r.topic_id == -1 for r in got if r.vec_id in (None,))
    assert {r.topic_id for r in got if r.vec_id is not None and 20 <= r.vec_id < 700} == {0}
    assert density.density_topics(df.limit(0), "vec_id").collect() == []
    assert {r.topic_id for r in density.density_topics(df.limit(3), "vec_id").collect()} == {-1}


def test_terms_and_features(spark):
    posts = spark.createDataFrame([(0, "cat cat dog"), (0, "cat the"), (1, "bird the the"), (-1, "the"), (1, None)], "topic_id int, clean_text string")
    got = {(r.topic_id, r.word): (r.n, round(r.weight, 9)) for r in density.topic_terms(posts, top=1).collect()}
    mean = 9 / 3
    assert got == {(0, "cat"): (3, round(3 * np.log1p(mean / 3), 9)), (1, "bird"): (1, round(np.log1p(mean / 1), 9)) if np.log1p(3) > 2 * np.log1p(mean / 4) else (2, round(2 * np.log1p(mean / 4), 9)), (-1, "the"): (1, round(np.log1p(mean / 4), 9))}
    dated = posts.withColumn("community", F.lit("c")).withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000)))
    assert rows(topics.topic_counts(dated), "topic", "n") == [(0, 2), (1, 2)]


def test_words_are_hashed_once_per_text(spark):
    posts = spark.createDataFrame([("a", "one two two"), ("b", "..."), ("c", None), (None, "one two two")], "post_id string, clean_text string")
    v = density.hashed_vectors(posts, "post_id")
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "UDF(" in x] and plan.count("aggregate(") == 1
    got = {r.post_id: np.array(r.embedding) for r in v.collect()}
    assert got.keys() == {"a", None} and sorted(got["a"][got["a"] > 0]) == pytest.approx(sorted(np.log([2, 3]) / np.hypot(*np.log([2, 3])))) and (got["a"] == got[None]).all()


def test_windows_hand_on_each_neighbour_once(monkeypatch):
    """The k nearest that the two windows of a row show, ties by id, in one list; against the windows one by one."""
    monkeypatch.setattr(density, "WINDOW", 16)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (75, 3)).astype(float)  # many copies
    ids = np.concatenate([np.arange(70), [66, 67, 68, 69, 3]])  # where one order ends and the next begins
    k, want = 4, {}
    for at in range(0, 75, 8):
        i, v = ids[at : at + 16], x[at : at + 16]
        norms = np.square(v).sum(axis=1)
        d = np.maximum(norms[:, None] + norms - 2 * v @ v.T, 0.0)
        d[i[:, None] == i] = np.inf
        for row, near in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]):
            want.setdefault((at + row), set()).update((float(np.sqrt(np.square(v[row] - v[n]).sum())), int(i[n])) for n in near if i[n] != i[row])
        if at + 16 >= 75:
            break
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 20]), pa.array([r.tobytes() for r in x[a : a + 20]], pa.binary())], ["id", "x"]) for a in range(0, 75, 20)]
    got = [(r["id"], r["d"], r["nb"]) for b in density._searched(k, 3)(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted((int(ids[p]), d, n) for p, found in want.items() for d, n in sorted(found)[:k])


@pytest.fixture
def small_topics(spark, monkeypatch):
    """Documents of three topics, one of 12, and no bound on clusters that this small table would be over."""
    from tidewatch.plans import checks_text

    monkeypatch.setattr(density, "MOST_CLUSTERS", 10, raising=False)
    words = ["apple pear plum", "hammer nail saw", "river lake sea"]
    kinds = [(0, 90), (1, 60), (2, 12)]
    texts = [(t, f"{words[t]} {words[t]} word{n % 3}") for t, many in kinds for n in range(many)]
    docs = spark.createDataFrame([(f"d{n}", "en" if t < 2 else "fr", text) for n, (t, text) in enumerate(texts)], "post_id string, community string, clean_text string")
    docs = docs.withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000)))
    monkeypatch.setattr(checks_text.b, "clean_documents", lambda spark, sf: docs)
    return checks_text


def test_terms_of_a_small_topic(spark, small_topics):
    got = small_topics.density_topic_terms(spark, "").where("topic_id >= 0").collect()
    assert {"river", "lake", "sea"} <= {r.word for r in got} and {r.n for r in got if r.word == "river"} == {24}


def test_features_of_a_small_topic(spark, small_topics):
    got = {r.community: r for r in small_topics.density_topic_features(spark, "").collect()}
    assert got.keys() == {"en", "fr"} and got["fr"].dominant_topic not in (0, got["en"].dominant_topic)
