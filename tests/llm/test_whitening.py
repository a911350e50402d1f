"""Components, whitened values and exact deviations against a dense eigenproblem."""

import numpy as np
import pytest

from tidewatch.llm import queries, whitening


def dense(vectors, k):
    x = np.floor(np.asarray(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, c, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def same(got, vectors, k):
    """``got``: rows of the operator in the order of ``vectors``."""
    x, n, s, c, e, v, trace = dense(vectors, k)
    y = np.array([r.whitened for r in got]).reshape(n, k)
    want = c @ v / np.sqrt(e)
    want *= np.sign(np.sum(want * y, axis=0))
    assert np.abs(y - want).max() < 1e-7
    assert [r.deviation for r in got][::k] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    assert np.allclose([r.explained for r in got][:k], e / trace, rtol=1e-12)
    assert all(r.n == n and r.identity_error < 1e-10 for r in got)
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-10


def test_query(spark, sf):
    from pyspark.sql import functions as F

    got = queries.QUERIES["op11_jacobi_davidson"](spark, sf).orderBy("vec_id", "component").collect()
    rows = queries.table(spark, sf, "embeddings").orderBy("vec_id").select(F.col("embedding")).collect()
    same(got, [r[0] for r in rows], 32)


def test_edges(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((60, 5)) * [3, 2, 1, 0.5, 0.25]).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(k if k != 4 else None, g, "n", 1.5) for k, g in enumerate(good)] + [(0, good[0], None, 0.0)] * 3
    bad = [(100, None, "", 0.0), (101, [1.0, None, 0.0, 0.0, 0.0], "", 0.0), (102, [nan] * 5, "", 0.0), (103, [inf, 0.0, 0.0, 0.0, 0.0], "", 0.0), (104, [-inf] * 5, "", 0.0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n string, whitened double")
    got = whitening.whiten(df, components=3).collect()
    assert len(got) == 63 * 3 and sum(r.vec_id is None for r in got) == 3 and sum(r.vec_id == 0 for r in got) == 12
    by = {(r.vec_id, r.component): r for r in got}
    same([by[r[0], j] for r in rows for j in (1, 2, 3)], [r[1] for r in rows], 3)


def test_degenerate_tables(spark):
    def run(vectors, **more):
        return whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>"), **more).collect()

    assert run([]) == [] and run([None, [float("nan")]]) == [] and run([[], []]) == []
    assert run([[1.0, 2.0]]) == [] and run([[1.0, 2.0]] * 50) == []
    assert {r.component for r in run([[0.0, 1.0, 5.0], [1.0, 2.0, 5.0], [3.0, 3.5, 5.0], [7.0, 0.0, 5.0]])} == {1, 2}
    with pytest.raises(ValueError):
        run([[1.0], [1.0, 2.0]])


@pytest.mark.parametrize("dims, wanted", [(300, 12), (200, 32), (64, 64), (40, 3)])
def test_iteration(dims, wanted):
    """Slowly falling and repeated eigenvalues; the search space stays below the whole space at 300 and 200."""
    rng = np.random.default_rng(dims)
    e = np.sort(rng.uniform(0.5, 1.0, dims) ** 3)[::-1] + np.linspace(1, 0, dims)
    e[1] = e[2]
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    a = (q * e) @ q.T
    jobs = []
    values, axes = whitening.eigenpairs(lambda w: jobs.append(w.shape[1]) or a @ w, dims, wanted)
    assert np.abs(values - e[:wanted]).max() < 1e-12
    assert np.linalg.norm(a @ axes - axes * values, axis=0).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(wanted)).max() < 1e-13
    assert max(jobs) <= wanted + whitening.GUARD
