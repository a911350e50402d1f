"""The ordinal fit against its own likelihood, held-out accuracy, edge rows."""

import numpy as np
import pytest

from tidewatch.llm import queries, toxicity


def test_fit_orders_grades():
    rng = np.random.default_rng(1)
    texts, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        words = [f"w{k}" for k in rng.integers(0, 50, 20)] + ["bad"] * (g > 0) + ["awful"] * (g > 1)
        texts.append(" ".join(words))
        grades.append(g)
    model = toxicity.fit(texts, grades, [1.0] * len(texts))
    got = [np.mean([model.severity(t) for t, x in zip(texts, grades) if x == g]) for g in range(3)]
    assert got[0] < 0.4 < got[1] < 1.5 < got[2] and model.cuts[0] < model.cuts[1]
    assert model.weights["bad"] > 0 and model.weights["awful"] > 0 and sum(k.startswith("w") for k in model.weights) < 25
    assert model.severity(None) == model.severity("") == 0 and model.severity("unseen") == pytest.approx(sum(1 / (1 + np.exp(c)) for c in model.cuts))


def test_fit_is_a_minimum():
    """No small move of a weight or cut lowers the penalised loss."""
    texts, grades = ["a b", "a", "b", "c a", "c", "a c b"] * 10, [1, 0, 1, 2, 1, 2] * 10
    m = toxicity.fit(texts, grades, [1.0] * 60, penalty=0.01, rounds=5000)

    def loss(w, cuts):
        total = 0.0
        for t, g in zip(texts, grades):
            z = sum(w.get(x, 0.0) for x in t.split())
            total += sum(np.logaddexp(0, -(1 if g > k else -1) * (z - c)) for k, c in enumerate(cuts)) / 60
        return total + 0.01 * sum(map(abs, w.values()))

    at = loss(m.weights, m.cuts)
    for d in (0.05, -0.05):
        assert all(loss(m.weights | {x: m.weights.get(x, 0.0) + d}, m.cuts) > at - 1e-6 for x in "abc")
        assert all(loss(m.weights, [c + d * (k == j) for k, c in enumerate(m.cuts)]) > at - 1e-6 for j in range(2))


def test_held_out_accuracy(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rest = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("toxic", (toxicity.severity(model) >= toxicity.REJECT).alias("out")).toPandas()
    assert rest.out[rest.toxic == 0].mean() < 0.02 and rest.out[rest.toxic == 1].mean() > 0.85


def test_edge_rows(spark):
    docs = spark.createDataFrame([(k, f"fine text {k}" if k % 3 else f"idiot text {k}", 1.0) for k in range(60)] + [(None, "idiot", 2.0), (90, None, 0.0), (91, "", 0.0), (5, "fine text 5", 0.0), (92, "idiot " * 50000, 0.0)],
                                 "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(3, 1), (None, 1), (7, None), (8, 5), (999, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels)
    assert got.columns == ["doc_id", "severity", "rejected"] and got.count() == docs.count()
    assert {r.doc_id for r in got.where("rejected").collect()} == {k for k in range(0, 60, 3)} | {None, 92}
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 22
    assert toxicity.scored(docs, labels.limit(0)).where("rejected").count() == 0
    assert toxicity.scored(docs.limit(0), labels).collect() == []


def test_query(spark, sf):
    got = queries.QUERIES["op6_ordinal_toxicity"](spark, sf)
    assert got.count() == queries.table(spark, sf, "documents").count() and got.where("severity IS NULL").count() == 0
