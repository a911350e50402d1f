"""Counts and verdicts against SQL and brute force."""

import re
from collections import Counter

from tidewatch.llm import quality_rules, queries


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_query(same):
    same("op3_rule_table")


def test_edge_rows(spark):
    texts = [None, "", " \n\t", "a b c a b c a b", "x x x x", "x x x", "# * $ é\n\n# * $ é\ny", "w " * 20000, "the quick one " * 30, " nbsp is a word\x0b"] * 2
    df = spark.createDataFrame([(k % 7 or None, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, w string")
    got = quality_rules.judged(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(*c, c[0] < 50 or 100 * c[4] > 50 * c[0]) for c in map(counts, texts)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert quality_rules.judged(df.limit(0)).collect() == []


def test_verdicts(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    x = quality_rules.judged(docs).where("NOT base_failed").join(labels, "doc_id").select("quality", "kept").toPandas()
    assert x.kept[x.quality == 1].mean() > 0.98 and x.kept[x.quality == 0].mean() < 0.02


def test_one_projection(spark, sf):
    plan = quality_rules.judged(queries.table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Join"))


def test_filters_on_verdicts(spark, sf):
    """A filter is pushed below the projection with all it needs: the windows are sorted once there and once above."""
    docs = queries.table(spark, sf, "documents")
    every = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for column in ("kept", "base_failed"):
        for wanted in (True, False):
            some = quality_rules.judged(docs).where(f"{column} = {wanted}")
            assert {r.doc_id for r in some.collect()} == {k for k, r in every.items() if r[column] == wanted}
            plan = some._jdf.queryExecution().optimizedPlan().toString()
            assert 1 <= plan.count("xxhash64") <= 2


def test_windows_that_share_a_hash(spark, monkeypatch):
    """With a hash that tells nothing apart all windows are sorted by their words, and counts stay exact."""
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: quality_rules.F.length(c[0]).cast("long"))
    texts = ["a b c a b c a b", "a b c d a b e a b c", "x x x x", "p q r s t u v w p q r", "aa b c aa b d aa b c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judged(df).collect()}
    assert got == {k: counts(t)[4] for k, t in enumerate(texts)}
