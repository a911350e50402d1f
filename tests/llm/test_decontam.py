"""Phrase matches against SQL and brute force, edge rows, proximity."""

import hashlib
import random
import re

from tidewatch.llm import decontam
from tidewatch.llm.common import stored


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            n = min(len(v), 10)
            for win in {tuple(v[i : i + n]) for i in range(max(len(v) - 9, 1))} if v else ():
                at = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) == win]
                hit |= {x for p in at for x in range(p, p + n)}
                if at and item_id is not None:
                    ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_query(same):
    same("op7_positional_index")


def test_edge_rows(spark):
    line = " ".join(f"t{k}" for k in range(14))
    docs = [(1, None), (2, ""), (3, f"x {line} y {line.upper()}"), (3, f"x {line} y {line.upper()}"), (3, "another text"), (None, f"{line} z"), (4, "the the the the"),
            (5, "Été, ÉTÉ! the" + " the" * 5000), (6, "t0 t1 t2 t3 t4 t5 t6 t7 t8 q"), (7, "a a a a a a a a a a a b")]
    items = [(10, line), (9, "the the"), (9, "the the"), (None, "été étÉ"), (11, None), (12, " ,"), (13, "Été ÉTÉ"), (14, "a " * 11), (15, "no such words")]
    d = spark.createDataFrame([(*r, "x", 0) for r in docs], "doc_id long, text string, term string, key int")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, words string")
    assert sorted((tuple(r) for r in decontam.contamination(d, i).collect()), key=repr) == expected(docs, items)
    assert sorted((tuple(r) for r in decontam.contamination(d, i.limit(0)).collect()), key=repr) == expected(docs, [])
    assert decontam.contamination(d.limit(0), i).collect() == []
    assert sorted(r.doc_id for r in decontam.drop_contaminated(d, i).collect()) == [1, 2, 3, 6]


def test_large_term_tables_give_the_same_index(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    wins = stored(decontam.windows(items)[0], "t")
    small = sorted(map(tuple, decontam.build_index(docs, wins)[0].collect()), key=repr)
    monkeypatch.setattr("tidewatch.llm.common.BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontam.build_index(docs, wins)[0].collect()), key=repr) == small


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x x omega"), (2, "omega alpha"), (3, "alpha" + " x" * 20 + " omega"), (4, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha omega")], "item_id long, text string")
    wins = stored(decontam.windows(items)[0], "t")
    index, rare = decontam.build_index(docs, wins)
    assert sorted(r.doc_id for r in decontam.proximity_matches(index, rare).collect()) == [1, 2]


def test_no_python_in_the_plan(spark, sf):
    plan = decontam.contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def near(docs, items, size=10):
    """Rows of ``proximity`` by trying every run of every text."""
    wins = {}
    for item_id, t in items:
        v = words(t)
        for win in {tuple(v[i : i + size]) for i in range(max(len(v) - size + 1, 1))} if v else ():
            wins.setdefault(win, set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, n, ids = words(text), 0, set()
        for win, holders in wins.items():
            may = len(set(win)) * 10 // 100
            runs = (set(w[p : p + len(win) + may]) for p in range(len(w)))
            if any(len(run & set(win)) >= len(set(win)) - may for run in runs):
                n, ids = n + 1, ids | {str(i) for i in holders if i is not None}
        out.append((doc_id, n, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n > 0))
    return sorted(out, key=repr)


def test_reordered_and_changed_passages_are_near(spark):
    rng = random.Random(4)
    common, line = [f"c{k}" for k in range(6)], [f"t{k}" for k in range(14)]
    noise = lambda n: " ".join(rng.choices(common, k=n))
    swapped, changed, far = line[:3] + [line[4], line[3]] + line[5:], line[:5] + ["other"] + line[6:], [x for w in line for x in (w, "c0")]
    docs = [(k, f"{noise(30)} {' '.join(v)} {noise(30)}") for k, v in enumerate((line, swapped, changed, line[::-1], far, line[:10:2]))]
    docs += [(6, None), (7, ""), (None, " ".join(line)), (1, docs[1][1]), *((k, noise(25)) for k in range(10, 40))]
    items = [(1, " ".join(line)), (2, noise(12)), (None, "c0 c1"), (3, None), (4, "absent " + " ".join(line[:9])), (1, " ".join(line))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.proximity(d, i).collect()), key=repr)
    assert got == near(docs, items)
    hit = {r[0] for r in got if r[2] and r[0] is not None and r[0] < 6}
    assert {0, 1, 2, 3} <= hit
    assert sorted(r[1] for r in decontam.proximity(d, i.limit(0)).collect()) == [0] * len(docs) and decontam.proximity(d.limit(0), i).collect() == []


def test_near_windows_of_the_query(spark, sf):
    from tidewatch.llm import queries

    got = {r.doc_id: r for r in queries.QUERIES["op7_proximity"](spark, sf).collect()}
    exact = {r.doc_id: r for r in queries.QUERIES["op7_positional_index"](spark, sf).collect()}
    assert set(got) == set(exact) and all(got[k].n_near_items >= r.n_items for k, r in exact.items()) and any(r.near for r in got.values())


def test_windows_longer_than_ten_words(spark):
    line = " ".join(f"t{k}" for k in range(14))
    d = spark.createDataFrame([(1, f"x {line} y"), (2, "x y")], "doc_id long, text string")
    i = spark.createDataFrame([(1, line)], "item_id long, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontam.contamination(d, i, size=14).collect()) == [(1, 14), (2, 0)]
