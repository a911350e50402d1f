"""Near-duplicates against brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from tidewatch.llm import queries, simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    """Component of each position by breadth-first search over all pairs."""
    prints = np.array(prints, dtype=np.uint64)
    group = [-1] * len(prints)
    for s in range(len(prints)):
        if group[s] < 0:
            todo, group[s] = [s], s
            while todo:
                for y in np.flatnonzero(np.bitwise_count(prints ^ prints[todo.pop()]) <= radius).tolist():
                    if group[y] < 0:
                        group[y] = s
                        todo.append(y)
    return group


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    group = plain_groups(prints)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert got(queries.op8_simhash(spark, sf).select("doc_id", "fingerprint", "component_id")) == expected(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "One TWO"), (None, "lost words of no document"), (7, "É é x y"), (8, "w " * 30000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fingerprint string")
    assert got(simhash.near_duplicates(df)) == expected(rows)
    assert got(simhash.near_duplicates(df.limit(0))) == []
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(df).collect()) == [-1, -1, 1, 4, 4, 7, 8]


@pytest.mark.parametrize("node_codes", [4096, 20])
def test_links_lose_no_component(spark, node_codes):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = []
    for c in centres:
        for _ in range(int(rng.integers(1, 40))):
            for b in rng.integers(0, 64, int(rng.integers(0, 4))):
                c ^= np.uint64(1 << int(b))
            codes.append(int(c))
    codes = sorted(set(codes))
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "code long")
    roots = {r.node % 2**64: r.root for r in simhash.connected(simhash.links(df, node_codes=node_codes)).collect()}
    want, have = {}, {}
    for c, g in zip(codes, plain_groups(codes)):
        want.setdefault(g, set()).add(c)
        have.setdefault(roots.get(c, ("alone", c)), set()).add(c)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & np.uint64(0xFFFF0000FF)
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    found = {(int(a), int(b)) for p, q in simhash.near_pairs(codes) for a, b in zip(p, q)}
    assert found == {(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes) <= 3) if j > i}


def test_path_of_stars(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)], "a long, b long")
    roots = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 301 + 400
