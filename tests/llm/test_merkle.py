"""Manifests against a plain tree, proofs that fold, ragged exchanges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle, queries


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Root and, for each node, the sibling digests of every level and its index there."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, k in zip(paths, at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            p.append((run, k % 16))
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        low = r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        groups[r[1]].append((r[0], h("".join(map(enc, r))), h("".join(map(enc, (*r[:4], low))))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        done[s] = tree([x[1] for x in groups[s]])
    root, tops = tree([done[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (doc, leaf, seen), path in zip(groups[s], done[s][1]):
            proof, now = "", seen
            for run, k in path + top:
                proof += "".join(run[:k] + run[k + 1 :])
                now = h("".join([*run[:k], now, *run[k + 1 :]]))
            out.append((doc, leaf, done[s][0], root, h(proof), now, now == root))
    return out


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(df, levels):
    seen = {"text": merkle.tampered(F.col("text"), F.col("doc_id"))}
    return sorted(map(tuple, merkle.manifest(df, seen=seen, levels=levels).select(*COLS).collect()), key=repr)


def test_query(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op13_butterfly_manifest"](spark, sf).select(*COLS).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr) and 0 < sum(not r[-1] for r in got) < len(got)


def test_sql(same):
    same("op13_butterfly_manifest")


@pytest.mark.parametrize("levels", [1, 3])
def test_edges(spark, levels):
    """With one level in a block, the exchange has up to three rounds, with last subtrees of every width."""
    rng = random.Random(levels)
    counts = {None: 1, "": 17, "hot": 4500, "b": 256, "c": 257, "é": 16, "\U0001f600": 33, "￿": 2}
    rows = [(k, s, "en", k % 3 or None, rng.choice([None, "", "Text " + str(k), "same A", "low"])) for s, n in counts.items() for k in range(n)]
    rows += [(5, "c", "en", 2, "same A")] * 40 + [(None, "c", None, None, "Z")] * 3 + [(9, "big", None, 1, "X" * 2_000_000)]
    rows += [(1, f"only {k}", None, None, "a") for k in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("root", F.lit(1)).withColumn("place", F.lit("x"))
    assert run(df.repartition(5), levels) == sorted(plain(rows), key=repr)


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "s", "en", 3, "Abc")], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = merkle.manifest(df).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified
    assert merkle.manifest(df.limit(0)).collect() == []


def test_siblings_fold(spark, sf):
    for r in merkle.manifest(queries.table(spark, sf, "documents"), siblings=True).limit(50).collect():
        assert h("".join(x for level in r.siblings for x in level)) == r.proof_sha256 and r.verified and r.seen == r.leaf
