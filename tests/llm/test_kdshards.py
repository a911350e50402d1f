"""K-d leaves against a tree cut by sorting, near equal bytes, gapless slots, whole files."""

import zlib

from pyspark.sql import functions as F

from tidewatch.llm import kdshards, queries


def check_tree(rows, cuts, leaves, dims):
    """Walks the cuts over collected rows: the widest dimension is cut, as near to the goal as a row or FINEST allows; returns each row's leaf."""
    span = [max(r.at[d] for r in rows) - min(r.at[d] for r in rows) for d in range(dims)]
    by = {}
    for c in cuts:
        by.setdefault(c['node'], []).append(c)
    leaf = {}

    def walk(own, node, n, level):
        if n == 1 or not own:
            leaf.update({r.uid: node for r in own})
            return
        total = sum(r.size for r in own)
        c = next(c for c in by[node] if c['bytes'] == total)
        wide = [(max(r.at[d] for r in own) - min(r.at[d] for r in own)) / (span[d] or 1) for d in range(dims)]
        assert wide[c['dim']] == max(wide)
        under = [r for r in own if (r.at[c['dim']], r.tie) < (c['cut_value'], c['cut_tie'])]
        got, goal = sum(r.size for r in under), max(1, total * (n // 2) // n)
        assert got == c['bytes_below']
        best = upto = 0
        for r in sorted(own, key=lambda r: (r.at[c['dim']], r.tie)):
            upto += r.size
            best = upto if abs(upto - goal) < abs(best - goal) else best
        assert abs(got - goal) <= abs(best - goal) + total * kdshards.FINEST
        rest = {r.uid for r in under}
        walk(under, node, n // 2, level + 1)
        walk([r for r in own if r.uid not in rest], node + n // 2, n - n // 2, level + 1)

    walk(rows, 0, leaves, 0)
    return leaf


def test_tree(spark, sf):
    docs = queries.table(spark, sf, "documents")
    for leaves in (1, 13):
        rows = kdshards.points(docs)
        placed, cuts = kdshards.tree(rows, leaves, 4)
        want = check_tree(rows.collect(), cuts, leaves, 4)
        assert {r.uid: r.shard for r in placed.collect()} == want


def test_query(spark):
    for d in ("/root/testdata/sf0.01",):
        got = queries.QUERIES["op12_kd_shards"](spark, d).collect()
        docs = {r.doc_id: r.text for r in queries.table(spark, d, "documents").collect()}
        assert sorted(r.doc_id for r in got) == sorted(docs)
        assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in got)
        assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
        total, largest = [0] * 16, max(r.size for r in got)
        for r in got:
            total[r.shard] += r.size
        assert max(total) - min(total) <= largest + sum(total) / 16 / 100
        for k in range(16):
            own = sorted(r.slot for r in got if r.shard == k)
            assert own == list(range(len(own)))


def edge_rows(spark):
    rows = [(k, "copy " * 20, "hot", None, 100) for k in range(900)] + [(7, "same", None, "en", None)] * 600
    rows += [(None, None, "a", "en", 5), (1, "", "é" * 9, "fr", -3), (2, "x" * 3000, "b", "en", 1 << 62)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("size", F.lit("z")).withColumn("node", F.lit(9)).repartition(7)


def test_edges(spark):
    docs = edge_rows(spark)
    got = kdshards.shards(docs, leaves=16).collect()
    assert len(got) == 1509 and sum(r.doc_id is None and r.size == 1 and r.text_crc32 == 0 for r in got) == 3
    total = [sum(r.size for r in got if r.shard == k) for k in range(16)]
    assert max(total) - min(total) <= 3001 and len({(r.shard, r.slot) for r in got}) == len(got)
    assert kdshards.shards(docs.limit(0), leaves=16).collect() == []
    assert {r.shard for r in kdshards.shards(docs, target_bytes=1 << 40).collect()} == {0}
    assert len({r.shard for r in kdshards.shards(docs.limit(3), leaves=16).collect()}) <= 3
    assert max(r.shard for r in kdshards.shards(docs, target_bytes=20000).collect()) == -(-sum(total) // 20000) - 1


def test_files(spark, tmp_path):
    docs = edge_rows(spark)
    back = kdshards.write_shards(docs, str(tmp_path / "out"), leaves=4)
    assert back.columns == [*docs.columns, "shard"]
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, docs.collect()))
    size = [r[0] for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).select(F.col("sum((coalesce(octet_length(text), 0) + 1))")).collect()]
    assert len(size) == 4 and max(size) - min(size) <= 3001


def test_native(spark, sf):
    plan = kdshards.shards(queries.table(spark, sf, "documents"), leaves=4)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
