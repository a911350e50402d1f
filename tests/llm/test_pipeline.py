"""The corpus pipeline stage by stage against SQL and brute force, on plain and on awkward tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidewatch.llm import queries, simhash, toxicity
from tidewatch.llm.common import clear_scratch, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.sql(query).fetchall()


def test_stages(spark, sf):
    docs, labels, benchmark = (queries.table(spark, sf, t) for t in ("documents", "labels", "benchmark"))
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(stored(stage(spark, kept[-1], sf), name))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(k.columns == COLUMNS for k in kept[:-1]) and kept[-1].columns == [*COLUMNS, "piece_ids"]

    model = toxicity.train(docs, labels)
    assert ids[1] == {r.doc_id for r in docs.collect() if model.severity(r.text) < toxicity.REJECT} and ids[1] < ids[0]

    want = {r[0]: r[3] for r in sql(queries.SQL2, documents=kept[1])}
    assert {r.doc_id: r.text for r in kept[2].collect()} == want and kept[2].where("n_chars <> length(text)").count() == 0

    codes = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(kept[2]).collect()}
    seen, names = set(), set()
    for d in sorted(codes):
        if d not in seen:
            names.add(d)
            todo = [d]
            while todo:
                x = todo.pop()
                seen.add(x)
                todo += [y for y in codes if y not in seen and (codes[x] ^ codes[y]).bit_count() <= 3]
    assert ids[3] == names

    clean = {r[0] for r in sql(queries.SQL7, documents=kept[3], benchmark=benchmark) if not r[-1]}
    assert ids[4] == clean and ids[4] < ids[3]
    before, after = ({r.doc_id: r for r in k.collect()} for k in kept[4:])
    assert before.keys() == after.keys() and all(after[d].text == before[d].text and len(after[d].piece_ids) for d in before if before[d].text)

    assert {(r.doc_id, r.text) for r in cp.run(spark, sf).select("doc_id", "text").collect()} == {(r.doc_id, r.text) for r in after.values()}
    clear_scratch(spark)


def test_awkward_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage; so does an empty table."""
    some = queries.table(spark, sf, "documents").limit(40)
    rows = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "plain words only here " * 3000, "en", "s", 1), (-3, None, "en", None, None)] * 2
    docs = some.unionByName(spark.createDataFrame(rows, some.schema))
    for name in ("piece_ids", "decoded", "severity", "fingerprint", "template", "key"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            out = stored(stage(spark, table, sf), name)
            assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= table.count()
            assert out.where("decoded <> concat('decoded', doc_id) OR piece_ids <> concat('piece_ids', doc_id)").count() == 0
            table = out
        assert out.columns == [*docs.columns, "piece_ids_"]
    back = {r.doc_id: r.text for r in cp.encode_decode(spark, docs, sf).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("names, want", [([], "a"), (["A"], "a_"), (["a", "a_"], "a__")])
def test_free_name(names, want):
    assert cp.free_name("a", names) == want
