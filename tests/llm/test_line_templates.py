"""Recurring lines against SQL, and edge rows."""

from tidewatch.llm import line_templates


def run(spark, rows):
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, positions int")
    return sorted((tuple(r) for r in line_templates.line_report(df).collect()), key=repr)


def test_query(same):
    same("op2_line_templates")


def test_fields_are_generalised(spark):
    names = "ann bob cid dan eve fay gus hal ira joe".split()
    rows = [(k, f"own line number {x} of its document {x}\nPosted by the user {x} on day {k} of the month") for k, x in enumerate(names)]
    rows += [(20 + k, f"{x} stands quite alone with no other line of its kind, {x}") for k, x in enumerate(names)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[0][3] == rows[0][1]
    assert all(got[k][3] == rows[k][1].split("\n")[0] or got[k][2] == 2 for k in range(1, 10))
    assert all(got[k][2] >= 1 for k in range(1, 10)) and all(got[20 + k][2] == 0 for k in range(10))


def test_edge_rows(spark):
    long = " ".join(f"word{chr(97 + k)}" for k in range(25))
    rows = [(1, None), (2, ""), (3, "\n \n"), (5, f"{long}\nmine"), (4, f"{long}\n{long}\nyours"), (6, long), (6, long), (None, f"x\n{long} "), (7, "a b c"), (8, "a b c"), (9, "x " * 40000)]
    got = run(spark, rows)
    want = [(1, 0, 0, None), (2, 0, 0, ""), (3, 0, 0, "\n \n"), (5, 2, 1, "mine"), (4, 3, 2, "yours"), (6, 1, 1, ""), (6, 1, 1, ""), (None, 2, 0, f"x\n{long} "),
            (7, 1, 0, "a b c"), (8, 1, 0, "a b c"), (9, 1, 0, "x " * 40000)]
    assert got == sorted(want, key=repr)
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, positions int")
    assert line_templates.dedup_lines(df).columns == df.columns and line_templates.dedup_lines(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, sf):
    plan = line_templates.line_report(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
