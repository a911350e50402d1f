"""License notices planted in other text, changed wording, edge rows."""

import random

import pyarrow.parquet as pq

from tidewatch.llm import licenses, queries

T = licenses.TEMPLATES


def names(text):
    return [x["license"] for x in licenses.Scanner().scan(text)]


def test_every_template_is_found_in_other_text():
    rng = random.Random(2)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    for name, text in T:
        assert names(text) == [name], name
        assert names(f"{noise(300)}\n{text.upper()}\n{noise(500)}") == [name], name


def test_other_wording_is_not_confirmed():
    assert names("Licensed under the Apache License, Version 1.1.") == []
    assert names("This work is licensed under the GNU General Public License, version 2.") == []
    assert names("The license of the driver was taken; all copyright reserved rights are public.") == []
    changed = T[2][1].replace("free of charge", "for a fee")
    found = licenses.Scanner().scan(changed)
    assert [x["license"] for x in found] == ["MIT"] and set(found[0]["differences"]) >= {"-free", "+fee"}


def test_many_notices_in_a_long_text():
    text = ("word " * 3000 + "Released under the MIT License.\n" + "word " * 50 + "All rights reserved.\n") * 5
    assert names(text) == ["MIT", "all-rights-reserved"] * 5


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "license"), (4, T[0][1]), (4, T[0][1]), (None, "x " * 30000 + "Licensed under CC BY-NC 4.0."), (5, "license " * 20000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, found int")
    got = sorted(((r.doc_id, [x.license for x in r.found]) for r in licenses.licenses(df).collect()), key=repr)
    assert got == [(1, []), (2, []), (3, []), (4, ["MIT"]), (4, ["MIT"]), (5, []), (None, ["CC-BY-NC-4.0"])]
    assert licenses.licenses(df.limit(0)).collect() == []


def test_query_against_plain_search(spark, sf):
    got = {r.doc_id: set(r.licenses.split(",")) - {""} for r in queries.QUERIES["op1_conditional_compression"](spark, sf).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "all-rights-reserved",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {r.doc_id: {n for x, n in lines.items() if x in r.text} for r in queries.table(spark, sf, "documents").collect()}
    assert got == want


def test_notices_that_save_little_are_found():
    """Entropy coding of the block may eat what a one-line notice saves; it stands there all the same."""
    rng = random.Random(11)
    short = [(n, t) for n, t in T if len(t) < 80]
    for _ in range(40):
        noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(700)]
        for name, text in short:
            assert names(" ".join([*noise[:350], text, *noise[350:]])) == [name], text


def test_larger_tables_against_plain_search():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    lines = {t: n for n, t in T if t in ("Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.")}
    scanner, lost = licenses.Scanner(), []
    for d in docs:
        want = {n for x, n in lines.items() if x in (d["text"] or "")}
        if want:
            lost += [(d["doc_id"], n) for n in want - {x["license"] for x in scanner.scan(d["text"])}]
    assert lost == []


def test_copies_that_lack_the_rarest_word_are_found():
    """Copies of a license in one block, each within what may differ; no single word can anchor them all."""
    lacking = T[2][1].replace("free of charge", "of charge")
    for text in (f"{T[2][1]}\n{lacking}", f"{lacking}\n{T[2][1]}", f"{lacking}\nit is free"):
        assert names(text) == ["MIT"] * text.count("NONINFRINGEMENT"), text[:40]
    found = licenses.Scanner().scan(f"{T[2][1]}\n{lacking}")
    assert [x["differences"] for x in found] == [[], ["-free"]]


def test_any_words_may_be_the_ones_that_differ():
    rng = random.Random(3)
    for name, text in T:
        words = text.split()
        n = len(licenses.WORD.findall(text)) * licenses.DIFFER // 100
        for _ in range(5 if n else 0):
            changed = list(words)
            for i in rng.sample(range(len(words)), n):
                changed[i] = "changed"
            copies = "\n".join((text, " ".join(changed), text))
            assert names("x " * 200 + copies + " y" * 300) == [name] * 3, changed
