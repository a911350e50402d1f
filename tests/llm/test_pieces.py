"""Sampled segmentations: lossless, reproducible, and with the probabilities of a brute-force lattice."""

import math
import subprocess
import sys
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from tidewatch.llm import pieces, queries

TEXTS = [None, "", " ", "a", "hello world", "  two  spaces ", "line\nbreak\n\n x\t\r\n", "▁ literal ▁▁", "ÉÖ ñ ß 漢字 😀 \u0000 end", "x" * 50000, "word " * 20000]


def frame(spark, seed=None):
    rows = [(k if k != 3 else None, t, 5) for k, t in enumerate(TEXTS)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, decoded int")


def test_lossless_and_reproducible(spark):
    coded = pieces.encode(frame(spark))
    got = pieces.decode(coded).select("doc_id", "text", "decoded", "piece_ids").collect()
    assert all(r.text == r.decoded for r in got)
    assert {(r.doc_id, r.text): tuple(r.piece_ids or ()) for r in got} == {(r.doc_id, r.text): tuple(r.piece_ids or ()) for r in coded.repartition(5).collect()}
    assert len({(r.doc_id, r.text, tuple(r.piece_ids or ())) for r in got}) == len(TEXTS)
    assert [len(r.piece_ids) for r in got if r.text == ""] == [0, 0] and [r.piece_ids for r in got if r.text is None] == [None, None]
    assert pieces.encode(frame(spark).limit(0)).collect() == []
    other = pieces.encode(frame(spark), seed=1).collect()
    assert [r.piece_ids for r in other] != [r.piece_ids for r in got]


def test_pieces_are_those_of_the_model(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.encode(frame(spark)).where("length(text) BETWEEN 1 AND 100").collect():
        if "▁" not in r.text:
            assert sp.decode(r.piece_ids) == r.text


def test_shares_of_paths():
    vocab = [("a", 1, math.log(0.2)), ("b", 2, math.log(0.1)), ("ab", 3, math.log(0.3)), ("ba", 4, math.log(0.15)), (" ", 5, math.log(0.25))]
    paths = {}

    def walk(s, done, p):
        if not s:
            paths[done] = p
        for t, i, w in vocab:
            if s.startswith(t):
                walk(s[len(t):], done + (i,), p * math.exp(0.5 * w))

    walk(" abab", (), 1.0)
    n = 40000
    flat, upto = pieces.Lattice(vocab, list(range(256)), 0.5).sample(["abab"] * n, np.arange(n))
    seen = Counter(tuple(x) for x in np.split(flat, upto[:-1]))
    total = sum(paths.values())
    assert set(seen) == set(paths)
    assert all(abs(seen[k] / n - p / total) < 4 * math.sqrt(p / total / n) + 1e-3 for k, p in paths.items())


def test_query(spark, sf):
    got = queries.QUERIES["op9_sampled_pieces"](spark, sf)
    assert got.where("NOT lossless OR n_pieces < 1").count() == 0
    assert got.count() == queries.table(spark, sf, "documents").count() and got.select(F.countDistinct("doc_id")).first()[0] == got.count()


def test_largest_draws_stay_in_their_row(monkeypatch):
    """Draws next to 1 take the last edge of their own place, and shares don't depend on the rest of the batch."""
    vocab = [(c, 1 + k, -1.0 - k) for k, c in enumerate("abcd ")] + [("ab", 6, -2.0), ("cd", 7, -2.0), (" a", 8, -3.0)]
    text_of = {i: t for t, i, _ in vocab}
    lattice, rng = pieces.Lattice(vocab, list(range(256)), 0.5), np.random.default_rng(1)
    texts = ["".join(x) for x in rng.choice(list("abcd"), size=(3000, 12))]
    run = lattice.tables([texts[-1]])[2]
    assert lattice.tables(texts)[2][-len(run):].tolist() == run.tolist()
    monkeypatch.setattr(pieces, "_mixed", lambda x: np.full(len(x), 2**64 - 1, dtype=np.uint64))
    flat, upto = lattice.sample(texts, np.arange(len(texts)))
    assert ["".join(text_of[i] for i in x) for x in np.split(flat.tolist(), upto[:-1])] == [" " + t for t in texts]


def test_blocks_do_not_matter(monkeypatch):
    """Very long texts are cut within; the ids are the same for any block, batch and order of work."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé漢 \n"), size=k)) for k in rng.integers(1, 12, 3000)]
    texts = [" ".join(rng.choice(words, size=400_000)), None, "", "x" * 150_000 + " y", "é" * 70_000, "漢字" * 30_000, " " * 70_000, "\n" * 3000] + words
    keys = np.arange(len(texts)) % 1000
    vocab, bytes_of, spelling = pieces.vocabulary()
    flat, upto = pieces.Lattice(vocab, spelling, 0.5).sample(texts, keys)
    assert len(texts[0]) > 2_000_000
    ids = np.split(flat, upto[:-1])
    for t, i in zip(texts, ids):
        assert b"".join(bytes_of[x] for x in i.tolist()).decode() == (" " + t if t else "")
    for chunk, held in ((1 << 17, 1 << 12), (1 << 22, 1 << 22)):
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        monkeypatch.setattr(pieces, "HELD_EDGES", held)
        lattice = pieces.Lattice(vocab, spelling, 0.5)
        some = [lattice.sample(texts[a : a + 700], keys[a : a + 700]) for a in range(0, len(texts), 700)]
        assert np.array_equal(np.concatenate([f for f, _ in some]), flat)


def test_memory_of_one_long_text():
    """A text of 20 million characters takes little beyond itself and its ids."""
    code = """
import resource, numpy as np, pyarrow as pa
from tidewatch.llm import pieces
vocab, _, spelling = pieces.vocabulary()
text = pa.array([" " + "some words of a very long text\\n" * 650_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
flat, upto = pieces.Lattice(vocab, spelling, 0.5).sample_array(text, np.arange(1))
print(len(flat), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) > 4_000_000 and int(out[1]) < 400_000
