"""Word-piece lengths against a public tokenizer and brute force."""

import random

import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from tidewatch.llm import queries, wordpiece


def greedy(word, first, later):
    n, i = 0, 0
    while i < len(word):
        k = next((k for k in range(len(word), i, -1) if word[i:k] in (later if i else first)), None)
        if k is None:
            return None
        n, i = n + 1, k
    return n


def test_small_vocabularies_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        first, later = ({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))} for _ in range(2))
        auto = wordpiece.Automaton(sorted(first), sorted(later))
        for _ in range(200):
            w = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            n = greedy(w, first, later)
            assert auto.length(w) == (1 + wordpiece.UNKNOWN if n is None else n), (w, first, later)


def test_query_against_tokenizer(spark, sf):
    first, later = wordpiece.vocabulary()
    vocab = {"[UNK]": 0}
    for p in [*first, *("##" + x for x in later)]:
        vocab.setdefault(p, len(vocab))
    tok = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9, continuing_subword_prefix="##"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op4_wordpiece_lengths"](spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").collect()
    assert got == {d.doc_id: len(tok.encode(d.text).ids) for d in docs}


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "hello"), (4, "hello"), (None, "hello 漢▁x"), (5, "z" * 100000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted((tuple(r) for r in wordpiece.token_counts(df).collect()), key=repr)
    assert [r[1:] for r in got if r[0] in (1, 2, 3)] == [(0, 0, 0)] * 3
    assert len([r for r in got if r == (4, 1, 2, 0)]) == 2 and [r[1:] for r in got if r[0] is None] == [(2, 3, 1)]
    assert wordpiece.token_counts(df.limit(0)).collect() == []


def test_words_without_a_begin_piece_are_spelt(spark, sf):
    """n_pieces is the greedy longest match over the model's own pieces, its bare begin of a word among them."""
    sp = sentencepiece.SentencePieceProcessor(model_file=wordpiece.MODEL)
    own = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    longest = max(map(len, own))

    def spelt(word):
        if "▁" in word:
            return None
        text, n, i = "▁" + word, 0, 0
        while i < len(text):
            k = next((k for k in range(min(len(text), i + longest), i, -1) if text[i:k] in own), None)
            if k is None:
                return None
            n, i = n + 1, k
        return n

    assert "▁" in own and spelt("ñado") == 3
    got = {r.doc_id: (r.n_pieces, r.n_unspelt) for r in queries.QUERIES["op4_wordpiece_lengths"](spark, sf).collect()}
    for d in queries.table(spark, sf, "documents").collect():
        each = [spelt(w.decode()) for w in d.text.encode().split()]
        assert got[d.doc_id] == (sum(n or 1 for n in each), each.count(None))
    r = queries.wordpiece.piece_counts(spark.createDataFrame([(1, "ñado hello 漢▁x")], "doc_id long, text string")).first()
    assert tuple(r)[1:] == (3, 4, 2, 6, 1)


def test_small_vocabularies_with_a_bare_begin():
    rng = random.Random(6)
    for _ in range(60):
        first, later = ({"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))} for _ in range(2))
        auto, all_ = wordpiece.Automaton(sorted(first), sorted(later), True), {"▁"} | {"▁" + p for p in first}
        for _ in range(200):
            w = "".join(rng.choices("abc", k=rng.randint(1, 12)))
            n = greedy("▁" + w, all_, later)
            assert auto.length(w) == (1 + wordpiece.UNKNOWN if n is None else n), (w, first, later)
