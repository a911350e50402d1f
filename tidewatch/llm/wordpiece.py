"""Greedy word-piece lengths by a linear automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that go on.  Every node
has a failure link to the node where matching goes on once the longest pieces of what was read are taken off, and the
number of pieces that this takes off.  A word is read once, character by character; the counts on the failure links
add up to the number of pieces of the greedy longest-match segmentation, which itself is never built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Where the vocabularies of public tokenizers lie on this box; a caller elsewhere gives its own path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose lengths a worker keeps between batches; beyond it the table is begun anew.
KEPT_WORDS = 200_000
#: A word's entry is its number of pieces, plus this if it cannot be segmented.
UNKNOWN = 1 << 40


def vocabulary(model: str = MODEL) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that go on, read on the driver; a vocabulary's size is fixed."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    first = [p[1:] for p in own if p.startswith("▁")]
    return [p for p in first if p and "▁" not in p], [p for p in own if "▁" not in p]


def bare_begin(model: str = MODEL) -> bool:
    """Whether the vocabulary has the begin of a word as a piece of its own."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    i = sp.piece_to_id("▁")
    return sp.id_to_piece(i) == "▁" and not sp.is_unknown(i)


class Automaton:
    """With ``bare``, a word that no piece begins is the begin of a word, one piece, and then pieces that go on."""

    def __init__(self, first: list[str], later: list[str], bare: bool = False):
        self.next: dict[tuple[int, str], int] = {}
        size, final, parent = 2, set(), {}
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (node, c) not in self.next:
                        self.next[node, c] = size
                        parent[size] = (node, c)
                        size += 1
                    node = self.next[node, c]
                final.add(node)
        self.fail: list[int] = [-1] * size  # -1: what was read cannot be segmented
        self.popped = [0] * size
        if bare:
            self.fail[0], self.popped[0] = 1, 1
        depth = {0: 0, 1: 0}
        for v in range(2, size):
            depth[v] = depth[parent[v][0]] + 1
        for v in sorted(parent, key=depth.__getitem__):  # links lead to shorter strings
            u, c = parent[v]
            if v in final:
                self.fail[v], self.popped[v] = 1, 1
                continue
            z, n = self.fail[u], self.popped[u]
            while z >= 0 and (z, c) not in self.next:
                n, z = n + self.popped[z], self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.next[z, c], n

    def length(self, word: str) -> int:
        """Pieces of ``word``, or 1 + UNKNOWN if greedy matching cannot get through it."""
        node, n, step = 0, 0, self.next
        for c in word:
            while (to := step.get((node, c), -1)) < 0:
                if self.fail[node] < 0:
                    return 1 + UNKNOWN
                n, node = n + self.popped[node], self.fail[node]
            node = to
        while node != 1:
            if self.fail[node] < 0:
                return 1 + UNKNOWN
            n, node = n + self.popped[node], self.fail[node]
        return n


def counter(model: str = MODEL):
    """Column function (text): struct of n_words, n_tokens, n_unknown, n_pieces and n_unspelt."""
    first, later = vocabulary(model)
    bare = bare_begin(model)
    held: list = []

    @F.arrow_udf("n_words long, n_tokens long, n_unknown long, n_pieces long, n_unspelt long")
    def count(text: pa.Array) -> pa.Array:
        if not held:
            held.extend((Automaton(first, later), Automaton(first, later, bare), {}, {}))
        auto, begun, known, spelt = held  # spelt: pieces of the words that are unknown without the bare begin
        sums = []

        def learn(w: bytes) -> int:
            word = w.decode("utf-8", "surrogatepass")
            n = auto.length(word)
            if n >= UNKNOWN and (m := begun.length(word)) < UNKNOWN:
                spelt[w] = m
            return n

        for t in text:
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
            for w in set(words).difference(known):
                if len(known) >= KEPT_WORDS:
                    known.clear()
                    spelt.clear()
                    known.update((x, learn(x)) for x in set(words))
                    break
                known[w] = learn(w)
            total = sum(map(known.__getitem__, words))
            n, unknown = total % UNKNOWN, total // UNKNOWN
            more = [spelt[w] for w in words if w in spelt] if unknown else []
            sums.append((len(words), n, unknown, n + sum(more) - len(more), unknown - len(more)))
        cols = np.array(sums, dtype=np.int64).reshape(len(sums), 5)
        return pa.StructArray.from_arrays([pa.array(cols[:, k]) for k in range(5)], ["n_words", "n_tokens", "n_unknown", "n_pieces", "n_unspelt"])

    return count


def piece_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``token_counts`` and, with the bare begin of a word as a piece, n_pieces and n_unspelt.

    A word whose first letter has no piece that begins a word is unknown to word pieces; the model itself takes its
    bare begin piece, then pieces that go on.  n_pieces counts those; a word that they cannot spell either is one
    piece and unspelt.
    """
    return docs.select("doc_id", counter(model)("text").alias("n")).select("doc_id", "n.*")


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row of ``docs``.

    Words are what ASCII white space separates; a word that the vocabulary cannot segment is one token and unknown.
    Null, empty and blank texts have no words.  Equal texts have equal counts; an empty table gives no rows.
    """
    return piece_counts(docs, model).drop("n_pieces", "n_unspelt")
