"""Severity of toxicity by a cumulative-link ordinal regression on the words of a text.

One weight per word is shared by all thresholds: P(grade > k) = logistic(w . x - cut_k), with rising cuts.  The
features of a text are its distinct words and their beginnings (languages inflect); an L1 penalty leaves few of them with a weight.  The result is the expected
severity, the sum of P(grade > k) over the thresholds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import small_side, stored

WORD = re.compile(r"\w+")
#: Labelled rows of each label that the model is fitted on, at most; the rows with the least hash of doc_id are taken.
FIT_ROWS = 3000
#: Rows of the fit, and their share, that must have a word before it can get a weight.
MIN_ROWS, MIN_SHARE = 5, 0.001
PENALTY, ROUNDS = 0.002, 200
#: A text goes from this expected severity.
REJECT = 0.5


def features(text: str | None) -> set[str]:
    """Distinct words of a text, and their first five and seven letters with a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {f"{w[:k]}*" for w in words for k in (5, 7) if len(w) > k}


class Model(NamedTuple):
    weights: dict[str, float]
    cuts: tuple[float, ...]

    def severity(self, text: str | None) -> float:
        """Expected grade of a text; without a word there is nothing to grade, and it is 0."""
        found = features(text)
        if not found:
            return 0.0
        score = sum(self.weights[t] for t in found & self.weights.keys())
        return float(sum(1 / (1 + np.exp(c - score)) for c in self.cuts))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(texts: list[str], grades: list[int], weights: list[float], penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Model of grades 0 to K: proximal gradient steps with momentum on the weighted mean of the log-loss.

    A text of grade g is above the cuts below g and under the next one; each cut gives one binary term, and all of them
    share the word weights.
    """
    df = Counter(w for t in texts for w in features(t))
    vocab = {w: k for k, w in enumerate(sorted(w for w, n in df.items() if n >= max(MIN_ROWS, MIN_SHARE * len(texts))))}
    found = [np.fromiter((vocab[w] for w in features(t) if w in vocab), dtype=np.int64) for t in texts]
    rows, cols = np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.concatenate([*found, np.zeros(0, dtype=np.int64)])
    y, share = np.array(grades), np.array(weights) / max(sum(weights), 1e-12)
    top = int(y.max(initial=0))
    if top < 1 or not len(vocab):
        return Model({}, (np.inf,))
    sign = np.where(y[:, None] > np.arange(top), 1.0, -1.0)  # above cut k or not
    w, cuts = np.zeros(len(vocab)), np.array([-np.log(max(share[y > k].sum(), 1e-9) / max(share[y <= k].sum(), 1e-9)) for k in range(top)])
    most = np.bincount(rows, minlength=len(y)).max(initial=1)
    step, ahead_w, ahead_c, t = 4.0 / (top * max(1.0, most) ** 0.5), w, cuts, 1.0

    def loss(w: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray]:
        z = sign * (np.bincount(rows, w[cols], len(y))[:, None] - cuts)
        return float((share[:, None] * _softplus(-z)).sum()), -sign / (1 + np.exp(z)) * share[:, None]

    for _ in range(rounds):
        value, g = loss(ahead_w, ahead_c)
        gw, gc = np.bincount(cols, g.sum(axis=1)[rows], len(vocab)), -g.sum(axis=0)
        while True:
            new_w = ahead_w - step * gw
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
            new_c = np.maximum.accumulate(ahead_c - step * gc)  # cuts stay in order
            dw, dc = new_w - ahead_w, new_c - ahead_c
            if loss(new_w, new_c)[0] <= value + gw @ dw + gc @ dc + (dw @ dw + dc @ dc) / (2 * step) + 1e-12:
                break
            step /= 2
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_c = new_w + (t - 1) / nt * (new_w - w), new_c + (t - 1) / nt * (new_c - cuts)
        done = np.abs(new_w - w).max() + np.abs(new_c - cuts).max() < 1e-5
        w, cuts, t, step = new_w, new_c, nt, step * 1.1
        if done:
            break
    return Model({v: float(w[k]) for v, k in vocab.items() if w[k] != 0}, tuple(float(c) for c in cuts))


def graded(texts: list[str], toxic: list[int]) -> list[int]:
    """Grades 0 (not toxic), 1 and 2 from a yes/no label.

    Marker words are those with at least ten times the share of texts among toxic rows that they have among others;
    a toxic text with two of them or more is severe.
    """
    bad, good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    in_bad = Counter(w for x, t in zip(texts, toxic) if t for w in features(x))
    in_good = Counter(w for x, t in zip(texts, toxic) if not t for w in features(x))
    markers = {w for w, n in in_bad.items() if n >= max(MIN_ROWS, 0.01 * bad) and n / bad >= 10 * in_good[w] / good}
    return [0 if not t else 2 if len(features(x) & markers) > 1 else 1 for x, t in zip(texts, toxic)]


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """text, toxic and weight of at most ``bound`` labelled rows of each label; weights restore the labels' shares."""
    known = labels.where("toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("label_id"), "toxic").where("label_id IS NOT NULL").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    totals = known.groupBy("toxic").agg(F.count("*").alias("n"))
    order = F.xxhash64("label_id", F.lit(6))
    taken = [known.where(F.col("toxic") == t).orderBy(order, "label_id").limit(bound) for t in (0, 1)]
    taken = stored(taken[0].union(taken[1]), "toxicity-sample")
    found = docs.select("doc_id", "text").join(small_side(taken, 32), docs.doc_id == taken.label_id).where("text IS NOT NULL")
    found = found.join(F.broadcast(totals), "toxic")  # two rows
    return found.select("label_id", "text", "toxic", (F.col("n") / F.least("n", F.lit(bound))).alias("weight"))


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    """Model fitted in one task on a bounded sample.  Without labelled rows of both kinds it gives every text severity 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        rows = pd.concat(parts).sort_values(["label_id", "text"]) if parts else pd.DataFrame()
        if len(rows) and rows.toxic.nunique() == 2:
            texts = rows.text.tolist()
            model = fit(texts, graded(texts, rows.toxic.tolist()), rows.weight.tolist())
            yield pd.DataFrame({"word": [None] * len(model.cuts) + list(model.weights), "value": [*model.cuts, *model.weights.values()]})

    found = training_rows(docs, labels, bound).repartition(1).mapInPandas(run, "word string, value double").collect()
    return Model({r.word: r.value for r in found if r.word is not None}, tuple(sorted(r.value for r in found if r.word is None)))


def severity(model: Model) -> Column:
    """Expected severity of the column ``text``."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(model.severity, na_action=None).astype(float)

    return score("text")


def scored(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """doc_id, severity and rejected of every row of ``docs``.

    Null and empty texts, and others without a word, have severity 0.  Equal texts have equal severity, whatever
    their ids.  Labels without a text, of null or of other values are not used; a doc_id labelled twice is toxic if one
    label says so.  An empty table gives no rows.
    """
    out = docs.select("doc_id", severity(train(docs, labels, bound)).alias("severity"))
    return out.withColumn("rejected", F.col("severity") >= reject)


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` below the severity ``reject``, all columns kept."""
    return docs.where(severity(train(docs, labels, bound)) < reject)
