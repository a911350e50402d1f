"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

A rule bounds the ratio of two counts of a text.  The counts are column expressions over its words and lines, the
rules are comparisons of their integer multiples, and all of it is evaluated row by row where the text is read: no
shuffle, no Python.  What is used more than once is bound to a lambda variable: the optimizer copies a column into
every place that uses it when a filter on a verdict is pushed down, a variable it can't copy.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import SPACES

#: Frequent words of the languages of the corpus (fixed values); a caller gives others for other languages.
STOP_WORDS = (
    "a an and are as at be by for from has in is it of on or that the this to was were with "
    "au aux avec dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "al con de del el en es la las los no para por que se su un una y"
).split()


class Rule(NamedTuple):
    """``low`` and ``high`` per cent bound 100 * top / bottom; None leaves a side open."""

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None

    def passes(self, counts: Column) -> Column:
        top, bottom, ok = counts[self.top] * 100, counts[self.bottom], F.lit(True)
        if self.low is not None:
            ok = ok & (top >= bottom * self.low)
        return ok & (top <= bottom * self.high) if self.high is not None else ok


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("capitals", "n_capitals", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 8, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 40),
)
MIN_WORDS, MAX_REPEAT = 50, 50


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value evaluated once per row."""
    return F.transform(F.array(value), use)[0]


def _repeated(w: Column) -> Column:
    """Places of the three-word windows that are found twice or more, rising.

    Windows are sorted by a 64-bit hash, so that equal ones are neighbours; neighbours with equal hashes are compared
    word by word, and a text in which different windows share a hash has its windows sorted by their words instead.
    That is n log n in the words of one text.
    """
    starts = F.sequence(F.lit(0), F.size(w) - 3)

    def neighbours(key: Callable[[Column], Column], v: Column) -> Column:
        return F.filter(v, lambda x, j: F.coalesce(key(x) == key(F.get(v, j - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(v, j + 1)), F.lit(False)))

    def places(v: Column) -> Column:
        return F.array_sort(F.transform(v, lambda x: x["i"]))

    def differ(x: Column, y: Column) -> Column:
        return (w[x["i"]] != w[y["i"]]) | (w[x["i"] + 1] != w[y["i"] + 1]) | (w[x["i"] + 2] != w[y["i"] + 2])

    by_hash = F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))
    by_words = F.array_sort(F.transform(starts, lambda i: F.struct(F.struct(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))
    same = bound(by_hash, lambda v: neighbours(lambda x: x["h"], v))
    found = bound(same, lambda s: F.when(
        F.size(F.filter(s, lambda x, j: F.coalesce((x["h"] == F.get(s, j + 1)["h"]) & differ(x, F.get(s, j + 1)), F.lit(False)))) > 0,
        bound(by_words, lambda v: places(neighbours(lambda x: x["h"], v)))).otherwise(places(s)))
    return F.when(F.size(w) < 3, F.array().cast("array<int>")).otherwise(found)


def _counts(d: Column, stop_words: list[str]) -> Column:
    covered = F.aggregate(_repeated(d["w"]), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n"), i.alias("last")), lambda acc: acc["n"])
    counts = {
        "n_words": F.size(d["w"]),
        "word_chars": F.char_length(F.array_join(d["w"], "")),
        "n_symbols": F.regexp_count(d["text"], F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(d["lines"]) - F.size(F.array_distinct(d["lines"])),
        "n_repeat_words": covered,
        "n_lines": F.size(d["lines"]),
        "n_stop_words": F.size(F.filter(d["w"], lambda x: F.lower(x).isin(stop_words))),
        "n_capitals": F.size(F.filter(d["w"], lambda x: x.rlike("[A-Z][A-Z]"))),
    }
    return F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals")


def measured(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """A struct of the COUNTS of a text; null and blank texts have none of anything."""
    text, stop_words = F.coalesce(text, F.lit("")), list(dict.fromkeys(stop_words))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = bound(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)))
    return bound(F.struct(text.alias("text"), words.alias("w"), lines.alias("lines")), lambda d: _counts(d, stop_words))


def counted(docs: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """doc_id and the counts of every text."""
    return docs.select("doc_id", measured(F.col("text"), stop_words).alias("counts")).select("doc_id", "counts.*")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """The counts, base_failed, kept, and the names of the broken rules.

    base_failed: under fifty words, or more than half of the words in windows found twice.  kept: base passed and no
    rule is broken.  A rule over a zero count holds unless its top is above zero.  Rows with equal texts get equal
    verdicts, whatever their id; very long texts are taken whole; an empty table gives no rows; other columns aren't
    read, so they can't clash.
    """

    def verdict(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT)
        broken = F.filter(F.array(*[F.when(~r.passes(c), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        return F.struct(*[c[n].alias(n) for n in COUNTS], failed.alias("base_failed"), (~failed & (F.size(broken) == 0)).alias("kept"), F.array_join(broken, ",").alias("broken_rules"))

    return docs.select("doc_id", bound(measured(F.col("text"), stop_words), verdict).alias("verdict")).select("doc_id", "verdict.*")
