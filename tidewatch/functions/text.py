"""Text column expressions: cleaning, tokens, lexicon counts, hashes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from tidewatch.schemas import DELETED_BODIES, NO_AUTHOR

# Patterns.  Separators of the control range count as white space too.
WS = r"\s\x1c-\x1f"
WORD = r"0-9A-Za-z_\p{L}\p{N}"
URL = rf"(?iU)https?://[^{WS}]+|www\.[^{WS}]+"
EMAIL = r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SPACES = rf"(?U)[{WS}]+"
WORD_RUN = rf"[{WORD}]+"

# First-person word sets.
SINGULAR = ("i", "me", "my", "myself", "mine")
PLURAL = ("we", "us", "our", "ourselves", "ours")


def strip_urls(c: Column) -> Column:
    """The pattern needs "://" or "www."; a byte search spares most texts the regex."""
    t = F.coalesce(c, F.lit(""))
    may = F.contains(t, F.lit("://")) | F.contains(F.lower(t), F.lit("www."))
    return F.when(may, F.regexp_replace(t, URL, "")).otherwise(t)


def strip_emails(c: Column) -> Column:
    t = F.coalesce(c, F.lit(""))
    return F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, EMAIL, "")).otherwise(t)


def squeeze(c: Column) -> Column:
    """Collapse every run of Unicode white space to one blank and trim."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def strip_unicode(c: Column) -> Column:
    """Trim Unicode white space at both ends, inner white space kept."""
    return F.regexp_replace(c, rf"(?U)^[{WS}]+|[{WS}]+$", "")


def clean(c: Column) -> Column:
    """URLs out, lower case, white space squeezed; deleted markers become empty."""
    body = F.coalesce(c, F.lit(""))
    return F.when(body.isin(*DELETED_BODIES), F.lit("")).otherwise(squeeze(F.lower(strip_urls(body))))


def join_title(title: Column, body: Column) -> Column:
    """``title. body``, or the part that is there; each part is evaluated once."""
    return F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))


def pseudonym(author: Column, salt: str) -> Column:
    digest = F.substring(F.sha2(F.concat(author, F.lit(salt)), 256), 1, 16)
    return F.when(author.isNull() | author.isin(*NO_AUTHOR), F.lit("anonymous")).otherwise(digest)


def content_id(community: Column, created: Column, body: Column) -> Column:
    """Stable id from what a row says, its whole body included."""
    text = F.concat_ws(":", community, created.cast("string"), body)
    return F.concat(F.lit("hash_"), F.substring(F.sha2(text, 256), 1, 16))


def is_weak_id(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)), F.lit("")).isin("", "nan", "none", "null")


def slug(c: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", F.lit("unknown_file")).otherwise(s)


def tokens(c: Column, tidy: bool = False) -> Column:
    """White-space tokens without empty ones; ``tidy`` text is already squeezed."""
    t = c if tidy else squeeze(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_runs(lowered: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(lowered, F.lit(WORD_RUN), F.lit(0))


def distinct_ratio(toks: Column) -> Column:
    return F.when(F.size(toks) > 0, F.size(F.array_distinct(toks)) / F.size(toks)).otherwise(F.lit(0.0))


def sentence_count(c: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[.!?]+")))


def syllable_count(lowered: Column) -> Column:
    return F.regexp_count(lowered, F.lit("[aeiouy]+"))


def grade_level(lowered: Column, n: Column) -> Column:
    """Flesch-Kincaid grade from vowel-group syllables; no words gives 0."""
    grade = 0.39 * n / sentence_count(lowered) + 11.8 * syllable_count(lowered) / n - 15.59
    return F.when(n > 0, grade).otherwise(F.lit(0.0))


def normal_terms(terms: Iterable[str]) -> list[str]:
    return [t.strip().lower() for t in terms if t and t.strip()]


def term_pattern(term: str) -> str:
    """Word boundaries on both sides, for terms that begin or end with any character."""
    is_word = lambda ch: ch == "_" or ch.isalnum()
    before = rf"(?<![{WORD}])" if is_word(term[0]) else rf"(?<=[{WORD}])"
    after = rf"(?![{WORD}])" if is_word(term[-1]) else rf"(?=[{WORD}])"
    return before + re.escape(term) + after


def is_single_word(term: str) -> bool:
    return all(ch == "_" or ch.isalnum() for ch in term)


def _member(words: Iterable[str]):
    listed = list(words)
    return lambda x: x.isin(*listed)


def single_words(lexicons: Iterable[Iterable[str]]) -> list[str]:
    return sorted({t for terms in lexicons for t in normal_terms(terms) if is_single_word(t)})


def count_terms(lowered: Column, runs: Column, terms: Iterable[str]) -> Column:
    """Sum over terms of whole-word matches, overlaps between terms counted each.

    A term of word characters only matches exactly the word runs equal to it, so all
    such terms cost one hash-set pass over ``runs`` instead of one regex scan each
    (``runs`` may be cut down to the words of all lexicons beforehand).  Phrases fall
    back to a regex, run only on texts that contain the phrase at all.
    """
    counted = Counter(normal_terms(terms))
    parts: list[Column] = []
    by_times: dict[int, list[str]] = {}
    for term, times in counted.items():
        if is_single_word(term):
            by_times.setdefault(times, []).append(term)
        else:
            hit = F.when(F.contains(lowered, F.lit(term)), F.regexp_count(lowered, F.lit(term_pattern(term))))
            parts.append(F.coalesce(hit, F.lit(0)) * times)
    for times, words in by_times.items():
        parts.append(F.size(F.filter(runs, _member(words))) * times)
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total


def first_sentences(c: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"(?<=[.!?])\s+"), 1, n), " ")


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])
