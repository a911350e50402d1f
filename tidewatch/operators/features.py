"""Post-level text metrics and the weekly feature families built from them.

Every text becomes a handful of numbers inside the scan stage; texts are never
shuffled, collected into weekly lists or sent to Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import mathx, text
from tidewatch.operators import weekly
from tidewatch.schemas import FAMILY_COLUMNS, PER_POST_FAMILIES, PER_WORD_FAMILIES

# Sentiment bucket bounds.
SENTIMENT_BINS = {"very_negative": -0.5, "negative": -0.05, "positive": 0.05}

# Constants of the published rule-based compound score.
COMPOUND_ALPHA = 15.0
NEGATION_FACTOR = -0.74


def with_tokens(
    posts: DataFrame, column: str = "clean_text", words: Sequence[str] = (), marks: Sequence[str] = ()
) -> DataFrame:
    """``_low`` lower-cased text, ``_tok`` its white-space tokens, ``_at`` positions of marked tokens, ``_runs`` word runs.

    Cleaned text is lower-case and squeezed already, so it is cut at single blanks.  With
    ``words`` only those word runs are kept, and ``marks`` are looked up in one pass: the
    families then look at a few hits, not at every word again.
    """
    tidy = column == "clean_text"
    low = F.col(column) if tidy else F.lower(column)
    runs = text.word_runs(F.col("_low"))
    if words:
        runs = F.filter(runs, lambda x: x.isin(*words))
    base = posts.withColumn("_low", low).withColumn("_tok", text.tokens(F.col("_low"), tidy))
    return base.withColumn("_at", marked_positions(marks)).withColumn("_runs", runs)


def marked_positions(marks: Sequence[str]) -> Column:
    """Positions in ``_tok`` of the tokens that are in a word list."""
    if not marks:
        return F.array().cast("array<int>")
    return F.filter(F.transform(F.col("_tok"), lambda x, i: F.when(x.isin(*marks), i)), lambda i: i.isNotNull())


def _share(vocabulary: Sequence[str]) -> Column:
    hits = F.size(F.filter(F.col("_at"), lambda i: F.get(F.col("_tok"), i).isin(*vocabulary)))
    return F.when(F.size("_tok") > 0, hits / F.size("_tok")).otherwise(F.lit(0.0))


def linguistic_columns(column: str = "clean_text") -> dict[str, Column]:
    # Lower-casing keeps tokens apart or equal except for case, which the type-token ratio respects.
    tok = F.col("_tok")
    cased = tok if column == "clean_text" else text.tokens(F.col(column))
    return {
        "n_words": F.size(tok),
        "n_chars_clean": F.when(F.size(tok) > 0, F.length(column)).otherwise(F.lit(0)),
        "type_token_ratio": text.distinct_ratio(cased),
        "flesch_kincaid": text.grade_level(F.col("_low"), F.size(tok)),
        "singular_ratio": _share(text.SINGULAR),
        "plural_ratio": _share(text.PLURAL),
    }


FAMILIES = (*PER_WORD_FAMILIES, *PER_POST_FAMILIES)


def lexicon_columns(lexicons: Mapping[str, Iterable[str]]) -> dict[str, Column]:
    """Matches per family; a family without terms counts nothing."""
    return {f"n_{f}": text.count_terms(F.col("_low"), F.col("_runs"), lexicons.get(f, ())) for f in FAMILIES}


def post_metrics(
    posts: DataFrame, lexicons: Mapping[str, Iterable[str]], column: str = "clean_text",
    valence: Mapping[str, float] | None = None, negators: Iterable[str] = (),
) -> DataFrame:
    """Adds the per-post numbers of the linguistic and lexicon families, and of sentiment when a valence table is given.

    Tokens are cut once and shared by all families.
    """
    lists = {k: list(v) for k, v in lexicons.items()}
    marks = sorted({*text.SINGULAR, *text.PLURAL, *valence_terms(valence or {})})
    ready = with_tokens(posts, column, text.single_words(lists.values()), marks)
    made = {**linguistic_columns(column), **lexicon_columns(lists)}
    if valence is not None:
        ready = ready.withColumn("_hits", valence_hits(valence, negators))
        made |= sentiment_columns()
    return ready.select(*posts.columns, *[c.alias(n) for n, c in made.items()])


# --- sentiment ---------------------------------------------------------------


def _scores(pos: Column, neg: Column, neutral: Column, total: Column) -> dict[str, Column]:
    whole = pos + F.abs(neg) + neutral
    part = lambda x: F.when(whole > 0, x / whole).otherwise(F.lit(0.0))
    compound = total / F.sqrt(total * total + F.lit(COMPOUND_ALPHA))
    return {"pos": part(pos), "neg": part(F.abs(neg)), "neu": part(neutral),
            "compound": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), compound))}


def valence_terms(valence: Mapping[str, float]) -> list[str]:
    return sorted({t.lower() for t, v in valence.items() if v})


def valence_hits(valence: Mapping[str, float], negators: Iterable[str] = ()) -> Column:
    """Signed valences of the tokens in ``_tok`` that carry one, in order.

    Only the marked positions ``_at`` are looked at; terms of equal valence share one set.  The terms are literals of
    the plan: a hand-kept list.  A table of any size goes through ``sentiment_join``, as the caller chooses.
    """
    by_value: dict[float, list[str]] = {}
    for term, v in valence.items():
        if v:
            by_value.setdefault(float(v), []).append(term.lower())
    every = [t for ts in by_value.values() for t in ts]
    if not every:
        return F.array().cast("array<double>")
    negs = [n.lower() for n in negators]
    tok = F.col("_tok")

    def value(i: Column) -> Column:
        expr = None
        for v, terms in by_value.items():
            cond = F.get(tok, i).isin(*terms)
            expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
        signed = expr.otherwise(F.lit(0.0))
        if negs:
            signed = signed * F.when((i > 0) & F.get(tok, i - 1).isin(*negs), F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0))
        return signed

    at = F.filter(F.col("_at"), lambda i: F.get(tok, i).isin(*every))
    return F.transform(at, value)


def sentiment_columns() -> dict[str, Column]:
    """pos, neg, neu and compound from ``_tok`` and ``_hits``."""
    add = lambda keep, shift: F.aggregate(F.filter("_hits", keep), F.lit(0.0), lambda a, v: a + v + F.lit(shift))
    total = F.aggregate("_hits", F.lit(0.0), lambda a, v: a + v)
    neutral = (F.size("_tok") - F.size("_hits")).cast("double")
    return _scores(add(lambda v: v > 0, 1.0), add(lambda v: v < 0, -1.0), neutral, total)


def sentiment_inline(
    posts: DataFrame, valence: Mapping[str, float], negators: Iterable[str] = (), column: str = "clean_text"
) -> DataFrame:
    """Adds pos, neg, neu, compound; the valence table travels as literals."""
    tidy = column == "clean_text"
    tok = text.tokens(F.col(column) if tidy else F.lower(column), tidy)
    base = posts.withColumn("_tok", tok).withColumn("_at", marked_positions(valence_terms(valence)))
    base = base.withColumn("_hits", valence_hits(valence, negators))
    return base.select(*posts.columns, *[c.alias(n) for n, c in sentiment_columns().items()])


def sentiment_join(
    posts: DataFrame, valence: DataFrame, negators: DataFrame | None = None,
    column: str = "clean_text", key: str = "post_id",
) -> DataFrame:
    """The same scores with the valence table (token, valence) as a join side.

    Only token-bearing rows meet the table; the per-post sums are reduced inside the
    task that exploded the post, so the shuffle carries one row per post with a hit.
    Spark chooses the join from the size of the table.
    """
    tidy = column == "clean_text"
    base = posts.select(key, text.tokens(F.col(column) if tidy else F.lower(column), tidy).alias("_tok"))
    pairs = F.zip_with(
        F.col("_tok"), F.concat(F.array(F.lit("")), F.slice(F.col("_tok"), 1, F.greatest(F.size("_tok") - 1, F.lit(0)))),
        lambda t, p: F.struct(t.alias("token"), p.alias("previous")),
    )
    long = base.select(key, F.inline(pairs))
    hits = long.join(valence.where(F.col("valence") != 0).select(F.lower("token").alias("token"), "valence"), "token")
    if negators is not None:
        flips = negators.select(F.lower("token").alias("previous"), F.lit(NEGATION_FACTOR).alias("_flip"))
        hits = hits.join(flips.distinct(), "previous", "left")
        hits = hits.withColumn("valence", F.col("valence") * F.coalesce("_flip", F.lit(1.0)))
    v = F.col("valence")
    sums = hits.groupBy(key).agg(
        F.sum(F.when(v > 0, v + 1.0).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(v < 0, v - 1.0).otherwise(0.0)).alias("_neg"),
        F.sum(v).alias("_sum"),
        F.count("*").alias("_n"),
    )
    out = posts.join(sums, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    neutral = (F.size(text.tokens(F.col(column), tidy)) - F.coalesce("_n", F.lit(0))).cast("double")
    scores = _scores(zero("_pos"), zero("_neg"), neutral, zero("_sum"))
    return out.select(*posts.columns, *[c.alias(n) for n, c in scores.items()])


# --- weekly aggregates of post metrics ---------------------------------------


def linguistic_aggregates() -> dict[str, Column]:
    return {
        "avg_word_count": F.avg("n_words"),
        "std_word_count": F.stddev_pop("n_words"),
        "avg_char_count": F.avg("n_chars_clean"),
        "avg_type_token_ratio": F.avg("type_token_ratio"),
        "avg_flesch_kincaid": F.avg("flesch_kincaid"),
        "first_person_singular_ratio": F.avg("singular_ratio"),
        "first_person_plural_ratio": F.avg("plural_ratio"),
    }


def sentiment_aggregates(bins: Mapping[str, float] = SENTIMENT_BINS) -> dict[str, Column]:
    c = F.col("compound")
    low, mid, high = bins["very_negative"], bins["negative"], bins["positive"]
    share = lambda cond: F.avg(cond.cast("double"))
    return {
        "avg_compound": F.avg("compound"),
        "avg_positive": F.avg("pos"),
        "avg_negative": F.avg("neg"),
        "avg_neutral": F.avg("neu"),
        "pct_very_negative": share(c < low),
        "pct_negative": share((c >= low) & (c < mid)),
        "pct_neutral": share((c >= mid) & (c <= high)),
        "pct_positive": share(c > high),
    }


def lexicon_aggregates() -> dict[str, Column]:
    """First families: mean of matches per word; the others: matches per post."""
    per_word = {
        f"{f}_density": F.avg(F.when(F.col("n_words") > 0, F.col(f"n_{f}") / F.col("n_words")).otherwise(F.lit(0.0)))
        for f in PER_WORD_FAMILIES
    }
    per_post = {f"{f}_density": F.sum(f"n_{f}") / F.count("*") for f in PER_POST_FAMILIES}
    return {**per_word, **per_post}


def behavioral_columns() -> dict[str, Column]:
    """Computed on the weekly row itself."""
    return {
        "post_volume": F.col("post_count").cast("double"),
        "avg_comments": F.col("total_comments") / F.greatest(F.col("post_count"), F.lit(1)),
        "unique_posters": F.col("unique_authors").cast("double"),
        "new_poster_ratio": F.col("new_author_ratio"),
        "posting_time_entropy": mathx.entropy(F.col("hour_counts")),
    }


def weekly_features(metrics: DataFrame, families: Sequence[str] = ("linguistic", "sentiment", "distress")) -> DataFrame:
    """Feature panel (without topics): one row per community-week, gaps as zero rows.

    ``metrics`` are posts with the per-post numbers.  All families are columns of one
    aggregate, so nothing is joined on the panel key.
    """
    source = {
        "linguistic": linguistic_aggregates, "sentiment": sentiment_aggregates, "distress": lexicon_aggregates,
    }
    extra: dict[str, Column] = {}
    for f in families:
        extra.update(source[f]())
    panel = weekly.weekly_panel(metrics, extra)
    text_cols = [c for f in families for c in FAMILY_COLUMNS[f]]
    behavior = behavioral_columns()
    return panel.select(
        "community", "iso_year", "iso_week", "week_start",
        *[F.col(c).cast("double").alias(c) for c in text_cols],
        *[c.alias(n) for n, c in behavior.items()],
    )
