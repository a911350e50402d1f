import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidewatch.functions import text
from tidewatch.operators import clean, features


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr).first()[0]


def test_pseudonyms(spark):
    h = lambda a, s: one(spark, text.pseudonym(F.col("c0"), s), a)
    assert h("bob", "x") == h("bob", "x") != h("bob", "y")
    assert len(h("bob", "x")) == 16
    assert [h(a, "x") for a in ("[deleted]", "", "None", None)] == ["anonymous"] * 4


@pytest.mark.parametrize("given,want", [
    ("See HTTPS://a.b/c?d now", "see now"), ("www.x.org  and\tMORE ", "and more"), ("[deleted]", ""), ("", ""), (None, ""),
    ("a  b\x1cc", "a b c"), ("  Plain  Text\n\n", "plain text"),
])
def test_clean(spark, given, want):
    assert one(spark, text.clean(F.col("c0")), given) == want


def test_emails(spark):
    assert one(spark, text.strip_emails(F.col("c0")), "write to Me.x+1@mail.example.org!") == "write to !"


def test_title_and_minimum_length(spark):
    posts = spark.createDataFrame(
        [("T", "Body of the post is long"), (None, "Body of the post is long"), ("T", "short"), ("T", "[removed]")], "title string, selftext string")
    got = [r["clean_text"] for r in clean.clean_posts(posts).orderBy("clean_text").collect()]
    assert got == ["body of the post is long", "t. body of the post is long"]


def test_cleaning_is_evaluated_once(spark):
    posts = spark.range(3).select(F.lit("A Text That Is Long Enough").alias("selftext"))
    plan = clean.clean_posts(posts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") <= 2


TERMS = ["hopeless", "no point", "self-harm", "can't", "naïve", "point", "point"]
TEXTS = [
    "hopeless, hopeless and hopelessness. no point; no  point", "self-harm self harm self-harming", "can't cannot can't.", "naïve naïvely xnaïve",
    "point point_a point", "", "éhopeless hopeless2 (hopeless)", "no point no point", "époint",
]


def test_term_counts_match_word_boundaries(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    low = F.lower("t")
    got = [r[0] for r in df.select(text.count_terms(low, text.word_runs(low), TERMS)).collect()]
    want = [sum(len(re.findall(r"\b" + re.escape(w) + r"\b", t.lower())) for w in TERMS) for t in TEXTS]
    assert got == want


def test_kept_runs_do_not_change_counts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "clean_text string")
    m = features.post_metrics(df, {"hopelessness": TERMS, "distress": ["self"]})
    low = F.col("clean_text")
    want = [r[0] for r in df.select(text.count_terms(low, text.word_runs(low), TERMS)).collect()]
    assert [r["n_hopelessness"] for r in m.collect()] == want


def test_lexicon_densities(spark):
    lex = {"hopelessness": ["hopeless", "no point"], "help_seeking": ["need advice", "anyone else"], "distress": ["anxious", "depressed"]}
    posts = spark.createDataFrame([("i feel hopeless and anxious, need advice",), ("a quiet sunny walk outside",)], "clean_text string")
    got = features.post_metrics(posts, lex).select("n_hopelessness", "n_help_seeking", "n_distress").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (0, 0, 0)]


def test_pronouns_and_ratio(spark):
    posts = spark.createDataFrame([("i think my day was ours i",), ("",)], "clean_text string")
    a, b = features.post_metrics(posts, {}).collect()
    assert (a["n_words"], a["singular_ratio"], a["plural_ratio"]) == (7, 3 / 7, 1 / 7)
    assert a["type_token_ratio"] == 6 / 7
    assert (b["n_words"], b["n_chars_clean"], b["type_token_ratio"], b["flesch_kincaid"]) == (0, 0, 0.0, 0.0)


def test_uncleaned_column_keeps_case_in_ratio(spark):
    posts = spark.createDataFrame([("The the  THE me",)], "body string")
    r = features.post_metrics(posts, {}, "body").first()
    assert (r["n_words"], r["type_token_ratio"], r["singular_ratio"]) == (4, 1.0, 0.25)


VALENCE = {"good": 2.0, "bad": -2.5, "fine": 1.0, "awful": -2.5}


def test_sentiment_sign_and_both_paths(spark):
    posts = spark.createDataFrame(
        [("1", "a bad awful day"), ("2", "good fine people"), ("3", "not good at all"), ("4", "nothing here"), ("5", "")], "post_id string, clean_text string")
    a = features.sentiment_inline(posts, VALENCE, ["not"])
    b = features.sentiment_join(posts, spark.createDataFrame(list(VALENCE.items()), "token string, valence double"), spark.createDataFrame([("not",)], "token string"))
    cols = ("post_id", *[F.round(c, 9) for c in ("pos", "neg", "neu", "compound")])
    assert rows(a, *cols) == rows(b, *cols)
    c = {r["post_id"]: r["compound"] for r in a.collect()}
    assert c["1"] < 0 < c["2"] and c["3"] < 0 and c["4"] == c["5"] == 0
    assert c["1"] == pytest.approx(-5 / (25 + 15) ** 0.5)


def test_sentiment_buckets_are_closed_around_zero(spark):
    df = spark.createDataFrame([(-0.6,), (-0.5,), (-0.05,), (0.05,), (0.051,)], "compound double").withColumn("pos", F.lit(0.0)).withColumn("neg", F.lit(0.0)).withColumn("neu", F.lit(0.0))
    r = df.agg(*[c.alias(n) for n, c in features.sentiment_aggregates().items()]).first()
    assert (r["pct_very_negative"], r["pct_negative"], r["pct_neutral"], r["pct_positive"]) == (0.2, 0.2, 0.4, 0.2)


def test_small_helpers(spark):
    assert one(spark, text.slug(F.col("c0")), "My File (1).csv") == "my_file_1_csv"
    assert one(spark, text.first_sentences(F.col("c0")), "One. Two! Three? Four.") == "One. Two! Three?"
    assert one(spark, text.first_non_blank(F.col("c0"), F.col("c1")), " ", "x") == "x"
    assert one(spark, text.is_weak_id(F.col("c0")), " NaN ") is True
