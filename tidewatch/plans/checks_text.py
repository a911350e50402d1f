"""Queries over post texts: tokens, lexicons, sentiment, weekly text families, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import dates, mathx, text
from tidewatch.operators import density, features, monitor, scoring, temporal, topics, weekly
from tidewatch.plans import bindings as b
from tidewatch.plans import jobs
from tidewatch.plans.registry import query, shown
from tidewatch.schemas import PER_POST_FAMILIES, PER_WORD_FAMILIES

WORDCHAR = r"\pL\pN_"


def term_count_sql(term: str) -> str:
    """Whole-word matches of a term; separators are doubled so neighbours never share one."""
    spread = f"regexp_replace(clean_text, '([^{WORDCHAR}])', '\\1\\1', 'g')"
    needle = term.replace(" ", "  ")
    return f"len(regexp_extract_all({spread}, '(?:^|[^{WORDCHAR}]){needle}(?:[^{WORDCHAR}]|$)'))"


def family_sql(family: str) -> str:
    return "(" + " + ".join(term_count_sql(t) for t in b.LEXICONS[family]) + ")"


FAMILIES = (*PER_WORD_FAMILIES, *PER_POST_FAMILIES)
COUNTED = b.DOCUMENTS + ", counted AS (SELECT post_id, community, week_start, len(tok) AS n_words, " + ", ".join(f"{family_sql(f)} AS n_{f}" for f in FAMILIES) + " FROM tokened)"


@query("lexicon_counts", "WITH " + COUNTED + " SELECT post_id, " + ", ".join(f"CAST(n_{f} AS BIGINT) AS n_{f}" for f in FAMILIES) + " FROM counted")
def lexicon_counts(spark, sf):
    m = features.post_metrics(b.clean_documents(spark, sf), b.LEXICONS)
    return shown(m.select("post_id", *[f"n_{f}" for f in FAMILIES]))


@query("lexicon_density", "WITH " + COUNTED + " SELECT community, week_start, count(*) AS n_posts, " + ", ".join(
    f"round(avg(CASE WHEN n_words > 0 THEN n_{f}::DOUBLE / n_words ELSE 0 END), 6) AS {f}_density" for f in PER_WORD_FAMILIES) + ", " + ", ".join(
    f"round(sum(n_{f})::DOUBLE / count(*), 6) AS {f}_density" for f in PER_POST_FAMILIES) + " FROM counted GROUP BY ALL")
def lexicon_density(spark, sf):
    m = weekly.with_week(features.post_metrics(b.clean_documents(spark, sf), b.LEXICONS))
    aggs = [c.alias(n) for n, c in features.lexicon_aggregates().items()]
    return shown(m.groupBy("community", "week_start").agg(F.count("*").alias("n_posts"), *aggs))


LINGUISTIC = b.DOCUMENTS + """, ling AS (SELECT post_id, community, week_start, len(tok) AS n_words, length(clean_text) AS n_chars,
  len(list_distinct(tok))::DOUBLE / len(tok) AS ttr,
  0.39::DOUBLE * len(tok) / greatest(1, len(regexp_extract_all(clean_text, '[.!?]+'))) + 11.8::DOUBLE * len(regexp_extract_all(clean_text, '[aeiouy]+')) / len(tok) - 15.59::DOUBLE AS grade,
  len([x for x in tok if x IN ('i', 'me', 'my', 'myself', 'mine')])::DOUBLE / len(tok) AS singular,
  len([x for x in tok if x IN ('we', 'us', 'our', 'ourselves', 'ours')])::DOUBLE / len(tok) AS plural FROM tokened)"""


@query("linguistic_posts", "WITH " + LINGUISTIC + """ SELECT post_id, n_words, n_chars AS n_chars_clean, round(ttr, 6) AS type_token_ratio, round(grade, 4) AS flesch_kincaid,
  round(singular, 6) AS singular_ratio, round(plural, 6) AS plural_ratio FROM ling""")
def linguistic_posts(spark, sf):
    m = features.post_metrics(b.clean_documents(spark, sf), {})
    return shown(m.select("post_id", "n_words", "n_chars_clean", "type_token_ratio", F.round("flesch_kincaid", 4).alias("flesch_kincaid"), "singular_ratio", "plural_ratio"))


@query("linguistic", "WITH " + LINGUISTIC + """ SELECT community, week_start, round(avg(n_words), 4) AS avg_word_count, round(stddev_pop(n_words), 4) AS std_word_count,
  round(avg(n_chars), 4) AS avg_char_count, round(avg(ttr), 4) AS avg_type_token_ratio, round(avg(grade), 4) AS avg_flesch_kincaid,
  round(avg(singular), 6) AS first_person_singular_ratio, round(avg(plural), 6) AS first_person_plural_ratio FROM ling GROUP BY ALL""")
def linguistic(spark, sf):
    m = weekly.with_week(features.post_metrics(b.clean_documents(spark, sf), {}))
    g = m.groupBy("community", "week_start").agg(*[c.alias(n) for n, c in features.linguistic_aggregates().items()])
    four = ("avg_word_count", "std_word_count", "avg_char_count", "avg_type_token_ratio", "avg_flesch_kincaid")
    return shown(g.select("community", "week_start", *[F.round(c, 4).alias(c) for c in four], "first_person_singular_ratio", "first_person_plural_ratio"))


VALENCE_SQL = "CASE lower(t.x) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in b.VALENCE.items()) + " ELSE 0 END"
SENTIMENT = b.DOCUMENTS + f""", toks AS (SELECT post_id, x, lag(x) OVER (PARTITION BY post_id ORDER BY i) AS p FROM (SELECT post_id, unnest(tok) AS x, generate_subscripts(tok, 1) AS i FROM tokened)),
valued AS (SELECT post_id, {VALENCE_SQL} * CASE WHEN p IN {b.NEGATORS} THEN -0.74::DOUBLE ELSE 1 END AS v FROM toks t),
sums AS (SELECT post_id, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS pos, sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END) AS neg, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS neu, sum(v) AS s FROM valued GROUP BY post_id),
sentiment AS (SELECT post_id, pos / (pos + abs(neg) + neu) AS pos, abs(neg) / (pos + abs(neg) + neu) AS neg, neu / (pos + abs(neg) + neu) AS neu, greatest(-1, least(1, s / sqrt(s * s + 15))) AS compound FROM sums)"""
SCORES = "round(pos, 6) AS pos, round(neg, 6) AS neg, round(neu, 6) AS neu, round(compound, 6) + 0.0 AS compound"


@query("lexicon_sentiment", "WITH " + SENTIMENT + f" SELECT post_id, {SCORES} FROM sentiment")
def lexicon_sentiment(spark, sf):
    s = features.sentiment_inline(b.clean_documents(spark, sf), b.VALENCE, b.NEGATORS)
    return shown(s.select("post_id", "pos", "neg", "neu", "compound"))


@query("lexicon_sentiment_table", "WITH " + SENTIMENT + f" SELECT post_id, {SCORES} FROM sentiment")
def lexicon_sentiment_table(spark, sf):
    valence = spark.createDataFrame(list(b.VALENCE.items()), "token string, valence double")
    negators = spark.createDataFrame([(n,) for n in b.NEGATORS], "token string")
    s = features.sentiment_join(b.clean_documents(spark, sf), valence, negators)
    return shown(s.select("post_id", "pos", "neg", "neu", "compound"))


@query("sentiment_weekly", "WITH " + SENTIMENT + """ SELECT community, week_start, round(avg(compound), 6) + 0.0 AS avg_compound, round(avg(pos), 6) AS avg_positive, round(avg(neg), 6) AS avg_negative, round(avg(neu), 6) AS avg_neutral,
  round(avg(CASE WHEN compound < -0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_very_negative, round(avg(CASE WHEN compound >= -0.5 AND compound < -0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_negative,
  round(avg(CASE WHEN compound >= -0.05 AND compound <= 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_neutral, round(avg(CASE WHEN compound > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_positive
FROM cleaned JOIN sentiment USING (post_id) GROUP BY ALL""")
def sentiment_weekly(spark, sf):
    s = weekly.with_week(features.sentiment_inline(b.clean_documents(spark, sf), b.VALENCE, b.NEGATORS))
    return shown(s.groupBy("community", "week_start").agg(*[c.alias(n) for n, c in features.sentiment_aggregates().items()]))


@query("sentiment_buckets", """SELECT lower(event_type) AS community, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n,
  round(avg(CASE WHEN c < -0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_very_negative, round(avg(CASE WHEN c >= -0.5 AND c < -0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_negative,
  round(avg(CASE WHEN c >= -0.05 AND c <= 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_neutral, round(avg(CASE WHEN c > 0.05 THEN 1.0::DOUBLE ELSE 0 END), 6) AS pct_positive
FROM (SELECT *, (CAST(json_extract(props, '$.k') AS INTEGER) - 50) / 50.0::DOUBLE AS c FROM events) GROUP BY ALL""")
def sentiment_buckets(spark, sf):
    k = F.from_json("props", "k int")["k"]
    e = b.table(spark, sf, "events").select(F.col("event_type").alias("community"), F.col("ts").cast("timestamp").alias("ts"), ((k - 50) / F.lit(50.0)).alias("compound"))
    keep = {n: c for n, c in features.sentiment_aggregates().items() if n.startswith("pct_")}
    return shown(weekly.with_week(e).groupBy("community", "week_start").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in keep.items()]))


@query("behavioral_entropy", """WITH h AS (SELECT event_type AS community, CAST(date_trunc('week', ts) AS DATE) AS week_start, extract(hour FROM ts) AS h, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY community, week_start)::DOUBLE AS p FROM h),
a AS (SELECT community, user_id, min(CAST(date_trunc('week', ts) AS DATE)) AS week_start FROM (SELECT *, event_type AS community FROM events) GROUP BY ALL),
nw AS (SELECT community, week_start, count(*) AS k FROM a GROUP BY ALL),
u AS (SELECT event_type AS community, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL)
SELECT community, week_start, CAST(max(u.n) AS DOUBLE) AS post_volume, CAST(max(users) AS DOUBLE) AS unique_posters, round(coalesce(max(k), 0)::DOUBLE / max(users), 6) AS new_poster_ratio,
       round(-sum(p * ln(p)), 6) AS posting_time_entropy FROM s JOIN u USING (community, week_start) LEFT JOIN nw USING (community, week_start) GROUP BY ALL""")
def behavioral_entropy(spark, sf):
    e = b.table(spark, sf, "events").select(
        F.col("event_type").alias("community"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("author_hash"))
    c = features.behavioral_columns()
    p = weekly.weekly_panel(e)
    return shown(p.select("community", "week_start", *[c[n].alias(n) for n in ("post_volume", "unique_posters", "new_poster_ratio", "posting_time_entropy")]))


TOPIC = """tposts AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS community, CASE WHEN label = 9 THEN -1 ELSE label END AS topic,
  CAST(date_trunc('week', TIMESTAMP '2018-01-01' + to_days(CAST((vec_id * 37) % 364 AS INTEGER))) AS DATE) AS week_start FROM embeddings),
tc AS (SELECT community, week_start, topic, count(*) AS n FROM tposts WHERE topic >= 0 GROUP BY ALL),
share AS (SELECT *, n / sum(n) OVER (PARTITION BY community, week_start)::DOUBLE AS p FROM tc),
wk AS (SELECT community, week_start, arg_max(topic, n * 1000 - topic) AS dominant_topic, -sum(p * log2(p)) AS entropy,
       row_number() OVER (PARTITION BY community ORDER BY week_start) AS r FROM share GROUP BY community, week_start)"""


def _jsd_sql(back: int) -> str:
    return f"""jsd{back} AS (SELECT community, week_start, sqrt(greatest(sum(
    CASE WHEN a > 0 THEN a * ln(a / ((a + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((a + q) / 2)) ELSE 0 END) / 2, 0)) AS d FROM (
    SELECT w.community, w.week_start, t.topic, coalesce(x.p, 0) AS q, coalesce(y.p, 0) AS a FROM wk w JOIN wk v ON v.community = w.community AND v.r = w.r - {back}
    CROSS JOIN (SELECT DISTINCT topic FROM tc) t LEFT JOIN share x ON x.community = w.community AND x.week_start = w.week_start AND x.topic = t.topic
    LEFT JOIN share y ON y.community = v.community AND y.week_start = v.week_start AND y.topic = t.topic) GROUP BY ALL)"""


def _topic_posts(spark, sf):
    e = b.table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("post_id"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("community"),
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic_id"),
        F.timestamp_seconds(F.lit(1514764800) + (F.col("vec_id") * 37) % 364 * 86400).alias("ts"))


@query("topic_entropy", "WITH " + TOPIC + " SELECT community, week_start, CAST(dominant_topic AS BIGINT) AS dominant_topic, round(entropy, 6) + 0.0 AS topic_entropy FROM wk")
def topic_entropy(spark, sf):
    m = topics.topic_mix(topics.topic_counts(_topic_posts(spark, sf)))
    return shown(m.select("community", "week_start", "dominant_topic", "topic_entropy"))


@query("topic_shift_jsd", "WITH " + TOPIC + "," + _jsd_sql(1) + "," + _jsd_sql(4) + """
SELECT w.community, w.week_start, CAST(dominant_topic AS BIGINT) AS dominant_topic, round(entropy, 6) + 0.0 AS topic_entropy, round(coalesce(a.d, 0), 5) + 0.0 AS topic_shift_jsd, round(coalesce(c.d, 0), 5) + 0.0 AS topic_shift_jsd_4w
FROM wk w LEFT JOIN jsd1 a USING (community, week_start) LEFT JOIN jsd4 c USING (community, week_start)""")
def topic_shift_jsd(spark, sf):
    t = topics.topic_features(topics.topic_counts(_topic_posts(spark, sf)))
    return shown(t.select("community", "week_start", "dominant_topic", "topic_entropy", F.round("topic_shift_jsd", 5).alias("topic_shift_jsd"), F.round("topic_shift_jsd_4w", 5).alias("topic_shift_jsd_4w")))


@query("token_stats", "WITH " + b.DOCUMENTS + """ SELECT post_id, len(tok) AS n_tokens, len(list_distinct(tok)) AS n_distinct, list_max([length(x) for x in tok]) AS longest,
  len([x for x in tok if x = 'the']) AS n_the FROM tokened""")
def token_stats(spark, sf):
    t = b.clean_documents(spark, sf).withColumn("tok", text.tokens(F.col("clean_text"), tidy=True))
    return shown(t.select("post_id", F.size("tok").alias("n_tokens"), F.size(F.array_distinct("tok")).alias("n_distinct"),
                          F.array_max(F.transform("tok", F.length)).alias("longest"), F.size(F.filter("tok", lambda x: x == "the")).alias("n_the")))


@query("first_sentences", r"""SELECT doc_id, sha256(trim(regexp_extract(s, '^((?:[^\x01]*\x01){0,2}[^\x01]*)', 1)).replace(chr(1), ' ')) AS head_hash FROM (
  SELECT doc_id, regexp_replace(trim(text), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g') AS s FROM documents)""")
def first_sentences(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.sha2(text.first_sentences(F.col("text")), 256).alias("head_hash"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"event_type\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS packed FROM events")
def json_props(spark, sf):
    e = b.table(spark, sf, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.select("event_id", "k", F.to_json(F.struct("event_type", "k")).alias("packed"))


@query("number_coercion", """SELECT c_custkey, try_cast(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS amount,
  CASE WHEN c_acctbal >= 5000 THEN 3 WHEN c_acctbal >= 2000 THEN 2 WHEN c_acctbal >= 0 THEN 1 ELSE 0 END::BIGINT AS bucket FROM customer""")
def number_coercion(spark, sf):
    c = b.table(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_acctbal").cast("string"))
    return c.select("c_custkey", dates.number_or_null(raw).alias("amount"), mathx.bucket(F.col("c_acctbal"), (0, 2000, 5000)).cast("long").alias("bucket"))


@query("week_keys", """SELECT DISTINCT CAST(isoyear(o_orderdate) AS BIGINT) AS iso_year, CAST(week(o_orderdate) AS BIGINT) AS iso_week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday,
  CAST(isoyear(o_orderdate) * 100 + week(o_orderdate) AS BIGINT) AS iso_key, strftime(o_orderdate, '%G-W%V') AS week_key, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS label FROM orders""")
def week_keys(spark, sf):
    d = dates.week_start(F.col("o_orderdate"))
    y, w = dates.iso_year(d), dates.iso_week(d)
    o = b.table(spark, sf, "orders").select(y.alias("iso_year"), w.alias("iso_week")).distinct()
    m = dates.iso_monday(F.col("iso_year"), F.col("iso_week"))
    return shown(o.select("iso_year", "iso_week", m.alias("monday"), dates.iso_key(F.col("iso_year"), F.col("iso_week")).alias("iso_key"),
                          dates.week_key(F.col("iso_year"), F.col("iso_week")).alias("week_key"), dates.week_label(m).alias("label")))


# --- the whole feature job and its monitors over the documents ----------------

WEEKLY_TEXT = SENTIMENT + COUNTED.removeprefix(b.DOCUMENTS) + """,
obs AS (SELECT c.community, c.week_start, count(*) AS n, avg(sm.neg) AS avg_negative, avg(CASE WHEN k.n_words > 0 THEN k.n_hopelessness::DOUBLE / k.n_words ELSE 0 END) AS hopelessness_density,
  avg(CASE WHEN k.n_words > 0 THEN k.n_help_seeking::DOUBLE / k.n_words ELSE 0 END) AS help_seeking_density, sum(k.n_suicidality)::DOUBLE / count(*) AS suicidality_density, sum(k.n_isolation)::DOUBLE / count(*) AS isolation_density,
  sum(k.n_economic_stress)::DOUBLE / count(*) AS economic_stress_density, sum(k.n_domestic_stress)::DOUBLE / count(*) AS domestic_stress_density, sum(num_comments)::DOUBLE / count(*) AS avg_comments, count(DISTINCT author_hash) AS authors
  FROM cleaned c JOIN sentiment sm USING (post_id) JOIN counted k USING (post_id) GROUP BY ALL),
spine AS (SELECT community, CAST(unnest(generate_series(min(week_start)::TIMESTAMP, max(week_start)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_start FROM obs GROUP BY community),
panel AS (SELECT s.community, s.week_start, CAST(coalesce(n, 0) AS DOUBLE) AS post_volume, CAST(coalesce(authors, 0) AS DOUBLE) AS unique_posters, coalesce(avg_comments, 0) AS avg_comments, coalesce(avg_negative, 0) AS avg_negative,
  coalesce(hopelessness_density, 0) AS hopelessness_density, coalesce(help_seeking_density, 0) AS help_seeking_density, coalesce(suicidality_density, 0) AS suicidality_density, coalesce(isolation_density, 0) AS isolation_density,
  coalesce(economic_stress_density, 0) AS economic_stress_density, coalesce(domestic_stress_density, 0) AS domestic_stress_density FROM spine s LEFT JOIN obs USING (community, week_start))"""
def _document_panel(spark, sf):
    return jobs.feature_panel(b.clean_documents(spark, sf), b.LEXICONS, b.VALENCE, b.NEGATORS)


# Every core column of the matrix from the post-level tables above; topics, which need a fitted model, are zero here.
OBSERVED = {
    "avg_word_count": "avg(l.n_words)", "std_word_count": "stddev_pop(l.n_words)", "avg_char_count": "avg(l.n_chars)",
    "avg_type_token_ratio": "avg(l.ttr)", "avg_flesch_kincaid": "avg(l.grade)", "first_person_singular_ratio": "avg(l.singular)",
    "first_person_plural_ratio": "avg(l.plural)", "avg_compound": "avg(sm.compound)", "avg_positive": "avg(sm.pos)",
    "avg_negative": "avg(sm.neg)", "avg_neutral": "avg(sm.neu)",
    "pct_very_negative": "avg(CASE WHEN sm.compound < -0.5 THEN 1.0::DOUBLE ELSE 0 END)",
    "pct_negative": "avg(CASE WHEN sm.compound >= -0.5 AND sm.compound < -0.05 THEN 1.0::DOUBLE ELSE 0 END)",
    "pct_neutral": "avg(CASE WHEN sm.compound >= -0.05 AND sm.compound <= 0.05 THEN 1.0::DOUBLE ELSE 0 END)",
    "pct_positive": "avg(CASE WHEN sm.compound > 0.05 THEN 1.0::DOUBLE ELSE 0 END)",
    **{f"{f}_density": f"avg(CASE WHEN k.n_words > 0 THEN k.n_{f}::DOUBLE / k.n_words ELSE 0 END)" for f in PER_WORD_FAMILIES},
    **{f"{f}_density": f"sum(k.n_{f})::DOUBLE / count(*)" for f in PER_POST_FAMILIES},
    "post_volume": "count(*)::DOUBLE", "avg_comments": "sum(c.num_comments)::DOUBLE / count(*)", "unique_posters": "count(DISTINCT c.author_hash)::DOUBLE",
}
CORE = (*OBSERVED, "new_poster_ratio", "posting_time_entropy", "topic_entropy", "topic_shift_jsd")
MATRIX = SENTIMENT + COUNTED.removeprefix(b.DOCUMENTS) + LINGUISTIC.removeprefix(b.DOCUMENTS) + f""",
obs AS (SELECT c.community, c.week_start, {", ".join(f"{sql} AS {c}" for c, sql in OBSERVED.items())}
  FROM cleaned c JOIN sentiment sm USING (post_id) JOIN counted k USING (post_id) JOIN ling l USING (post_id) GROUP BY ALL),
fresh AS (SELECT community, week_start, count(*) AS k FROM (SELECT community, author_hash, min(week_start) AS week_start FROM cleaned GROUP BY ALL) GROUP BY ALL),
hours AS (SELECT community, week_start, -sum(p * ln(p)) AS h FROM (SELECT community, week_start, count(*) / sum(count(*)) OVER (PARTITION BY community, week_start)::DOUBLE AS p
  FROM cleaned GROUP BY community, week_start, extract(hour FROM ts)) GROUP BY ALL),
spine AS (SELECT community, CAST(unnest(generate_series(min(week_start)::TIMESTAMP, max(week_start)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_start FROM obs GROUP BY community),
panel AS (SELECT s.community, s.week_start, {", ".join(f"coalesce(o.{c}, 0) AS {c}" for c in OBSERVED)},
  coalesce(coalesce(f.k, 0)::DOUBLE / o.unique_posters, 0) AS new_poster_ratio, coalesce(h.h, 0) AS posting_time_entropy, 0.0::DOUBLE AS topic_entropy, 0.0::DOUBLE AS topic_shift_jsd
  FROM spine s LEFT JOIN obs o USING (community, week_start) LEFT JOIN fresh f USING (community, week_start) LEFT JOIN hours h USING (community, week_start))"""


def _trailing(column: str, weeks: int) -> str:
    return f"round(avg({column}) OVER (PARTITION BY community ORDER BY week_start ROWS BETWEEN {weeks - 1} PRECEDING AND CURRENT ROW), 4) + 0.0 AS {column}_roll{weeks}w"


@query("feature_matrix", f"""WITH {MATRIX} SELECT community, week_start, CAST(extract(isoyear FROM week_start) AS BIGINT) AS iso_year, CAST(extract(week FROM week_start) AS BIGINT) AS iso_week, CAST(0 AS BIGINT) AS dominant_topic,
  {", ".join(f"round({c}, 4) + 0.0 AS {c}, round(coalesce({c} - lag({c}) OVER w, 0), 4) + 0.0 AS {c}_delta, {_trailing(c, 2)}, {_trailing(c, 4)}" for c in CORE)},
  round(sin(2 * pi() * extract(week FROM week_start) / 52), 4) + 0.0 AS week_sin, round(cos(2 * pi() * extract(week FROM week_start) / 52), 4) + 0.0 AS week_cos
  FROM panel WINDOW w AS (PARTITION BY community ORDER BY week_start)""")
def feature_matrix(spark, sf):
    """All columns: 29 core ones with change and two trailing means each, topic, season and keys."""
    return shown(_document_panel(spark, sf), 4)


TEXT_SIGNALS = ("avg_negative", "hopelessness_density", "suicidality_density", "isolation_density", "post_volume")


def _z12(c: str) -> str:
    w = "(PARTITION BY community ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    return f"abs(coalesce(CASE WHEN stddev_samp({c}) OVER {w} > 1e-12 THEN ({c} - avg({c}) OVER {w}) / stddev_samp({c}) OVER {w} ELSE 0 END, 0))"


@query("text_drift", "WITH " + WEEKLY_TEXT + ", m AS (SELECT community, week_start, round(greatest(" + ", ".join(_z12(c) for c in TEXT_SIGNALS) + "), 9) AS m FROM panel) SELECT community, week_start, CAST(CASE WHEN m >= 3 THEN 3 WHEN m >= 2 THEN 2 WHEN m >= 1 THEN 1 ELSE 0 END AS BIGINT) AS aggregate_level FROM m")
def text_drift(spark, sf):
    return shown(monitor.drift(_document_panel(spark, sf), TEXT_SIGNALS).select("community", "week_start", "aggregate_level"))


SCORE = {"avg_negative": 0.25, "hopelessness_density": 0.2, "help_seeking_density": 0.15, "suicidality_density": 0.2, "isolation_density": 0.1, "economic_stress_density": 0.05, "domestic_stress_density": 0.05}


@query("text_score", "WITH " + WEEKLY_TEXT + " SELECT community, week_start, round(" + " + ".join(f"{w}::DOUBLE * {c}" for c, w in SCORE.items()) + ", 5) AS distress_score FROM panel")
def text_score(spark, sf):
    return shown(scoring.composite_score(_document_panel(spark, sf), normalize=False).select("community", "week_start", "distress_score"), 5)


@query("weekly_cap", "WITH " + b.DOCUMENTS + " SELECT community, week_start, least(count(*), 5) AS n_posts FROM cleaned GROUP BY ALL")
def weekly_cap(spark, sf):
    """Sampling operator: at most 5 posts per community and week (the draw itself is checked by tests)."""
    s = topics.cap_per_week(b.clean_documents(spark, sf), 5)
    return weekly.with_week(s).groupBy("community", "week_start").agg(F.count("*").alias("n_posts"))


@query("topic_model")
def topic_model(spark, sf):
    """Fitted topics of the documents and their weekly features."""
    from tidewatch.operators import learn

    posts = b.clean_documents(spark, sf)
    counted = b.stored(learn.word_counts(posts).select("community", "ts", "features"))
    model = learn.fit_topics(counted)
    if model is None:
        return topics.no_topics(weekly.weekly_panel(posts)).select("community", "week_start", "dominant_topic", "topic_entropy", "topic_shift_jsd")
    return shown(topics.topic_features(topics.topic_counts(learn.assign_topics(counted, model))))


def _density(spark, sf):
    """Documents with topics by density: hashed word vectors, one topic or -1 for each document with words."""
    docs = b.clean_documents(spark, sf)
    found = density.density_topics(density.hashed_vectors(docs, "post_id"), "post_id")
    return docs, b.stored(found)


@query("density_topics")
def density_topics(spark, sf):
    """Topic of every document, -1 for outliers; tested against a plain clustering of the complete graph."""
    return _density(spark, sf)[1]


@query("density_topic_terms")
def density_topic_terms(spark, sf):
    """The words of each topic by class-based weight."""
    docs, found = _density(spark, sf)
    return shown(density.topic_terms(docs.join(found, "post_id")))


@query("density_topic_features")
def density_topic_features(spark, sf):
    """Fit, assign and attach: weekly topic features on the panel."""
    docs, found = _density(spark, sf)
    features = topics.topic_features(topics.topic_counts(docs.join(found, "post_id")))
    return shown(topics.attach_topics(weekly.weekly_panel(docs).select("community", "week_start"), features))
