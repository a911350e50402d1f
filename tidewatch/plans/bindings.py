"""How the driver's tables stand in for posts, panels and predictions, in Spark and in SQL.

Orders are posts without text (community = priority, author = customer), documents are
posts with text (community = language, clock derived from the id).  The SQL fragments
describe the same rows for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.functions import mathx
from tidewatch.operators import clean, features, scoring, weekly
from tidewatch.schemas import PANEL_KEYS
from tidewatch.session import cut_lineage

# Signals of the order panel and their weights in the composite score.
WEIGHTS = {"avg_negative": 0.25, "hopelessness_density": 0.20, "help_seeking_density": 0.15, "isolation_density": 0.10,
           "suicidality_density": 0.20}
CUTS = (0.3, 0.6, 1.0)
PANEL_FEATURES = ("post_volume", "unique_posters", "new_poster_ratio", "avg_score", "avg_negative",
                  "hopelessness_density", "help_seeking_density", "isolation_density")
SIGNALS = ("avg_negative", "hopelessness_density", "isolation_density", "post_volume")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_posts(spark: SparkSession, sf: str, comments: bool = False) -> DataFrame:
    o = table(spark, sf, "orders")
    posts = o.select(
        F.col("o_orderkey").cast("string").alias("post_id"),
        clean.community_key(F.col("o_orderpriority")).alias("community"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_utc"),
        F.col("o_custkey").cast("string").alias("author_hash"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderstatus").alias("data_source"),
    )
    if comments:
        n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("post_id")).agg(F.count("*").alias("num_comments"))
        posts = posts.join(n, "post_id", "left")
    return posts


def order_extras() -> dict:
    share = lambda cond: F.avg(cond.cast("double"))
    return {
        "avg_negative": share(F.col("data_source") == "F"),
        "hopelessness_density": share(F.col("score") > 300000),
        "help_seeking_density": share(F.col("score") < 50000),
        "isolation_density": share(F.col("author_hash").cast("long") % 10 == 0),
        "suicidality_density": share((F.col("data_source") == "P") & (F.col("score") > 200000)),
    }


def order_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Gap-filled feature panel of the orders with week_idx."""
    panel = weekly.weekly_panel(order_posts(spark, sf), order_extras())
    b = features.behavioral_columns()
    shaped = panel.select(
        *PANEL_KEYS, b["post_volume"].alias("post_volume"), b["unique_posters"].alias("unique_posters"),
        b["new_poster_ratio"].alias("new_poster_ratio"), "avg_score", *order_extras(),
    )
    return weekly.with_week_index(shaped)


def scored_panel(spark: SparkSession, sf: str, normalize: bool = True) -> DataFrame:
    return scoring.composite_score(order_panel(spark, sf), WEIGHTS, normalize)


def state_panel(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.fit_states(scored_panel(spark, sf), CUTS)


def stored(df: DataFrame) -> DataFrame:
    """A panel, prediction table or model table that a query reads more than once.

    It is computed from the posts once and kept as a reliable checkpoint: these tables
    are small, the scan behind them is not.
    """
    return cut_lineage(df)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predictions_of(state_panel(spark, sf))


def predictions_of(s: DataFrame) -> DataFrame:
    """Two deterministic "models" in long form: a binary one and a 4-class one.

    Probabilities are exact ratios of weekly counts, so both engines rank alike.
    """
    whole = Window.partitionBy("community")
    rows = s.select(
        "community", "week_start", "week_idx", "label",
        (F.col("post_volume") / F.nullif(F.max("post_volume").over(whole), F.lit(0.0))).alias("pt"),
        (F.col("unique_posters") / F.nullif(F.max("unique_posters").over(whole), F.lit(0.0))).alias("ps"),
    )
    tabular = F.struct(
        F.lit("tabular").alias("model"), F.when(F.col("week_idx") >= 5, (F.col("pt") >= 0.5).cast("int")).alias("pred"),
        F.when(F.col("week_idx") >= 5, F.col("pt")).alias("prob"), (F.col("label") >= 2).cast("int").alias("actual"),
    )
    sequence = F.struct(
        F.lit("sequence").alias("model"), F.when(F.col("week_idx") >= 8, mathx.bucket(F.col("ps"), (0.35, 0.5, 0.65))).alias("pred"),
        F.when(F.col("week_idx") >= 8, F.col("ps")).alias("prob"), F.col("label").alias("actual"),
    )
    return rows.select("community", "week_start", "week_idx", F.inline(F.array(tabular, sequence)))


def binary_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Both models on the 0/1 scale."""
    p = predictions(spark, sf)
    two = F.col("model") == "sequence"
    flag = lambda c: F.when(F.col(c).isNotNull(), F.when(two, (F.col(c) >= 2).cast("int")).otherwise(F.col(c)))
    return p.withColumn("pred", flag("pred")).withColumn("actual", flag("actual"))


# --- documents as posts ------------------------------------------------------

# Term lists of words that occur in the documents, by lexicon family.
LEXICONS = {
    "hopelessness": ["the", "that was", "no point"],
    "help_seeking": ["of", "in", "need advice"],
    "distress": ["and", "of the", "was"],
    "suicidality": ["la", "was"],
    "isolation": ["der", "die", "un"],
    "economic_stress": ["is", "it"],
    "domestic_stress": ["rest", "que la"],
}
VALENCE = {"the": 0.5, "was": -1.5, "and": 1.0, "that": -2.0, "la": -1.0, "der": 1.5, "rest": -0.5, "is": 2.5}
NEGATORS = ("of", "in", "que")


def document_posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts_of_documents(table(spark, sf, "documents"))


def posts_of_documents(d: DataFrame) -> DataFrame:
    """The documents, a table or a stream, as posts."""
    day = (F.col("doc_id") * 37) % 364
    ts = F.timestamp_seconds(F.lit(1514764800) + day * 86400 + (F.col("doc_id") % 24) * 3600)
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("post_id"),
        F.col("lang").alias("community"), ts.alias("ts"), F.unix_timestamp(ts).alias("created_utc"),
        F.col("text").alias("selftext"),
        F.concat(F.lit("u"), ((F.col("doc_id") * 7) % 97).cast("string")).alias("author_hash"),
        F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") % 20).alias("num_comments"),
        F.col("source").alias("data_source"),
    )


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_posts(document_posts(spark, sf))


# --- SQL fragments -----------------------------------------------------------

POSTS = """posts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS post_id, lower(trim(o_orderpriority)) AS community, o_orderdate AS ts,
         CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(o_custkey AS VARCHAR) AS author_hash,
         o_custkey AS cust, o_totalprice AS score, o_orderstatus AS data_source
  FROM orders)"""

PANEL = POSTS + """,
obs AS (
  SELECT community, week_start, count(*) AS post_count, avg(score) AS avg_score, count(DISTINCT author_hash) AS authors,
         avg(CASE WHEN data_source = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS avg_negative,
         avg(CASE WHEN score > 300000 THEN 1.0::DOUBLE ELSE 0 END) AS hopelessness_density,
         avg(CASE WHEN score < 50000 THEN 1.0::DOUBLE ELSE 0 END) AS help_seeking_density,
         avg(CASE WHEN cust % 10 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS isolation_density,
         avg(CASE WHEN data_source = 'P' AND score > 200000 THEN 1.0::DOUBLE ELSE 0 END) AS suicidality_density
  FROM posts GROUP BY ALL),
first_seen AS (SELECT community, author_hash, min(week_start) AS week_start FROM posts GROUP BY ALL),
newcomers AS (SELECT community, week_start, count(*) AS n_new FROM (SELECT community, author_hash, min(week_start) AS week_start FROM posts GROUP BY ALL) GROUP BY ALL),
spine AS (
  SELECT community, CAST(unnest(generate_series(min(week_start)::TIMESTAMP, max(week_start)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS week_start
  FROM obs GROUP BY community),
panel AS (
  SELECT s.community, CAST(isoyear(s.week_start) AS BIGINT) AS iso_year, CAST(week(s.week_start) AS BIGINT) AS iso_week, s.week_start,
         CAST(coalesce(o.post_count, 0) AS DOUBLE) AS post_volume, CAST(coalesce(o.authors, 0) AS DOUBLE) AS unique_posters,
         CASE WHEN o.authors > 0 THEN coalesce(n.n_new, 0)::DOUBLE / o.authors ELSE 0 END AS new_poster_ratio,
         coalesce(o.avg_score, 0) AS avg_score, coalesce(avg_negative, 0) AS avg_negative,
         coalesce(hopelessness_density, 0) AS hopelessness_density, coalesce(help_seeking_density, 0) AS help_seeking_density,
         coalesce(isolation_density, 0) AS isolation_density, coalesce(suicidality_density, 0) AS suicidality_density,
         o.community IS NULL AS is_missing_week,
         row_number() OVER (PARTITION BY s.community ORDER BY s.week_start) - 1 AS week_idx
  FROM spine s LEFT JOIN obs o USING (community, week_start) LEFT JOIN newcomers n USING (community, week_start))"""


def _z(c: str) -> str:
    return (f"CASE WHEN stddev_pop({c}) OVER (PARTITION BY community) > 1e-12 THEN ({c} - avg({c}) OVER (PARTITION BY community))"
            f" / stddev_pop({c}) OVER (PARTITION BY community) ELSE 0 END")


SCORED = PANEL + ", scored AS (SELECT *, " + " + ".join(f"{w} * ({_z(c)})" for c, w in WEIGHTS.items()) + " AS distress_score FROM panel)"

RAW_SCORED = PANEL + ", scored AS (SELECT *, " + " + ".join(f"{w}::DOUBLE * {c}" for c, w in WEIGHTS.items()) + " AS distress_score FROM panel)"


def bucket_sql(value: str, cuts: tuple) -> str:
    c1, c2, c3 = cuts
    return (f"CASE WHEN {value} IS NULL THEN NULL WHEN {value} >= {c3} THEN 3 WHEN {value} >= {c2} THEN 2"
            f" WHEN {value} >= {c1} THEN 1 ELSE 0 END")


STATES = SCORED + f""",
thresholds AS (
  SELECT community, avg(distress_score) AS mean, stddev_samp(distress_score) AS std,
         avg(distress_score) + 0.3 * stddev_samp(distress_score) AS t1, avg(distress_score) + 0.6 * stddev_samp(distress_score) AS t2,
         avg(distress_score) + 1.0 * stddev_samp(distress_score) AS t3 FROM scored GROUP BY community),
states AS (
  SELECT *, {bucket_sql('distress_score', ('t1', 't2', 't3'))} AS state,
         {bucket_sql('next_score', ('t1', 't2', 't3'))} AS label,
         CASE WHEN distress_score > t3 THEN 1 ELSE 0 END AS is_crisis_week
  FROM (SELECT s.*, t1, t2, t3, lead(distress_score) OVER (PARTITION BY s.community ORDER BY week_start) AS next_score
        FROM scored s JOIN thresholds USING (community)))"""

PREDICTIONS = STATES + f""",
ratios AS (
  SELECT community, week_start, week_idx, label, post_volume / nullif(max(post_volume) OVER (PARTITION BY community), 0) AS pt,
         unique_posters / nullif(max(unique_posters) OVER (PARTITION BY community), 0) AS ps FROM states),
predictions AS (
  SELECT community, week_start, week_idx, 'tabular' AS model, CASE WHEN week_idx >= 5 THEN CASE WHEN pt >= 0.5 THEN 1 ELSE 0 END END AS pred,
         CASE WHEN week_idx >= 5 THEN pt END AS prob, CASE WHEN label IS NOT NULL THEN CASE WHEN label >= 2 THEN 1 ELSE 0 END END AS actual FROM ratios
  UNION ALL
  SELECT community, week_start, week_idx, 'sequence' AS model, CASE WHEN week_idx >= 8 THEN {bucket_sql('ps', (0.35, 0.5, 0.65))} END AS pred,
         CASE WHEN week_idx >= 8 THEN ps END AS prob, label AS actual FROM ratios),
binary_predictions AS (
  SELECT community, week_start, week_idx, model, prob,
         CASE WHEN model = 'sequence' THEN CASE WHEN pred >= 2 THEN 1 WHEN pred IS NOT NULL THEN 0 END ELSE pred END AS pred,
         CASE WHEN model = 'sequence' THEN CASE WHEN actual >= 2 THEN 1 WHEN actual IS NOT NULL THEN 0 END ELSE actual END AS actual
  FROM predictions),
evaluated AS (SELECT * FROM binary_predictions WHERE pred IS NOT NULL AND prob IS NOT NULL AND actual IS NOT NULL)"""

SPACE = r"[\s\x0B\x1c-\x1f\x85\p{Z}]+"

DOCUMENTS = r"""posts AS (
  SELECT 'd' || doc_id AS post_id, lang AS community, TIMESTAMP '2018-01-01' + to_days(CAST((doc_id * 37) % 364 AS INTEGER)) + to_hours(doc_id % 24) AS ts,
         text AS selftext, 'u' || ((doc_id * 7) % 97) AS author_hash, CAST(n_chars AS DOUBLE) AS score, doc_id % 20 AS num_comments, source AS data_source, doc_id
  FROM documents),
cleaned AS (
  SELECT * FROM (
    SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week_start,
           trim(regexp_replace(lower(regexp_replace(selftext, '(?i)https?://\S+|www\.\S+', '', 'g')), '""" + SPACE + r"""', ' ', 'g')) AS clean_text
    FROM posts WHERE selftext NOT IN ('[deleted]', '[removed]', ''))
  WHERE length(clean_text) >= 20),
tokened AS (SELECT *, [x for x in string_split(clean_text, ' ') if x <> ''] AS tok FROM cleaned)"""
