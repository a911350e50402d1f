"""The whole way from raw posts to monitored panel on generated posts."""

from pyspark.sql import functions as F

from conftest import rows
from tidewatch.operators import temporal
from tidewatch.plans import jobs
from tidewatch.schemas import PANEL_KEYS

LEX = {"hopelessness": ["hopeless"], "help_seeking": ["need advice"], "distress": ["anxious"], "suicidality": ["end it"], "isolation": ["alone"]}
VALENCE = {"hopeless": -2.5, "anxious": -1.5, "fine": 1.5}


def raw(spark):
    i = F.col("id")
    body = F.when(i % 4 == 0, "I feel hopeless and anxious, see https://example.com/x and need advice").otherwise("Today was a fine day, I walked alone")
    return spark.range(600).select(
        F.concat(F.lit("p"), (i % 590).cast("string")).alias("post_id"), (F.lit(1704067200) + i * 15000).alias("created_utc"),
        F.concat(F.lit("Title "), i.cast("string")).alias("title"), body.alias("selftext"), (i % 50).alias("score"), (i % 20).alias("num_comments"),
        F.when(i % 2 == 0, "Depression ").otherwise("anxiety").alias("community"), F.concat(F.lit("user_"), (i % 20).cast("string")).alias("author"))


def test_posts_to_features(spark, tmp_path):
    stored = jobs.collect([raw(spark)], "salt")
    assert stored.count() == 590 and "author" not in stored.columns
    assert stored.where(F.contains("selftext", F.lit("http"))).count() == 0
    clean = jobs.store_clean(stored, f"{tmp_path}/clean")
    panel = jobs.feature_panel(clean, LEX, VALENCE)
    assert len(panel.columns) == 4 + 119
    features = [c for c in panel.columns if c not in PANEL_KEYS]
    assert temporal.null_counts(panel, features).agg(F.sum("n_null")).first()[0] == 0
    assert rows(panel.select("community").distinct()) == [("anxiety",), ("depression",)]
    direct = jobs.feature_panel(jobs.prepare(stored), LEX, VALENCE)
    cols = ("community", "week_start", "post_volume", F.round("hopelessness_density", 9), F.round("avg_compound", 9), "unique_posters")
    assert rows(panel, *cols) == rows(direct, *cols)
    narrow = panel._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp,author_hash:string>" in narrow


def test_valence_table_of_any_size(spark):
    clean = jobs.prepare(jobs.collect([raw(spark)], "salt"))
    table = spark.createDataFrame([*VALENCE.items(), *[(f"unused{k}", 1.0) for k in range(30_000)]], "token string, valence double")
    cols = ("community", "week_start", F.round("avg_compound", 9), F.round("avg_negative", 9), F.round("pct_very_negative", 9), F.round("hopelessness_density", 9))
    assert rows(jobs.feature_panel(clean, LEX, table), *cols) == rows(jobs.feature_panel(clean, LEX, VALENCE), *cols)


def test_panel_to_alerts(spark):
    clean = jobs.prepare(jobs.collect([raw(spark)], "salt"))
    out = jobs.watch(jobs.feature_panel(clean, LEX, VALENCE))
    levels = out["drift"].groupBy("community").agg(F.count("*").alias("n"), F.max("aggregate_level")).collect()
    assert all(r["n"] == 15 and 0 <= r[2] <= 3 for r in levels)
    assert out["escalations"].where("to_state <= from_state").count() == 0


def test_topic_layout(spark):
    clean = jobs.prepare(jobs.collect([raw(spark)], "salt")).withColumn("topic_id", F.length("clean_text") % 3)
    assert len(jobs.feature_panel(clean, LEX, VALENCE, topic_column="topic_id").columns) == 4 + 123
