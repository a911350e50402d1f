"""Queries over the weekly panel: aggregation, quality, temporal features, score, folds, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import folds, monitor, scoring, stats, temporal, weekly
from tidewatch.plans import bindings as b
from tidewatch.plans.registry import query, shown

FIRST, LAST = "1995-01-01", "2001-09-01"


@query("weekly_panel", "WITH " + b.PANEL + """,
comments AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, lower(trim(o_orderpriority)) AS community, count(*) AS n
             FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT p.community, iso_year, iso_week, p.week_start, CAST(post_volume AS BIGINT) AS post_count, CAST(round(avg_score * post_volume * 100) AS BIGINT) AS score_cents,
       CAST(coalesce(c.n, 0) AS DOUBLE) AS total_comments, CAST(unique_posters AS BIGINT) AS unique_authors,
       round(new_poster_ratio, 4) AS new_author_ratio, is_missing_week
FROM panel p LEFT JOIN comments c USING (community, week_start)""")
def weekly_panel(spark, sf):
    # Mean prices end on rounding ties; whole cents compare exactly.
    cents = F.round(F.col("avg_score") * F.col("post_count") * 100).cast("long")
    p = weekly.weekly_panel(b.order_posts(spark, sf, comments=True))
    return shown(p.withColumn("score_cents", cents).drop("hour_counts", "avg_score"), 4)


@query("weekly_gap_fill", "WITH " + b.PANEL + """
SELECT community, count(*) AS n_weeks, CAST(sum(CASE WHEN is_missing_week THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       min(week_start) AS first_week, max(week_start) AS last_week FROM panel GROUP BY community""")
def weekly_gap_fill(spark, sf):
    return weekly.weekly_panel(b.order_posts(spark, sf)).groupBy("community").agg(
        F.count("*").alias("n_weeks"), F.count_if("is_missing_week").alias("n_missing"),
        F.min("week_start").alias("first_week"), F.max("week_start").alias("last_week"))


@query("new_author_ratio", "WITH " + b.PANEL + """
SELECT community, week_start, count(DISTINCT author_hash) AS unique_authors,
       CAST(coalesce(max(n_new), 0) AS BIGINT) AS new_authors FROM posts LEFT JOIN newcomers USING (community, week_start) GROUP BY ALL""")
def new_author_ratio(spark, sf):
    return weekly.author_weeks(b.order_posts(spark, sf))


COUNTS = b.POSTS + ", counts AS (SELECT community, week_start, count(*) AS post_count FROM posts GROUP BY ALL)"
COMPLETE = COUNTS + """, complete AS (
  SELECT community, week_start, post_count,
         avg(post_count) OVER (PARTITION BY community ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rolling FROM counts)"""


@query("completeness", "WITH " + COMPLETE + """
SELECT community, week_start, post_count, round(rolling, 6) AS rolling_avg_post_count,
       round(post_count / rolling, 6) AS completeness_score, post_count / rolling < 0.5 AS is_gap FROM complete""")
def completeness(spark, sf):
    return shown(weekly.completeness(weekly.weekly_counts(b.order_posts(spark, sf))))


EXPECTED = f"""expected AS (
  SELECT community, CAST(unnest(generate_series(TIMESTAMP '1995-01-02', TIMESTAMP '{LAST}', INTERVAL 7 DAY)) AS DATE) AS week_start
  FROM (SELECT DISTINCT community FROM counts))"""


@query("missing_weeks", "WITH " + COUNTS + "," + EXPECTED + """
SELECT community, week_start FROM expected e WHERE NOT EXISTS (
  SELECT 1 FROM counts c WHERE c.community = e.community AND c.week_start = e.week_start)""")
def missing_weeks(spark, sf):
    return weekly.missing_weeks(weekly.weekly_counts(b.order_posts(spark, sf)), FIRST, LAST)


SOURCES = b.POSTS + """, by_source AS (SELECT community, week_start, data_source, count(*) AS n FROM posts GROUP BY ALL),
per_week AS (SELECT community, week_start, count(*) AS n_sources, max(n) / min(n)::DOUBLE AS ratio,
             string_agg(data_source || '=' || n, ',' ORDER BY data_source) AS sources FROM by_source GROUP BY ALL)"""


@query("cross_source_check", "WITH " + SOURCES + """
SELECT community, week_start, n_sources, round(ratio, 6) AS ratio, ratio > 2.0 AS discrepant, sources FROM per_week WHERE n_sources > 1""")
def cross_source_check(spark, sf):
    out = weekly.cross_source(b.order_posts(spark, sf))
    text = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return shown(out.withColumn("sources", text))


@query("cross_source_report", "WITH " + SOURCES + """
SELECT p.community, CAST(count(*) AS BIGINT) AS total_weeks, CAST(sum(CASE WHEN n_sources > 1 THEN 1 ELSE 0 END) AS BIGINT) AS weeks_with_multiple_sources,
       CAST(sum(CASE WHEN n_sources > 1 AND ratio > 2.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_discrepancies,
       max(s.sources_present) AS sources_present
FROM per_week p JOIN (SELECT community, string_agg(DISTINCT data_source, ',' ORDER BY data_source) AS sources_present FROM posts GROUP BY ALL) s USING (community)
GROUP BY p.community""")
def cross_source_report(spark, sf):
    r = weekly.cross_source_report(b.order_posts(spark, sf))
    return r.withColumn("sources_present", F.array_join("sources_present", ","))


@query("quality_report",
       "WITH " + COMPLETE + "," + EXPECTED + """,
by_source AS (SELECT community, week_start, data_source, count(*) AS n FROM posts GROUP BY ALL),
per_week AS (SELECT community, week_start, count(*) AS k, max(n) / min(n)::DOUBLE AS ratio FROM by_source GROUP BY ALL),
seen AS (SELECT community, count(*) AS total_weeks_observed, CAST(sum(CASE WHEN post_count / rolling < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS gap_weeks,
         avg(post_count / rolling) AS avg_completeness FROM complete GROUP BY community),
absent AS (SELECT community, count(*) AS m FROM expected e WHERE NOT EXISTS (
  SELECT 1 FROM counts c WHERE c.community = e.community AND c.week_start = e.week_start) GROUP BY community)
SELECT community, total_weeks_observed, gap_weeks, round(avg_completeness, 6) AS avg_completeness, coalesce(m, 0) AS missing_week_count,
       (SELECT count(*) FROM per_week p WHERE p.community = seen.community AND k > 1 AND ratio > 2.0) AS n_discrepancies
FROM seen LEFT JOIN absent USING (community)""")
def quality_report(spark, sf):
    return shown(weekly.quality_report(b.order_posts(spark, sf), FIRST, LAST))


@query("temporal_features", "WITH " + b.PANEL + """
SELECT community, iso_year, iso_week, week_start, week_idx,""" + ",".join(
    f"""
 round({c}, 6) AS {c}, round(coalesce({c} - lag({c}) OVER w, 0), 6) + 0.0 AS {c}_delta,
 round(avg({c}) OVER (PARTITION BY community ORDER BY week_start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS {c}_roll2w,
 round(avg({c}) OVER (PARTITION BY community ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS {c}_roll4w"""
    for c in ("post_volume", "unique_posters", "new_poster_ratio", "avg_negative")) + """,
 round(sin(2 * pi() * iso_week / 52.0), 6) + 0.0 AS week_sin, round(cos(2 * pi() * iso_week / 52.0), 6) + 0.0 AS week_cos
FROM panel WINDOW w AS (PARTITION BY community ORDER BY week_start)""")
def temporal_features(spark, sf):
    cols = ["post_volume", "unique_posters", "new_poster_ratio", "avg_negative"]
    p = b.order_panel(spark, sf).select("community", "iso_year", "iso_week", "week_start", "week_idx", *cols)
    return shown(temporal.add_temporal(p, cols))


@query("seasonality", "WITH " + b.PANEL + """
SELECT iso_week, count(*) AS n, round(any_value(sin(2 * pi() * iso_week / 52.0)), 6) + 0.0 AS week_sin,
       round(any_value(cos(2 * pi() * iso_week / 52.0)), 6) + 0.0 AS week_cos FROM panel GROUP BY iso_week""")
def seasonality(spark, sf):
    from tidewatch.functions.dates import season

    sin, cos = season(F.col("iso_week"))
    return shown(b.order_panel(spark, sf).groupBy("iso_week").agg(F.count("*").alias("n")).withColumn("week_sin", sin).withColumn("week_cos", cos))


@query("null_contract", "WITH " + b.PANEL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null FROM panel" for c in b.PANEL_FEATURES))
def null_contract(spark, sf):
    return temporal.null_counts(b.order_panel(spark, sf), b.PANEL_FEATURES)


@query("composite_score", "WITH " + b.SCORED + " SELECT community, week_start, round(distress_score, 6) + 0.0 AS distress_score FROM scored")
def composite_score(spark, sf):
    return shown(b.scored_panel(spark, sf).select("community", "week_start", "distress_score"))


@query("state_labels", "WITH " + b.STATES + """
SELECT community, week_start, CAST(state AS BIGINT) AS state, CAST(label AS BIGINT) AS label, CAST(is_crisis_week AS BIGINT) AS is_crisis_week FROM states""")
def state_labels(spark, sf):
    return shown(b.state_panel(spark, sf).select("community", "week_start", "state", "label", "is_crisis_week"))


@query("state_thresholds", "WITH " + b.STATES + " SELECT community, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, round(t1, 6) AS t1, round(t2, 6) AS t2, round(t3, 6) AS t3 FROM thresholds")
def state_thresholds(spark, sf):
    return shown(scoring.fit_thresholds(b.scored_panel(spark, sf), b.CUTS))


@query("crisis_weeks", "WITH " + b.STATES + " SELECT community, week_start, round(distress_score, 6) AS distress_score FROM states WHERE is_crisis_week = 1")
def crisis_weeks(spark, sf):
    return shown(b.state_panel(spark, sf).where("is_crisis_week = 1").select("community", "week_start", "distress_score"))


@query("score_trend_words", "WITH " + b.SCORED + """, d AS (
 SELECT community, week_start, distress_score - coalesce(lag(distress_score) OVER (PARTITION BY community ORDER BY week_start), distress_score) AS score_delta FROM scored)
SELECT community, week_start, round(score_delta, 6) + 0.0 AS score_delta,
       CASE WHEN score_delta > 0.05 THEN 'Rising' WHEN score_delta < -0.05 THEN 'Easing' ELSE 'Stable' END AS trend FROM d""")
def score_trend_words(spark, sf):
    return shown(scoring.score_deltas(b.scored_panel(spark, sf)).select("community", "week_start", "score_delta", "trend"))


GRID = """sizes AS (SELECT community, count(*) AS n FROM scored GROUP BY community),
grid AS (SELECT community, unnest(generate_series(27, n - 1)) AS test_idx FROM sizes WHERE n > 27)"""


@query("fold_grid", "WITH " + b.SCORED + "," + GRID + " SELECT community, test_idx - 27 AS fold_i, test_idx, test_idx - 1 AS train_end FROM grid")
def fold_grid(spark, sf):
    return shown(folds.fold_grid(b.scored_panel(spark, sf)))


FOLDS = "," + GRID + f""",
expanding AS (SELECT community, week_idx AS test_idx, distress_score AS test_score,
   lead(distress_score) OVER (PARTITION BY community ORDER BY week_start) AS next_score,
   avg(distress_score) OVER w AS mean, stddev_samp(distress_score) OVER w AS std
  FROM scored WINDOW w AS (PARTITION BY community ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)),
fitted AS (SELECT *, test_idx - 27 AS fold_i, test_idx - 1 AS train_end, mean + 0.3 * std AS t1, mean + 0.6 * std AS t2, mean + std AS t3 FROM grid JOIN expanding USING (community, test_idx))"""


@query("fold_thresholds", "WITH " + b.RAW_SCORED + FOLDS + f"""
SELECT community, fold_i, test_idx, train_end, round(t1, 6) AS t1, round(t2, 6) AS t2, round(t3, 6) AS t3,
       CAST({b.bucket_sql('next_score', ('t1', 't2', 't3'))} AS BIGINT) AS actual FROM fitted""")
def fold_thresholds(spark, sf):
    s = b.stored(b.scored_panel(spark, sf, normalize=False))
    return shown(folds.fold_thresholds(s, folds.fold_grid(s), cuts=b.CUTS).select("community", "fold_i", "test_idx", "train_end", "t1", "t2", "t3", "actual"))


LABELLED = FOLDS + """,
nexts AS (SELECT community, week_idx, lead(distress_score) OVER (PARTITION BY community ORDER BY week_start) AS nx FROM scored),
records AS (
  SELECT f.community, fold_i, test_idx, CAST(count(*) FILTER (WHERE v IS NOT NULL) AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE v >= t2) AS BIGINT) AS n_crisis_train
  FROM (SELECT f.community, f.fold_i, f.test_idx, f.t2, CASE WHEN n.week_idx = f.train_end - 1 THEN {last} ELSE n.nx END AS v
        FROM fitted f JOIN nexts n ON n.community = f.community AND n.week_idx < f.train_end) f GROUP BY ALL),
fold_records AS (SELECT *, CASE WHEN n_train > 0 THEN n_crisis_train / n_train::DOUBLE ELSE 0 END AS crisis_rate_train, n_train < 10 OR n_crisis_train < 2 AS skipped FROM records)"""


@query("fold_labels", "WITH " + b.RAW_SCORED + LABELLED.format(last="NULL") + f"""
SELECT community, fold_i, test_idx, n_train, n_crisis_train, round(crisis_rate_train, 6) AS crisis_rate_train, skipped,
       CASE WHEN skipped THEN '{folds.REASON}' END AS skip_reason FROM fold_records""")
def fold_labels(spark, sf):
    s = b.stored(b.scored_panel(spark, sf, normalize=False))
    return shown(folds.fold_labels(s, folds.fold_thresholds(s, folds.fold_grid(s), cuts=b.CUTS)))


@query("fold_labels_as_coded", "WITH " + b.RAW_SCORED + LABELLED.format(last="f.test_score") + """
SELECT community, fold_i, test_idx, n_train, n_crisis_train, round(crisis_rate_train, 6) AS crisis_rate_train, skipped FROM fold_records""")
def fold_labels_as_coded(spark, sf):
    s = b.stored(b.scored_panel(spark, sf, normalize=False))
    return shown(folds.fold_labels(s, folds.fold_thresholds(s, folds.fold_grid(s), cuts=b.CUTS), compat=True).drop("skip_reason"))


@query("fold_diagnostics", "WITH " + b.RAW_SCORED + LABELLED.format(last="NULL") + """
SELECT community, count(*) AS n_total_folds, count(*) FILTER (WHERE NOT skipped) AS n_ran_folds, count(*) FILTER (WHERE skipped) AS n_skipped_folds,
  round(coalesce(avg(crisis_rate_train) FILTER (WHERE NOT skipped), 0), 6) AS mean_fold_crisis_rate,
  round(coalesce(min(crisis_rate_train) FILTER (WHERE NOT skipped), 0), 6) AS min_fold_crisis_rate,
  round(coalesce(max(crisis_rate_train) FILTER (WHERE NOT skipped), 0), 6) AS max_fold_crisis_rate,
  count(*) FILTER (WHERE NOT skipped AND crisis_rate_train <= 0.05) AS n_low_balance_folds,
  round(coalesce(avg(n_train) FILTER (WHERE NOT skipped), 0), 6) AS mean_train_size FROM fold_records GROUP BY community""")
def fold_diagnostics(spark, sf):
    s = b.stored(b.scored_panel(spark, sf, normalize=False))
    return shown(folds.fold_diagnostics(folds.fold_labels(s, folds.fold_thresholds(s, folds.fold_grid(s), cuts=b.CUTS))))


@query("holdout_split", "WITH " + b.PANEL + """, s AS (SELECT community, count(*) AS n_weeks FROM panel GROUP BY community)
SELECT community, n_weeks, CASE WHEN n_weeks <= 28 THEN n_weeks ELSE n_weeks - least(12, greatest(0, n_weeks - 28)) END AS dev_n,
       n_weeks - CASE WHEN n_weeks <= 28 THEN n_weeks ELSE n_weeks - least(12, greatest(0, n_weeks - 28)) END AS holdout_n FROM s""")
def holdout_split(spark, sf):
    return shown(folds.holdout_split(b.order_panel(spark, sf)))


@query("calibration_split", "WITH " + b.PANEL + """, s AS (SELECT community, count(*) AS n FROM panel GROUP BY community)
SELECT community, n AS n_weeks, CAST(least(greatest(20, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)), n - 1) AS BIGINT) AS n_calibration,
       n - CAST(least(greatest(20, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)), n - 1) AS BIGINT) AS n_fit FROM s""")
def calibration_split(spark, sf):
    s = b.order_panel(spark, sf).groupBy("community").agg(F.count("*").alias("n_weeks"))
    c = folds.calibration_rows(F.col("n_weeks"), 0.2, 20)
    return shown(s.select("community", "n_weeks", c.alias("n_calibration"), (F.col("n_weeks") - c).alias("n_fit")))


@query("sequence_windows", "WITH " + b.PANEL + """, w AS (
 SELECT community, week_start, week_idx, sum(post_volume) OVER r + sum(avg_negative) OVER r AS total, count(*) OVER r AS k,
        max(post_volume) OVER r AS peak FROM panel WINDOW r AS (PARTITION BY community ORDER BY week_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT community, week_start, week_idx, 12 AS width, round(total, 6) AS total, round(peak, 6) AS peak FROM w WHERE k = 6""".replace("12 AS width", "CAST(12 AS BIGINT) AS width"))
def sequence_windows(spark, sf):
    s = folds.sequences(b.order_panel(spark, sf), ["post_volume", "avg_negative"], 6)
    return shown(s.select("community", "week_start", "week_idx", F.size("sequence").alias("width"),
                          F.aggregate("sequence", F.lit(0.0), lambda a, v: a + v).alias("total"), F.array_max("sequence").alias("peak")))


def _drift_z(c: str) -> str:
    w = "(PARTITION BY community ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    return f"coalesce(CASE WHEN stddev_samp({c}) OVER {w} > 1e-12 THEN ({c} - avg({c}) OVER {w}) / stddev_samp({c}) OVER {w} ELSE 0 END, 0) AS z_{c}"


DRIFT = b.PANEL + ", z AS (SELECT community, week_start, " + ", ".join(_drift_z(c) for c in b.SIGNALS) + " FROM panel), top AS (SELECT *, greatest(" + ", ".join(
    f"round(abs(z_{c}), 9)" for c in b.SIGNALS) + ") AS m FROM z), drift AS (SELECT *, CASE WHEN m >= 3 THEN 3 WHEN m >= 2 THEN 2 WHEN m >= 1 THEN 1 ELSE 0 END AS aggregate_level, CASE " + " ".join(
    f"WHEN round(abs(z_{c}), 9) = m THEN '{c}'" for c in b.SIGNALS) + " END AS dominant_signal FROM top)"


@query("drift_levels", "WITH " + DRIFT + " SELECT community, week_start, " + ", ".join(f"round(z_{c}, 5) + 0.0 AS z_{c}" for c in b.SIGNALS) + """,
 CAST(aggregate_level AS BIGINT) AS aggregate_level, ['normal', 'warning', 'alert', 'critical'][aggregate_level + 1] AS alert_level_name, dominant_signal FROM drift""")
def drift_levels(spark, sf):
    return shown(monitor.drift(b.order_panel(spark, sf), b.SIGNALS), 5)


@query("drift_changes", "WITH " + DRIFT + """, c AS (SELECT *, lag(aggregate_level, 1, 0) OVER (PARTITION BY community ORDER BY week_start) AS previous_level FROM drift)
SELECT community, week_start, CAST(previous_level AS BIGINT) AS previous_level, CAST(aggregate_level AS BIGINT) AS aggregate_level,
       CASE WHEN aggregate_level > previous_level THEN 'escalation' ELSE 'de-escalation' END AS change, dominant_signal
FROM c WHERE aggregate_level <> previous_level""")
def drift_changes(spark, sf):
    return shown(monitor.level_changes(monitor.drift(b.order_panel(spark, sf), b.SIGNALS)))


ESCALATIONS = b.STATES + """, prior AS (SELECT *, lag(state) OVER (PARTITION BY community ORDER BY week_start) AS from_state FROM states),
escalations AS (SELECT community, week_start, CAST(from_state AS BIGINT) AS from_state, CAST(state AS BIGINT) AS to_state, round(distress_score, 6) AS distress_score,
  CASE greatest(avg_negative, hopelessness_density, isolation_density, post_volume) WHEN avg_negative THEN 'avg_negative' WHEN hopelessness_density THEN 'hopelessness_density'
       WHEN isolation_density THEN 'isolation_density' ELSE 'post_volume' END AS dominant_signal FROM prior WHERE state > from_state)"""


def _escalations(spark, sf):
    return monitor.escalations(b.state_panel(spark, sf).withColumn("score", F.col("distress_score")), b.SIGNALS)


@query("escalations", "WITH " + ESCALATIONS + " SELECT * FROM escalations")
def escalations(spark, sf):
    return shown(_escalations(spark, sf))


@query("transition_counts", "WITH " + ESCALATIONS + " SELECT community, to_state, count(*) AS n FROM escalations GROUP BY ALL")
def transition_counts(spark, sf):
    return shown(monitor.transition_counts(_escalations(spark, sf)))


@query("recent_transitions", "WITH " + ESCALATIONS + " SELECT * FROM escalations ORDER BY week_start DESC, community LIMIT 20")
def recent_transitions(spark, sf):
    return shown(monitor.recent(_escalations(spark, sf), 20, "week_start"))


@query("stage_summary", "WITH " + b.POSTS + """, kept AS (SELECT * FROM posts WHERE score >= 30000),
l AS (SELECT community, count(*) AS loaded FROM posts GROUP BY community),
k AS (SELECT community, count(*) AS cleaned, count(DISTINCT week_start) AS week_rows FROM kept GROUP BY community),
j AS (SELECT community, loaded, coalesce(cleaned, 0) AS cleaned, coalesce(week_rows, 0) AS week_rows FROM l LEFT JOIN k USING (community))
SELECT coalesce(community, 'TOTAL') AS community, CAST(sum(loaded) AS BIGINT) AS loaded, CAST(sum(cleaned) AS BIGINT) AS cleaned, CAST(sum(loaded) - sum(cleaned) AS BIGINT) AS dropped,
       CAST(sum(week_rows) AS BIGINT) AS week_rows, round(sum(cleaned) / nullif(sum(week_rows), 0)::DOUBLE, 6) AS avg_posts_per_week FROM j GROUP BY ROLLUP (community)""")
def stage_summary(spark, sf):
    posts = b.order_posts(spark, sf)
    return shown(weekly.stage_summary(posts, posts.where("score >= 30000")))


@query("volume_gate", "WITH " + b.PANEL + """
SELECT community, CAST(sum(post_volume) AS BIGINT) AS n_posts, count(*) AS n_weeks, sum(post_volume) >= 50 AND count(*) >= 33 AS enough FROM panel GROUP BY community""")
def volume_gate(spark, sf):
    from tidewatch.operators import clean

    return clean.volume_gate(b.order_posts(spark, sf), b.order_panel(spark, sf))


LONG = "long AS (" + " UNION ALL ".join(f"SELECT community, week_start, '{c}' AS feature, {c} AS value FROM panel" for c in b.PANEL_FEATURES) + ")"
STATS = "stats AS (SELECT community, feature, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS min, max(value) AS max FROM long GROUP BY ALL)"


@query("train_stats", "WITH " + b.PANEL + "," + LONG + "," + STATS + " SELECT community, feature, round(mean, 4) AS mean, round(std, 4) AS std, round(min, 4) AS min, round(max, 4) AS max FROM stats")
def train_stats(spark, sf):
    return shown(stats.train_stats(b.order_panel(spark, sf), b.PANEL_FEATURES), 4)


@query("drift_warnings", "WITH " + b.PANEL + "," + LONG + "," + STATS + """
SELECT community, week_start, feature, round(value, 4) AS value, round(abs(value - mean) / std, 4) AS z FROM long JOIN stats USING (community, feature)
WHERE std > 0 AND abs(value - mean) > 2.5 * std""")
def drift_warnings(spark, sf):
    p = b.stored(b.order_panel(spark, sf))
    w = monitor.drift_warnings(monitor.long_features(p, b.PANEL_FEATURES), stats.train_stats(p, b.PANEL_FEATURES))
    return shown(w.select("community", "week_start", "feature", "value", "z"), 4)


@query("sigma_guardrail", "WITH " + b.PANEL + "," + LONG + "," + STATS + """
SELECT community, feature, count(*) AS n, count(*) FILTER (WHERE std > 0 AND abs(value - mean) / nullif(std, 0) > 3) AS n_clipped,
       round(max(CASE WHEN std > 0 THEN least(greatest(value, mean - 3 * std), mean + 3 * std) ELSE value END), 4) AS max_value
FROM long JOIN stats USING (community, feature) GROUP BY ALL""")
def sigma_guardrail(spark, sf):
    p = b.stored(b.order_panel(spark, sf))
    g = monitor.guardrail(monitor.long_features(p, b.PANEL_FEATURES), stats.train_stats(p, b.PANEL_FEATURES), 3.0, clip=True)
    return shown(g.groupBy("community", "feature").agg(F.count("*").alias("n"), F.count_if("clipped").alias("n_clipped"), F.max("value").alias("max_value")), 4)
