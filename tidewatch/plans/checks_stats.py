"""Queries of panel statistics: balance, profiles, outliers, trend, correlation, Granger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import stats, weekly
from tidewatch.plans import bindings as b
from tidewatch.plans.checks_panel import LONG
from tidewatch.plans.registry import query, shown

S = "WITH " + b.STATES
COMMUNITIES = ("1-urgent", "2-high", "3-medium", "4-not specified", "5-low")


@query("class_balance", S + """ SELECT community, count(label) AS n_total, """ + ", ".join(f"count(*) FILTER (WHERE label = {i}) AS n_{i}" for i in range(4)) + """,
  count(*) FILTER (WHERE label >= 2) AS crisis_weeks, count(*) FILTER (WHERE label < 2) AS stable_weeks, round(count(*) FILTER (WHERE label >= 2)::DOUBLE / count(label), 6) AS crisis_rate,
  round((count(label) - count(*) FILTER (WHERE label >= 2))::DOUBLE / greatest(count(*) FILTER (WHERE label >= 2), 1), 6) AS imbalance_ratio FROM states GROUP BY community""")
def class_balance(spark, sf):
    return shown(stats.class_balance(b.state_panel(spark, sf)))


@query("state_profile", S + ", l AS (" + " UNION ALL ".join(f"SELECT community, label, '{c}' AS feature, {c} AS value FROM states WHERE label IS NOT NULL" for c in b.PANEL_FEATURES) + """)
SELECT community, feature, CAST(label AS BIGINT) AS state, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median FROM l GROUP BY ALL""")
def state_profile(spark, sf):
    return shown(stats.state_profile(b.state_panel(spark, sf), b.PANEL_FEATURES))


GAPPY = b.PANEL + ", long AS (" + " UNION ALL ".join(f"SELECT community, '{c}' AS feature, CASE WHEN is_missing_week OR week_idx % 4 = 0 THEN NULL ELSE {c} END AS value FROM panel" for c in b.PANEL_FEATURES) + ")"


def _gappy(spark, sf):
    p = b.order_panel(spark, sf)
    gone = (F.col("post_volume") == 0) | (F.col("week_idx") % 4 == 0)
    return p.select("community", *[F.when(~gone, F.col(c)).alias(c) for c in b.PANEL_FEATURES])


@query("missing_pct", "WITH " + GAPPY + " SELECT community, feature, round(avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS missing_pct FROM long GROUP BY ALL")
def missing_pct(spark, sf):
    return shown(stats.missing_share(_gappy(spark, sf), b.PANEL_FEATURES))


@query("feature_profile", "WITH " + GAPPY + """ SELECT community, feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.25), 6) AS q1,
  round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(skewness(value), 5) + 0.0 AS skew, round(avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS missing_pct, count(value) AS n_valid FROM long GROUP BY ALL""")
def feature_profile(spark, sf):
    return shown(stats.feature_profile(_gappy(spark, sf), b.PANEL_FEATURES).withColumn("skew", F.round("skew", 5)))


IQR = b.PANEL + "," + LONG + """, q AS (SELECT community, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM long GROUP BY ALL),
outliers AS (SELECT community, week_start, feature, value, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM long JOIN q USING (community, feature)
  WHERE n >= 8 AND q3 <> q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)))"""


@query("iqr_outliers", "WITH " + IQR + " SELECT community, week_start, feature, round(value, 4) AS value, round(lower_bound, 4) + 0.0 AS lower_bound, round(upper_bound, 4) AS upper_bound, CASE WHEN value > upper_bound THEN 'high' ELSE 'low' END AS direction FROM outliers")
def iqr_outliers(spark, sf):
    return shown(stats.iqr_outliers(b.order_panel(spark, sf), b.PANEL_FEATURES), 4)


@query("trend", "WITH " + b.SCORED + """, t AS (SELECT community, count(*) AS n_weeks, regr_slope(distress_score, week_idx) AS slope, stddev_pop(distress_score) AS sd FROM scored GROUP BY community),
c AS (SELECT *, CASE WHEN sd > 1e-8 THEN slope * (n_weeks - 1) / sd ELSE 0 END AS sigma_change FROM t)
SELECT community, n_weeks, round(slope, 8) + 0.0 AS slope, round(sigma_change, 6) + 0.0 AS sigma_change, CASE WHEN n_weeks < 4 THEN 'insufficient_data' WHEN abs(sigma_change) < 0.1 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'declining' END AS direction FROM c""")
def trend(spark, sf):
    t = stats.trend(b.scored_panel(spark, sf))
    return shown(t, 8).withColumn("sigma_change", F.round("sigma_change", 6) + F.lit(0.0))


@query("yearly_rate", S + """ SELECT community, CAST(iso_year AS BIGINT) AS iso_year, round(avg(CASE WHEN label >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS crisis_rate, count(*) AS n_weeks
FROM states WHERE label IS NOT NULL GROUP BY GROUPING SETS ((community, iso_year), (community))""")
def yearly_rate(spark, sf):
    return shown(stats.yearly_rate(b.state_panel(spark, sf)))


@query("quality_flags", S + "," + LONG.replace("FROM panel", "FROM states") + IQR.removeprefix(b.PANEL + "," + LONG) + """,
n0 AS (SELECT community, feature, count(*) AS n FROM outliers GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, feature) AS r FROM n0)
SELECT community, 'outlier_prone' AS flag, feature, CAST(n AS DOUBLE) AS value FROM n WHERE r <= 3
UNION ALL SELECT community, 'low_crisis_rate', '', round(avg(CASE WHEN label >= 2 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM states WHERE label IS NOT NULL GROUP BY community HAVING avg(CASE WHEN label >= 2 THEN 1.0::DOUBLE ELSE 0 END) < 0.05""")
def quality_flags(spark, sf):
    s = b.stored(b.state_panel(spark, sf))
    return shown(stats.quality_flags(s, s, b.PANEL_FEATURES))


def _rank_sql(value: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE)"


@query("spearman_label", S + ", long AS (" + " UNION ALL ".join(f"SELECT community, '{c}' AS feature, {c} AS value, CASE WHEN label >= 2 THEN 1.0::DOUBLE ELSE 0 END AS y FROM states" for c in b.PANEL_FEATURES) + f"""),
r AS (SELECT community, feature, {_rank_sql('value', 'community, feature')} AS rx, {_rank_sql('y', 'community, feature')} AS ry FROM long)
SELECT community, feature, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS spearman_rho FROM r GROUP BY ALL""")
def spearman_label(spark, sf):
    return shown(stats.spearman_label(b.state_panel(spark, sf), b.PANEL_FEATURES))


# The tail of the t distribution: with t = sqrt(df) tan(a) its density is cos(a)^(df - 1), summed here by Simpson's rule.
@query("spearman_significance", S + ", long AS (" + " UNION ALL ".join(f"SELECT community, '{c}' AS feature, {c} AS value, CASE WHEN label >= 2 THEN 1.0::DOUBLE ELSE 0 END AS y FROM states" for c in b.PANEL_FEATURES) + f"""),
r AS (SELECT community, feature, {_rank_sql('value', 'community, feature')} AS rx, {_rank_sql('y', 'community, feature')} AS ry FROM long),
c AS (SELECT community, feature, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY ALL HAVING count(*) >= 8),
a AS (SELECT *, atan(abs(rho) / sqrt(1 - rho * rho)) AS upto FROM c WHERE NOT isnan(rho)),
p AS (SELECT community, feature, 1 - 2 * exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE) - 0.5::DOUBLE * ln(pi()))
  * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * cos(upto * k / 2000.0::DOUBLE) ** (n - 3)) * upto / 6000 AS p
  FROM a, (SELECT unnest(range(2001)) AS k) GROUP BY community, feature, n, upto)
SELECT c.community, c.feature, c.n, CASE WHEN isnan(rho) THEN NULL ELSE round(rho, 6) + 0.0 END AS spearman_rho, round(greatest(p.p, 0), 6) + 0.0 AS p_value, coalesce(p.p < 0.05, false) AS significant
FROM c LEFT JOIN p USING (community, feature)""")
def spearman_significance(spark, sf):
    return shown(stats.with_p_value(stats.spearman_label(b.state_panel(spark, sf), b.PANEL_FEATURES)))


@query("collinear_pairs", "WITH " + b.PANEL + ", r AS (SELECT community, " + ", ".join(f"{_rank_sql(c, 'community')} AS {c}" for c in b.PANEL_FEATURES) + " FROM panel), c AS (" + " UNION ALL ".join(
    f"SELECT community, '{x}' AS feature_a, '{y}' AS feature_b, corr({x}, {y}) AS rho FROM r GROUP BY community" for i, x in enumerate(b.PANEL_FEATURES) for y in b.PANEL_FEATURES[i + 1:]) + ") SELECT community, feature_a, feature_b, round(rho, 6) AS spearman_rho FROM c WHERE abs(rho) >= 0.9")
def collinear_pairs(spark, sf):
    return shown(stats.collinear_pairs(b.order_panel(spark, sf), b.PANEL_FEATURES))


@query("top_correlated", S + ", long AS (" + " UNION ALL ".join(f"SELECT community, '{c}' AS feature, {c} AS value, CASE WHEN label >= 2 THEN 1.0::DOUBLE ELSE 0 END AS y FROM states" for c in b.PANEL_FEATURES) + f"""),
r AS (SELECT community, feature, {_rank_sql('value', 'community, feature')} AS rx, {_rank_sql('y', 'community, feature')} AS ry FROM long), c AS (SELECT community, feature, corr(rx, ry) AS rho FROM r GROUP BY ALL)
SELECT community, feature, rank FROM (SELECT community, feature, row_number() OVER (PARTITION BY community ORDER BY round(abs(rho), 9) DESC, feature) AS rank FROM c) WHERE rank <= 2""")
def top_correlated(spark, sf):
    rho = stats.spearman_label(b.state_panel(spark, sf), b.PANEL_FEATURES)
    return shown(stats.top_features(rho, F.abs("spearman_rho"), 2).select("community", "feature", "rank"))


@query("community_pairs", "WITH " + b.SCORED + """, back AS (SELECT community, distress_score AS v, row_number() OVER (PARTITION BY community ORDER BY week_start DESC) AS back FROM scored)
SELECT a.community AS source, c.community AS target, count(*) AS n, round(corr(a.v, c.v), 6) + 0.0 AS rho FROM back a JOIN back c ON a.back = c.back AND a.community <> c.community GROUP BY ALL""")
def community_pairs(spark, sf):
    p = stats.aligned_pairs(b.stored(b.scored_panel(spark, sf)), COMMUNITIES)
    return shown(p.groupBy("source", "target").agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho")))


@query("granger_lag1", "WITH " + b.SCORED + """, back AS (SELECT community, distress_score AS v, row_number() OVER (PARTITION BY community ORDER BY week_start DESC) AS back FROM scored),
pairs AS (SELECT a.community AS source, c.community AS target, a.back, a.v AS x, c.v AS y FROM back a JOIN back c ON a.back = c.back AND a.community <> c.community),
lags AS (SELECT source, target, y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM pairs WINDOW w AS (PARTITION BY source, target ORDER BY back DESC)),
m AS (SELECT source, target, count(*) AS n, var_pop(y) AS vy, var_pop(y1) AS v1, var_pop(x1) AS v2, covar_pop(y, y1) AS c1, covar_pop(y, x1) AS c2, covar_pop(y1, x1) AS c12 FROM lags WHERE y1 IS NOT NULL GROUP BY ALL),
s AS (SELECT source, target, n, n * (vy - c1 * c1 / v1) AS ssr_r, n * (vy - (c1 * c1 * v2 - 2 * c1 * c2 * c12 + c2 * c2 * v1) / (v1 * v2 - c12 * c12)) AS ssr_u FROM m)
SELECT source, target, n, round((ssr_r - ssr_u) / (ssr_u / (n - 3)), 4) AS f_stat FROM s""")
def granger_lag1(spark, sf):
    g = stats.granger(b.stored(b.scored_panel(spark, sf)), COMMUNITIES, 1)
    return shown(g.select("source", "target", "n", "f_stat"), 4)


@query("granger_all_lags")
def granger_all_lags(spark, sf):
    return shown(stats.granger(b.stored(b.scored_panel(spark, sf)), COMMUNITIES, 4), 4)
