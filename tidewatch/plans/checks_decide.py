"""Queries of decisions and narration: budgets, triage, replay, scenarios, briefs, case studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import mathx
from tidewatch.operators import decide, learn, monitor, narrate, scoring, stats
from tidewatch.plans import bindings as b
from tidewatch.plans.checks_stats import COMMUNITIES
from tidewatch.plans.registry import ORACLE, query, shown
from tidewatch.schemas import STATE_NAMES

P = "WITH " + b.PREDICTIONS
EFFECT = {"1-urgent": 0.9, "2-high": 0.75}
LATEST = """, latest AS (SELECT community, round(coalesce(arg_max(prob, week_idx) FILTER (WHERE prob IS NOT NULL), 0), 4) AS probability, CAST(coalesce(arg_max(pred, week_idx) FILTER (WHERE pred IS NOT NULL), 0) AS BIGINT) AS state,
  CASE community WHEN '1-urgent' THEN 0.9::DOUBLE WHEN '2-high' THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS effectiveness FROM predictions WHERE model = 'sequence' GROUP BY community),
winner AS (SELECT community FROM latest WHERE probability * effectiveness > 0 ORDER BY probability * effectiveness DESC, community LIMIT 1)"""
HOURS = "round(least(0.5::DOUBLE, {b} / (SELECT count(*) FROM latest)) + CASE WHEN community IN (SELECT community FROM winner) THEN {b} - least(0.5::DOUBLE, {b} / (SELECT count(*) FROM latest)) * (SELECT count(*) FROM latest) ELSE 0 END, 2)"
ALLOCATION = LATEST + ", allocation AS (SELECT *, " + HOURS.format(b="10.0::DOUBLE") + " AS hours FROM latest)"


def _latest(spark, sf):
    return b.stored(decide.with_effectiveness(decide.latest_known(b.predictions(spark, sf).where("model = 'sequence'")), EFFECT))


@query("allocation", P + ALLOCATION + " SELECT * FROM allocation")
def allocation(spark, sf):
    return shown(decide.allocate(_latest(spark, sf)), 4)


@query("allocation_prorata", P + LATEST + """ SELECT *, round(0.5::DOUBLE + round(7.5::DOUBLE * probability * effectiveness / (SELECT sum(probability * effectiveness) FROM latest), 2), 4) AS hours FROM latest""")
def allocation_prorata(spark, sf):
    return shown(decide.allocate_pro_rata(_latest(spark, sf)), 4)


@query("allocation_objective", P + ALLOCATION + " SELECT round(sum(probability * effectiveness * hours), 4) AS objective, round(sum(hours), 4) AS hours_used FROM allocation")
def allocation_objective(spark, sf):
    return shown(decide.objective(decide.allocate(_latest(spark, sf))), 4)


BUDGETS = (2.0, 5.0, 10.0, 20.0)
SENS = LATEST + ", sens AS (SELECT budget, community, " + HOURS.format(b="budget") + " AS hours FROM latest CROSS JOIN (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in BUDGETS) + ") v(budget))"


@query("allocation_sensitivity", P + SENS + " SELECT budget, community, hours FROM sens")
def allocation_sensitivity(spark, sf):
    return shown(decide.allocate(_latest(spark, sf), budgets=BUDGETS).select("budget", "community", "hours"), 4)


@query("sensitivity_table", P + SENS + " SELECT budget, " + ", ".join(f"max(hours) FILTER (WHERE community = '{c}') AS \"{c}\"" for c in COMMUNITIES) + " FROM sens GROUP BY budget")
def sensitivity_table(spark, sf):
    return shown(decide.sensitivity_table(decide.allocate(_latest(spark, sf), budgets=BUDGETS), COMMUNITIES), 4)


NAMES_SQL = "CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STATE_NAMES.items()) + " END"


@query("allocation_text", P + ALLOCATION + f""" SELECT community, hours, format('  r/{{:<18s}}  {{:4.1f}} hrs  [{{}}, p={{:.2f}}]', community, hours, {NAMES_SQL.format(c='state')}, probability) AS line FROM allocation""")
def allocation_text(spark, sf):
    return shown(decide.allocation_text(decide.allocate(_latest(spark, sf))), 4)


@query("state_names", P + f" SELECT {NAMES_SQL.format(c='state')} AS state_name, count(*) AS n FROM states GROUP BY 1")
def state_names(spark, sf):
    return b.state_panel(spark, sf).groupBy(monitor.name_of(F.col("state"), STATE_NAMES).alias("state_name")).agg(F.count("*").alias("n"))


@query("triage_rank", P + """, snap AS (SELECT community, pred AS state, prob FROM predictions WHERE model = 'sequence' AND week_start = DATE '1999-03-01')
SELECT community, CAST(state AS BIGINT) AS state, round(prob, 6) AS prob, CAST(3 - coalesce(state, -1) AS BIGINT) AS severity, CASE WHEN prob >= 0.6 THEN 'high' WHEN prob >= 0.4 THEN 'moderate' ELSE 'low' END AS confidence FROM snap""")
def triage_rank(spark, sf):
    s = b.predictions(spark, sf).where("model = 'sequence' AND week_start = DATE '1999-03-01'").select("community", F.col("pred").alias("state"), "prob")
    return shown(decide.triage(s).withColumn("confidence", decide.confidence_word(F.col("prob"))))


@query("replay_weeks", "WITH " + b.PANEL + " SELECT DISTINCT iso_year, iso_week, week_start FROM panel")
def replay_weeks(spark, sf):
    return shown(decide.replay_weeks(b.order_panel(spark, sf)))


@query("replay_rows", "WITH " + b.PANEL + """, k AS (SELECT *, iso_year * 100 + iso_week AS key FROM panel WHERE NOT (community LIKE '1%' AND week_start >= DATE '1996-01-01')),
m AS (SELECT community, max(key) FILTER (WHERE key <= isoyear(DATE '1998-02-05') * 100 + week(DATE '1998-02-05')) AS found, min(key) AS earliest FROM k GROUP BY community)
SELECT k.community, week_start, week_idx, post_volume FROM k JOIN m ON m.community = k.community AND k.key = coalesce(found, earliest)""")
def replay_rows(spark, sf):
    p = b.order_panel(spark, sf).where(~(F.col("community").startswith("1") & (F.col("week_start") >= F.lit("1996-01-01").cast("date"))))
    return shown(decide.replay_rows(p, "1998-02-05").select("community", "week_start", "week_idx", "post_volume"))


@query("replay_asof", "WITH " + b.PANEL + """, w AS (SELECT community, week_start FROM panel WHERE week_idx % 3 = 1), asks AS (SELECT DISTINCT lower(trim(o_orderpriority)) AS community, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT a.community, a.d AS replay_week, coalesce(max(w.week_start) FILTER (WHERE w.week_start <= a.d), min(w.week_start)) AS week_start FROM asks a JOIN w USING (community) GROUP BY ALL""")
def replay_asof(spark, sf):
    weeks = b.order_panel(spark, sf).where("week_idx % 3 = 1")
    asks = b.order_posts(spark, sf).select("community", F.col("ts").cast("date").alias("replay_week")).distinct()
    return decide.replay_asof(weeks, asks)


@query("replay_rows_weeks", ORACLE["replay_rows"].replace(" WHERE NOT (community LIKE '1%' AND week_start >= DATE '1996-01-01')", ""))
def replay_rows_weeks(spark, sf):
    """``replay_rows`` over all weeks of all communities."""
    return shown(decide.replay_rows(b.order_panel(spark, sf), "1998-02-05").select("community", "week_start", "week_idx", "post_volume"))


@query("replay_asof_weeks", ORACLE["replay_asof"].replace(" WHERE week_idx % 3 = 1", ""))
def replay_asof_weeks(spark, sf):
    """``replay_asof`` over all weeks."""
    asks = b.order_posts(spark, sf).select("community", F.col("ts").cast("date").alias("replay_week")).distinct()
    return decide.replay_asof(b.order_panel(spark, sf), asks)


@query("trailing_weeks", "WITH " + b.PANEL + """ SELECT community, week_start, back FROM (SELECT community, week_start, row_number() OVER (PARTITION BY community ORDER BY week_start DESC) AS back FROM panel WHERE week_start <= DATE '1999-06-07') WHERE back <= 12""")
def trailing_weeks(spark, sf):
    return shown(decide.trailing(b.order_panel(spark, sf), "1999-06-07").select("community", "week_start", "back"))


@query("clamped_index", "WITH " + b.PANEL + ", n AS (SELECT community, count(*) AS n FROM panel GROUP BY community) SELECT community, greatest(0, least(asked, n - 1)) AS week_idx, CAST(asked AS BIGINT) AS asked FROM n CROSS JOIN (VALUES (-3), (40), (100000)) v(asked)")
def clamped_index(spark, sf):
    n = b.order_panel(spark, sf).groupBy("community").agg(F.count("*").alias("n"))
    asked = n.withColumn("asked", F.explode(F.array(F.lit(-3), F.lit(40), F.lit(100000))))
    return shown(asked.select("community", mathx.clamp(F.col("asked"), F.col("n")).alias("week_idx"), "asked"))


SCEN = ({"scenario": "calm", "hopelessness": -20.0}, {"scenario": "rush", "post_volume": 50.0, "hopelessness": 10.0})


@query("scenario_what_if", "WITH " + b.PANEL + """, s AS (SELECT p.community, p.week_start, scenario, post_volume * (1 + v / 100) AS post_volume, hopelessness_density * (1 + h / 100) AS hopelessness_density, avg_negative, help_seeking_density, isolation_density, suicidality_density
  FROM panel p CROSS JOIN (VALUES ('calm', -20.0::DOUBLE, 0.0::DOUBLE), ('rush', 10.0::DOUBLE, 50.0::DOUBLE)) x(scenario, h, v))
SELECT community, week_start, scenario, round(post_volume, 6) AS post_volume, round(hopelessness_density, 6) AS hopelessness_density, round(""" + " + ".join(f"{w}::DOUBLE * {c}" for c, w in b.WEIGHTS.items()) + ", 6) AS distress_score FROM s")
def scenario_what_if(spark, sf):
    out = scoring.composite_score(decide.apply_scenarios(b.order_panel(spark, sf), SCEN), b.WEIGHTS, False)
    return shown(out.select("community", "week_start", "scenario", "post_volume", "hopelessness_density", "distress_score"))


@query("feature_selection", "WITH " + b.PANEL + ", i AS (" + " UNION ALL ".join(f"SELECT community, '{c}' AS feature, stddev_pop({c}) / nullif(avg({c}), 0) AS importance FROM panel GROUP BY community" for c in b.PANEL_FEATURES if c != "avg_score") + """),
r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY round(importance, 9) DESC, feature) AS rank, importance >= max(importance) OVER (PARTITION BY community) * 0.5 AS keep FROM i),
n AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY community) AS k FROM r)
SELECT community, feature, round(importance, 6) AS importance, rank FROM n WHERE CASE WHEN k < 2 THEN rank <= 2 ELSE keep END AND rank <= 4""")
def feature_selection(spark, sf):
    cols = b.PANEL_FEATURES
    long = monitor.long_features(b.order_panel(spark, sf), cols).groupBy("community", "feature").agg(
        (F.stddev_pop("value") / F.nullif(F.avg("value"), F.lit(0.0))).alias("importance"))
    known = spark.createDataFrame([(c,) for c in cols if c != "avg_score"], "feature string")
    return shown(decide.select_features(long, known, 0.5, 2, 4).select("community", "feature", "importance", "rank"))


RANKED = ("avg_negative", "post_volume", "new_poster_ratio", "hopelessness_density", "unique_posters", "isolation_density")
MOVES = ", moves AS (" + " UNION ALL ".join(f"""SELECT community, week_start, {i} AS rank, '{c}' AS feature, {c} AS value, CASE WHEN row_number() OVER (PARTITION BY community ORDER BY week_start) = 1 THEN avg({c}) OVER (PARTITION BY community)
  ELSE avg({c}) OVER (PARTITION BY community ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS baseline FROM states""" for i, c in enumerate(RANKED[:5], 1)) + """),
pct AS (SELECT *, CASE WHEN baseline <> 0 THEN round((value - baseline) / abs(baseline) * 100, 1) ELSE 0 END AS delta_pct FROM moves),
directed AS (SELECT *, CASE WHEN abs(delta_pct) < 0.5 THEN 'flat' WHEN value > baseline THEN 'up' ELSE 'down' END AS direction FROM pct)"""


@query("feature_moves", "WITH " + b.STATES + MOVES + " SELECT community, week_start, CAST(rank AS BIGINT) AS rank, feature, round(value, 6) AS value, round(baseline, 6) AS baseline, delta_pct + 0.0 AS delta_pct, direction FROM directed")
def feature_moves(spark, sf):
    return shown(narrate.feature_moves(b.order_panel(spark, sf), RANKED[:5]))


CTX = MOVES + f""", top5 AS (SELECT community, week_start, string_agg(feature || ' ' || direction, '|' ORDER BY rank) AS top_features, string_agg(feature, ', ' ORDER BY rank) FILTER (WHERE rank <= 3) AS names FROM directed GROUP BY ALL),
ctx0 AS (SELECT s.community, s.week_start, s.iso_year, s.iso_week, s.week_idx, pred, lag(pred) OVER (PARTITION BY s.community ORDER BY s.week_start) AS prev,
  coalesce(round(distress_score - lag(distress_score) OVER (PARTITION BY s.community ORDER BY s.week_start), 4) + 0.0, 0) AS delta FROM states s JOIN predictions p ON p.community = s.community AND p.week_idx = s.week_idx AND p.model = 'sequence'),
ctx AS (SELECT community, week_start, week_idx, iso_year || '-W' || lpad(CAST(iso_week AS VARCHAR), 2, '0') AS week, {NAMES_SQL.format(c='pred')} AS predicted_state, coalesce({NAMES_SQL.format(c='prev')}, 'n/a') AS previous_state, delta AS distress_score_delta,
  top_features, names FROM ctx0 JOIN top5 USING (community, week_start) WHERE pred IS NOT NULL)"""


def _context(spark, sf):
    s = b.stored(b.state_panel(spark, sf))
    return narrate.brief_context(s, b.predictions_of(s).where("model = 'sequence'"), RANKED)


@query("brief_context", P + CTX + " SELECT community, week_start, week_idx, week, predicted_state, previous_state, distress_score_delta, top_features FROM ctx")
def brief_context(spark, sf):
    flat = F.array_join(F.transform("top_features", lambda x: F.concat_ws(" ", x["feature"], x["direction"])), "|")
    return shown(_context(spark, sf).withColumn("top_features", flat))


PLAYBOOK = """# Playbook

## Stable

- Continue routine moderation.
- A second bullet.

## Early Vulnerability Signal
Some prose first.
- Increase visibility of pinned resources.

## Elevated Distress (look closely)

- Consider a pinned thread.

## Severe Community Distress Signal

- Escalate to senior moderators.
"""
ACTIONS = "CASE predicted_state WHEN 'Stable' THEN 'Continue routine moderation.' WHEN 'Early Vulnerability Signal' THEN 'Increase visibility of pinned resources.' WHEN 'Elevated Distress' THEN 'Consider a pinned thread.' ELSE 'Escalate to senior moderators.' END"


def _actions(spark):
    return narrate.playbook_actions(spark.createDataFrame([(PLAYBOOK,)], "value string"))


@query("playbook_actions", "WITH " + b.STATES + f", n AS (SELECT community, week_start, {NAMES_SQL.format(c='state')} AS predicted_state FROM states) SELECT community, week_start, predicted_state, {ACTIONS} AS action FROM n")
def playbook_actions(spark, sf):
    rows = b.state_panel(spark, sf).select("community", "week_start", monitor.name_of(F.col("state"), STATE_NAMES).alias("predicted_state"))
    return narrate.with_actions(rows, _actions(spark))


SIGNED = "CASE WHEN distress_score_delta < 0 THEN '-' ELSE '+' END || printf('%.4f', abs(distress_score_delta))"


@query("template_brief", P + CTX + f""" SELECT community, week, 'r/' || community || ' (' || week || '): the models put this week at ' || predicted_state || ', a statement about the community as a whole and about no single member. The distress score moved by '
  || {SIGNED} || ' since the week before; by overall importance the leading features are ' || names || ' (the JSON has their direction this week). Recommended action: ' || {ACTIONS} AS brief FROM ctx""")
def template_brief(spark, sf):
    return narrate.template_brief(_context(spark, sf), _actions(spark)).select("community", "week", "brief")


@query("served_brief", P + CTX + f""" SELECT community, week, community || ' (' || week || ') shows a community-level signal of ' || predicted_state || '. The composite distress indicator ' || CASE WHEN distress_score_delta > 0 THEN 'rose' WHEN distress_score_delta < 0 THEN 'fell' ELSE 'held steady' END
  || ' compared with the prior week. The most influential signals this week include ' || names || '.' || chr(10) || chr(10) || 'Suggested action: ' || {ACTIONS} AS brief FROM ctx""")
def served_brief(spark, sf):
    return narrate.served_brief(_context(spark, sf), _actions(spark)).select("community", "week", "brief")


@query("latest_briefs", P + CTX + """ SELECT community, week AS week_key, 'template' AS source FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY week_start DESC) AS r FROM ctx) WHERE r <= 4""")
def latest_briefs(spark, sf):
    return narrate.latest_briefs(_context(spark, sf), _actions(spark)).drop("text")


@query("context_json", P + CTX + """ SELECT community, week, '{"community":"r/' || community || '","week":"' || week || '","predicted_state":"' || predicted_state || '","previous_state":"' || previous_state || '"' AS head FROM ctx""")
def context_json(spark, sf):
    j = narrate.prompt_text(_context(spark, sf), F.lit(PLAYBOOK))
    return j.select("community", "week", F.regexp_extract("prompt", r'^(.*"previous_state":"[^"]*")', 1).alias("head"))


CASES = "WITH " + b.PREDICTIONS + """, ev AS (SELECT community, week_idx AS event_idx FROM states WHERE is_crisis_week = 1),
f AS (SELECT community, week_idx, week_start, 'post_volume' AS feature, post_volume AS value, avg(post_volume) OVER (PARTITION BY community) AS average FROM states UNION ALL
      SELECT community, week_idx, week_start, 'avg_negative', avg_negative, avg(avg_negative) OVER (PARTITION BY community) FROM states)"""


@query("case_lookback", CASES + """ SELECT ev.community, event_idx, f.week_idx, f.week_start, event_idx - f.week_idx AS weeks_before, round(coalesce(p.prob, 0), 6) AS prob, CASE WHEN p.pred = 1 THEN 'FLAGGED' ELSE 'not flagged' END AS flagged, feature,
  round(value, 6) AS value, round(average, 6) AS average, round(CASE WHEN average <> 0 THEN (value - average) / abs(average) * 100 ELSE 0 END, 4) + 0.0 AS diff_pct, CASE WHEN average <> 0 AND value > average THEN 'above' ELSE 'below' END AS direction
FROM ev JOIN f ON f.community = ev.community AND f.week_idx BETWEEN event_idx - 3 AND event_idx - 1 LEFT JOIN predictions p ON p.community = f.community AND p.week_idx = f.week_idx AND p.model = 'tabular'""")
def case_lookback(spark, sf):
    s = b.stored(b.state_panel(spark, sf))
    p = b.predictions_of(s).where("model = 'tabular'")
    c = narrate.case_lookback(s, s.where("is_crisis_week = 1").select("community", "week_idx"), ["post_volume", "avg_negative"], p)
    return shown(c.withColumn("diff_pct", F.round("diff_pct", 4)))


@query("label_agreement", """SELECT lang AS community, count(*) AS n_audited, count(*) FILTER (WHERE (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) = quality) AS n_agreement,
  count(*) FILTER (WHERE quality IS NOT NULL AND (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) <> quality) AS n_disagreement,
  round(count(*) FILTER (WHERE (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) = quality)::DOUBLE / count(*), 6) AS agreement_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def label_agreement(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("lang").alias("community"), "doc_id", (F.col("n_chars") > 1000).cast("int").alias("model_label"))
    second = b.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("second_label"))
    return shown(narrate.label_agreement(d, second, ["doc_id"]))


@query("audit_sample", "WITH " + b.STATES + " SELECT community, least(count(*), 10) AS n_sampled, CAST(0 AS BIGINT) AS n_unlabelled FROM states WHERE label IS NOT NULL GROUP BY community")
def audit_sample(spark, sf):
    """Seeded sample of labelled weeks: its size and that it holds labelled weeks only."""
    s = narrate.sample_labelled(b.state_panel(spark, sf).select("community", "week_start", "label"))
    return s.groupBy("community").agg(F.count("*").alias("n_sampled"), F.count_if(F.col("label").isNull()).alias("n_unlabelled"))


@query("audit_prompts", """WITH c AS (SELECT conv_id, string_agg('Post ' || r || ': ' || text, chr(10) || chr(10) ORDER BY r) AS body FROM (
  SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY conv_id)
SELECT conv_id, sha256('Community: r/talk' || chr(10) || 'Week: 2018-W01' || chr(10) || 'Model label: 2 (Elevated Distress)' || chr(10) || body || chr(10) || 'Reply with JSON only.') AS prompt_hash FROM c""")
def audit_prompts(spark, sf):
    c = b.table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("posts"))
    p = narrate.audit_prompt(F.col("posts"), F.lit("talk"), F.lit("2018-W01"), F.lit(2))
    return g.select("conv_id", F.sha2(p, 256).alias("prompt_hash"))


@query("linear_attribution", "WITH " + b.STATES + ", i AS (" + " UNION ALL ".join(
    f"SELECT community, '{c}' AS feature, avg(abs({w}::DOUBLE * d)) AS importance FROM (SELECT community, {c} - avg({c}) OVER (PARTITION BY community) AS d FROM states WHERE label IS NOT NULL) GROUP BY community"
    for c, w in b.WEIGHTS.items()) + ") SELECT community, feature, round(importance, 6) AS importance FROM i")
def linear_attribution(spark, sf):
    cols = list(b.WEIGHTS)
    scored = b.stored(b.scored_panel(spark, sf))
    rows = learn.labeled_rows(scored, cols, b.CUTS)
    model = F.struct(F.lit(0.0).alias("intercept"), F.array(*[F.lit(w) for w in b.WEIGHTS.values()]).alias("coef"))
    models = scored.select("community").distinct().withColumn("model", model)
    return shown(learn.linear_attribution(rows, models, cols))


@query("top_importance", "WITH " + b.PANEL + ", i AS (" + " UNION ALL ".join(f"SELECT community, '{c}' AS feature, stddev_pop({c}) AS importance FROM panel GROUP BY community" for c in b.PANEL_FEATURES) + """)
SELECT community, feature, rank FROM (SELECT community, feature, row_number() OVER (PARTITION BY community ORDER BY round(importance, 9) DESC, feature) AS rank FROM i) WHERE rank <= 5""")
def top_importance(spark, sf):
    long = monitor.long_features(b.order_panel(spark, sf), b.PANEL_FEATURES).groupBy("community", "feature").agg(F.stddev_pop("value").alias("importance"))
    return shown(stats.top_features(long, F.col("importance"), 5).select("community", "feature", "rank"))
