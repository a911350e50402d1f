"""Context rows, template briefs and case studies as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import dates, mathx
from tidewatch.operators.monitor import name_of
from tidewatch.schemas import STATE_NAMES

# Fixed value: change in percent below which a feature counts as flat.
FLAT_PCT = 0.5

# Sentences of a brief.
NO_ACTION = "Review the moderation playbook for this signal level."
SENTENCE_1 = "%s (%s): the models put this week at %s, a statement about the community as a whole and about no single member."
SENTENCE_2 = (
    "The distress score moved by %+.4f since the week before; by overall importance the leading features are %s "
    "(the JSON has their direction this week)."
)
SENTENCE_3 = "Recommended action: %s"
SERVED_1 = "%s (%s) shows a community-level signal of %s. "
SERVED_2 = "The composite distress indicator %s compared with the prior week. "
SERVED_3 = "The most influential signals this week include %s."
SERVED_4 = "Suggested action: %s"


def playbook_actions(playbook: DataFrame, column: str = "value") -> DataFrame:
    """(heading, action) per state name: first bullet of the ``##`` sections that name it.

    ``playbook`` is one row of whole text; sections are cut out with array functions.
    """
    sections = F.slice(F.split(F.concat(F.lit("\n"), F.col(column)), r"\n[ \t]*## "), 2, 10_000)
    part = playbook.select(F.posexplode(sections).alias("pos", "section"))
    lines = F.transform(F.split("section", "\n"), lambda x: F.trim(x))
    bullet = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("- ")) & (F.length(x) > 2)), F.lit(0))
    names = F.filter(F.array(*[F.lit(n) for n in STATE_NAMES.values()]), lambda n: F.contains(F.element_at(lines, 1), n))
    found = part.select("pos", F.trim(F.substring(bullet, 3, 10_000)).alias("action"), F.explode(names).alias("heading"))
    return found.where(F.col("action").isNotNull()).groupBy("heading").agg(F.min_by("action", "pos").alias("action"))


def with_actions(rows: DataFrame, actions: DataFrame, state: str = "predicted_state") -> DataFrame:
    """Playbook action for a state name; without one the general advice."""
    return rows.join(actions.withColumnRenamed("heading", state), state, "left").withColumn(
        "action", F.coalesce("action", F.lit(NO_ACTION))
    )


def feature_moves(panel: DataFrame, ranked: Sequence[str], window: int = 4) -> DataFrame:
    """Long (community, week, rank, feature, value, baseline, delta_pct, direction).

    Baseline = mean of the preceding weeks; a community's first week uses its whole series.
    """
    order = Window.partitionBy("community").orderBy("week_start")
    past, whole = order.rowsBetween(-window, -1), Window.partitionBy("community")
    used = [f for f in ranked if f in panel.columns]
    cells = []
    for i, f in enumerate(used, 1):
        v = F.col(f).cast("double")
        base = F.when(F.row_number().over(order) == 1, F.avg(v).over(whole)).otherwise(F.avg(v).over(past))
        cells.append(F.struct(F.lit(i).alias("rank"), F.lit(f).alias("feature"), v.alias("value"), base.alias("baseline")))
    wide = panel.select("community", "week_start", *[c.alias(f"_m{i}") for i, c in enumerate(cells)])
    long = wide.select("community", "week_start", F.inline(F.array(*[F.col(f"_m{i}") for i in range(len(cells))])))
    pct = mathx.pct_delta(F.col("value"), F.col("baseline"))
    word = F.when(F.abs("delta_pct") < FLAT_PCT, "flat").when(F.col("value") > F.col("baseline"), "up").otherwise("down")
    return long.withColumn("delta_pct", pct).withColumn("direction", word)


def brief_context(panel: DataFrame, predictions: DataFrame, ranked: Sequence[str], top: int = 5,
                  score: str = "distress_score") -> DataFrame:
    """One row per predicted week: state, previous state, score change, top feature moves.

    ``panel`` has the score and week_idx; ``predictions`` is one model per community.
    """
    order = Window.partitionBy("community").orderBy("week_start")
    p = predictions.select("community", "week_idx", F.col("pred").cast("int").alias("pred"))
    rows = panel.join(p, ["community", "week_idx"], "left")
    moves = feature_moves(panel, ranked[:top]).groupBy("community", "week_start").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "feature", "direction", "delta_pct"))),
            lambda x: F.struct(x["feature"].alias("feature"), x["direction"].alias("direction"), x["delta_pct"].alias("delta_pct")),
        ).alias("top_features")
    )
    text = lambda c: name_of(c, STATE_NAMES, c.cast("string"))
    before = F.lag("pred").over(order)
    ctx = rows.withColumn("_prev", before).withColumn(
        "distress_score_delta", F.round(F.coalesce(F.col(score) - F.lag(score).over(order), F.lit(0.0)), 4) + F.lit(0.0)
    ).where(F.col("pred").isNotNull())
    return ctx.join(moves, ["community", "week_start"], "left").select(
        "community", "week_start", "week_idx",
        dates.week_key(F.col("iso_year"), F.col("iso_week")).alias("week"),
        text(F.col("pred")).alias("predicted_state"),
        F.coalesce(text(F.col("_prev")), F.lit("n/a")).alias("previous_state"),
        "distress_score_delta", "top_features",
    )


def context_json(ctx: DataFrame) -> DataFrame:
    """The context as JSON text for a writer outside the engine (no call is made)."""
    body = F.to_json(F.struct(
        F.concat(F.lit("r/"), F.col("community")).alias("community"), "week", "predicted_state", "previous_state",
        "distress_score_delta", "top_features",
    ))
    return ctx.withColumn("context_json", body)


def prompt_text(ctx: DataFrame, playbook: Column, sentences: int = 3) -> DataFrame:
    """Prompt column: context, playbook and the writing rules."""
    rules = F.lit(
        f"Write {sentences} sentences: the community-level signal, the top features with the score change as given, "
        'and one action starting with "Recommended action:" taken from the playbook. Use only the data above.'
    )
    return context_json(ctx).withColumn("prompt", F.concat_ws("\n\n", F.col("context_json"), playbook, rules))


def audit_prompt(posts: Column, community: Column, week: Column, label: Column, max_posts: int | None = None) -> Column:
    """Second-rater prompt for one week from the listed posts (whole texts), the first ``max_posts`` of them if given."""
    listed = posts if max_posts is None else F.slice(posts, 1, max_posts)
    numbered = F.transform(listed, lambda p, i: F.concat(F.lit("Post "), (i + 1).cast("string"), F.lit(": "), p))
    return F.concat_ws(
        "\n", F.concat(F.lit("Community: r/"), community), F.concat(F.lit("Week: "), week),
        F.format_string("Model label: %d (%s)", label, name_of(label, STATE_NAMES, F.lit("Unknown"))),
        F.array_join(numbered, "\n\n"), F.lit("Reply with JSON only."),
    )


def _names(n: int, empty: str) -> Column:
    listed = F.array_join(F.transform(F.slice("top_features", 1, n), lambda x: x["feature"]), ", ")
    return F.when(F.coalesce(F.size("top_features"), F.lit(0)) > 0, listed).otherwise(F.lit(empty))


def template_brief(ctx: DataFrame, actions: DataFrame) -> DataFrame:
    """Deterministic three-sentence brief."""
    rows = with_actions(ctx, actions)
    brief = F.concat_ws(
        " ",
        F.format_string(SENTENCE_1, F.concat(F.lit("r/"), F.col("community")), F.col("week"), F.col("predicted_state")),
        F.format_string(SENTENCE_2, F.col("distress_score_delta"), _names(3, "listed features")),
        F.format_string(SENTENCE_3, F.col("action")),
    )
    return rows.withColumn("brief", brief)


def served_brief(ctx: DataFrame, actions: DataFrame) -> DataFrame:
    """Two-paragraph brief of the scoring job."""
    delta = F.col("distress_score_delta")
    word = F.when(delta > 0, "rose").when(delta < 0, "fell").otherwise("held steady")
    first = F.concat(
        F.format_string(SERVED_1, F.col("community"), F.col("week"), F.col("predicted_state")),
        F.format_string(SERVED_2, word), F.format_string(SERVED_3, _names(3, "key signals")),
    )
    return with_actions(ctx, actions).withColumn("brief", F.concat_ws("\n\n", first, F.format_string(SERVED_4, F.col("action"))))


def latest_briefs(ctx: DataFrame, actions: DataFrame, n: int = 4, source: str = "template") -> DataFrame:
    """Briefs of each community's last n predicted weeks, in the shape of the brief store."""
    back = Window.partitionBy("community").orderBy(F.desc("week_start"))
    last = ctx.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= n).drop("_r")
    return template_brief(last, actions).select("community", F.col("week").alias("week_key"), F.col("brief").alias("text"), F.lit(source).alias("source"))


def case_lookback(panel: DataFrame, events: DataFrame, features: Sequence[str], predictions: DataFrame | None = None, weeks: int = 3) -> DataFrame:
    """The weeks before each event: feature values against the community's whole mean.

    ``events`` has community and week_idx.  Each event asks for the rows t-weeks..t-1
    by position, an equi-join on the panel key.
    """
    whole = Window.partitionBy("community")
    base = panel.select("community", "week_idx", "week_start", *features, *[F.avg(F.col(f).cast("double")).over(whole).alias(f"_b_{f}") for f in features])
    asked = events.select("community", F.col("week_idx").alias("event_idx"), F.explode(
        F.array(*[F.lit(i) for i in range(1, weeks + 1)])).alias("weeks_before")).withColumn("week_idx", F.col("event_idx") - F.col("weeks_before"))
    rows = asked.join(base, ["community", "week_idx"])
    if predictions is not None:
        rows = rows.join(predictions.select("community", "week_idx", "pred", "prob"), ["community", "week_idx"], "left")
    else:
        rows = rows.withColumn("pred", F.lit(None).cast("int")).withColumn("prob", F.lit(None).cast("double"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), F.col(f"_b_{f}").alias("average")) for f in features])
    long = rows.select(
        "community", "event_idx", "week_idx", "week_start", "weeks_before",
        F.coalesce("prob", F.lit(0.0)).alias("prob"),
        F.when(F.col("pred") == 1, "FLAGGED").otherwise("not flagged").alias("flagged"), F.inline(cells),
    )
    pct = F.when(F.col("average") != 0, (F.col("value") - F.col("average")) / F.abs("average") * 100.0).otherwise(F.lit(0.0))
    return long.withColumn("diff_pct", pct).withColumn("direction", F.when(F.col("diff_pct") > 0, "above").otherwise("below"))


def label_agreement(labels: DataFrame, second: DataFrame, keys: Sequence[str] = ("community", "week_start")) -> DataFrame:
    """Agreement of model labels with a second rater; a missing second label is not an agreement."""
    j = labels.join(second, list(keys), "left")
    return j.groupBy("community").agg(
        F.count("*").alias("n_audited"),
        F.count_if(F.col("model_label") == F.col("second_label")).alias("n_agreement"),
        F.count_if(F.col("second_label").isNotNull() & (F.col("model_label") != F.col("second_label"))).alias("n_disagreement"),
    ).withColumn("agreement_rate", mathx.ratio(F.col("n_agreement"), F.col("n_audited")))


def sample_labelled(labels: DataFrame, n: int = 10, seed: int = 42, label: str = "label") -> DataFrame:
    """Seeded sample of n labelled weeks per community (a sampling operator, hash ordered)."""
    h = F.xxhash64(F.lit(seed), F.col("community"), F.col("week_start"))
    w = Window.partitionBy("community").orderBy("_h", "week_start")
    return labels.where(F.col(label).isNotNull()).withColumn("_h", h).withColumn("_r", F.row_number().over(w)).where(
        F.col("_r") <= n).drop("_h", "_r")
