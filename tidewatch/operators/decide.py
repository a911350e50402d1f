"""Decisions on top of predictions: budgets, triage, replay, model choice, scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions import dates, mathx
from tidewatch.operators.monitor import name_of
from tidewatch.schemas import STATE_NAMES

# Order in which a model is preferred when none is asked for.
MODEL_ORDER = ("ensemble", "sequence", "tabular")


def latest_known(predictions: DataFrame) -> DataFrame:
    """Last known probability (4 digits) and state per community; none gives 0."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("week_idx")))
    return predictions.groupBy("community").agg(last("prob").alias("_p"), last("pred").alias("_s")).select(
        "community",
        F.round(F.coalesce("_p", F.lit(0.0)), 4).alias("probability"),
        F.when(F.col("_s").cast("int").between(0, 3), F.col("_s").cast("int")).otherwise(F.lit(0)).alias("state"),
    )


def with_effectiveness(latest: DataFrame, overrides: Mapping[str, float], default: float = 0.7) -> DataFrame:
    if not overrides:
        return latest.withColumn("effectiveness", F.lit(default))
    table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return latest.withColumn("effectiveness", F.coalesce(F.element_at(table, F.col("community")), F.lit(default)))


def _with_totals(latest: DataFrame, *by: str) -> DataFrame:
    """Number, best weight, weight sum and the winner, without a window over everything.

    The totals are plain aggregates (combined in the map tasks) that reach the rows as
    one scalar, so no community list is ever sorted in a single task.
    """
    weight = F.col("probability") * F.col("effectiveness")
    totals = latest.agg(
        F.struct(
            F.count("*").alias("n"), F.sum(weight).alias("w"), F.max(weight).alias("best"),
            F.min_by("community", F.struct(-weight, F.col("community"))).alias("winner"),
        )
    ).scalar()
    return latest.withColumn("_w", weight).withColumn("_t", totals)


def _budgets(rows: DataFrame, budgets: Sequence[float] | None, hours: float) -> tuple[DataFrame, Column]:
    if budgets is None:
        return rows, F.lit(float(hours))
    listed = F.array(*[F.lit(float(b)) for b in budgets])
    return rows.withColumn("budget", F.explode(listed)), F.col("budget")


def allocate(latest: DataFrame, hours: float = 10.0, min_hours: float = 0.5, budgets: Sequence[float] | None = None) -> DataFrame:
    """Hours that maximise sum(p * e * x) under a budget and a floor per community.

    The optimum of this linear programme has a closed form: everybody gets the floor
    (shrunk when it does not fit) and the rest goes to the largest p * e, lowest name
    on ties; with no positive weight the rest stays unspent.
    """
    rows, total = _budgets(_with_totals(latest), budgets, hours)
    floor = F.least(F.lit(float(min_hours)), total / F.col("_t")["n"])
    rest = F.when(
        (F.col("community") == F.col("_t")["winner"]) & (F.col("_t")["best"] > 0), total - floor * F.col("_t")["n"]
    ).otherwise(F.lit(0.0))
    return rows.withColumn("hours", F.round(floor + rest, 2)).drop("_w", "_t")


def allocate_pro_rata(latest: DataFrame, hours: float = 10.0, min_hours: float = 0.5, budgets: Sequence[float] | None = None) -> DataFrame:
    """Floor for everybody, the rest in proportion to p * e."""
    rows, total = _budgets(_with_totals(latest), budgets, hours)
    floor = F.least(F.lit(float(min_hours)), total / F.col("_t")["n"])
    rest = total - floor * F.col("_t")["n"]
    share = F.when((F.col("_t")["w"] > 0) & (rest > 0), F.round(rest * F.col("_w") / F.col("_t")["w"], 2)).otherwise(F.lit(0.0))
    return rows.withColumn("hours", floor + share).drop("_w", "_t")


def objective(allocation: DataFrame) -> DataFrame:
    by = ["budget"] if "budget" in allocation.columns else []
    value = F.sum(F.col("probability") * F.col("effectiveness") * F.col("hours"))
    return allocation.groupBy(*by).agg(F.round(value, 4).alias("objective"), F.sum("hours").alias("hours_used"))


def sensitivity_table(allocation: DataFrame, communities: Sequence[str]) -> DataFrame:
    """Budget rows, one column of hours per listed community."""
    return allocation.groupBy("budget").pivot("community", list(communities)).agg(F.first("hours"))


def allocation_text(allocation: DataFrame) -> DataFrame:
    """One printable line per community, ranked by hours."""
    label = name_of(F.col("state"), STATE_NAMES, F.lit("Unknown"))
    line = F.format_string(
        "  r/%-18s  %4.1f hrs  [%s, p=%.2f]", F.col("community"), F.col("hours"), label, F.col("probability")
    )
    return allocation.select("community", "hours", line.alias("line"))


# --- model choice and replay -------------------------------------------------


def available_models(predictions: DataFrame) -> DataFrame:
    """Models a community has; both base models together also offer the ensemble."""
    have = predictions.groupBy("community").agg(F.collect_set("model").alias("m"))
    pair = F.array_contains("m", "sequence") & F.array_contains("m", "tabular")
    return have.select("community", F.when(pair, F.array_union("m", F.array(F.lit("ensemble")))).otherwise(F.col("m")).alias("models"))


def choose_model(predictions: DataFrame, preferred: str | None = None, order: Sequence[str] = MODEL_ORDER) -> DataFrame:
    """The preferred model when the community has it, else the first of ``order`` it has, else any (by name)."""
    ranked = [F.struct(F.lit(i).alias("r"), F.lit(m).alias("m")) for i, m in enumerate(order)]
    if preferred:
        ranked.insert(0, F.struct(F.lit(-1).alias("r"), F.lit(preferred).alias("m")))
    known = F.filter(F.array(*ranked), lambda x: F.array_contains("models", x["m"]))
    return available_models(predictions).select(
        "community", F.coalesce(F.array_min(known)["m"], F.array_min("models")).alias("model")
    )


def replay_weeks(panel: DataFrame) -> DataFrame:
    """Distinct ISO weeks of all communities with their Monday."""
    return panel.select("iso_year", "iso_week").distinct().withColumn(
        "week_start", dates.iso_monday(F.col("iso_year"), F.col("iso_week"))
    )


def replay_rows(panel: DataFrame, week: str) -> DataFrame:
    """Each community's row for a replay week: that ISO week, else the last before it, else its first.

    One aggregate per community; ISO keys make the exact match the maximum of the rows not after.
    """
    day = F.lit(week).cast("date")
    key = dates.iso_key(F.col("iso_year"), F.col("iso_week"))
    asked = dates.iso_key(dates.iso_year(day), dates.iso_week(day))
    rest = [c for c in panel.columns if c != "community"]
    row = F.struct(*rest)
    picked = panel.groupBy("community").agg(
        F.max_by(row, F.when(key <= asked, key)).alias("_at"), F.min_by(row, key).alias("_first")
    )
    best = F.coalesce(F.col("_at"), F.col("_first"))
    return picked.select("community", *[best[c].alias(c) for c in rest])


def replay_asof(panel: DataFrame, moments: DataFrame, clock: str = "replay_week") -> DataFrame:
    """Replay many weeks at once: (community, moment) with the panel week in force.

    A backward as-of join without inequality: moments and weeks of a community are
    merged in time order and the last week seen is carried forward.
    """
    weeks = panel.select("community", F.col("week_start").alias("_at"), F.lit(0).alias("_kind"), "week_start")
    asks = moments.select("community", F.col(clock).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("date").alias("week_start"))
    past = Window.partitionBy("community").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("community")
    merged = weeks.unionByName(asks).withColumn("_last", F.last("week_start", True).over(past)).withColumn(
        "_first", F.min("week_start").over(whole)
    )
    return merged.where(F.col("_kind") == 1).select(
        "community", F.col("_at").alias(clock), F.coalesce("_last", "_first").alias("week_start")
    )


def trailing(panel: DataFrame, week: str, n: int = 12) -> DataFrame:
    """The n rows of each community up to a week."""
    back = Window.partitionBy("community").orderBy(F.desc("week_start"))
    return panel.where(F.col("week_start") <= F.lit(week).cast("date")).withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)


def triage(snapshot: DataFrame) -> DataFrame:
    """Communities by severity (3, 2, 1, 0, unknown), then probability, then name."""
    return snapshot.withColumn("severity", F.lit(3) - F.coalesce(F.col("state"), F.lit(-1))).orderBy(
        "severity", F.desc(F.coalesce("prob", F.lit(0.0))), "community"
    )


def confidence_word(prob: Column) -> Column:
    return F.when(prob >= 0.6, "high").when(prob >= 0.4, "moderate").otherwise("low")


# --- feature selection and what-if -------------------------------------------


def select_features(importance: DataFrame, known: DataFrame, ratio: float = 0.01, min_features: int = 20, max_features: int = 80) -> DataFrame:
    """Known features with importance >= ratio * top; at least min, at most max, by importance."""
    rows = importance.join(known.select("feature"), "feature", "left_semi")
    by = ["community"] if "community" in rows.columns else []
    if not by:
        rows = rows.withColumn("community", F.lit(""))
    order = Window.partitionBy("community").orderBy(F.desc(F.round("importance", 9)), "feature")
    top = F.max("importance").over(Window.partitionBy("community"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("_keep", F.col("importance") >= top * ratio)
    ranked = ranked.withColumn("_n", F.count_if("_keep").over(Window.partitionBy("community")))
    wide = F.when(F.col("_n") < min_features, F.col("rank") <= min_features).otherwise(F.col("_keep"))
    kept = ranked.where(wide & (F.col("rank") <= max_features)).drop("_keep", "_n")
    return kept if by else kept.drop("community")


def resolve_feature(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """Column named like a candidate, else the first that contains one."""
    exact = {c.lower(): c for c in columns}
    for c in candidates:
        if c in exact:
            return exact[c]
    return next((c for c in columns if any(t in c.lower() for t in candidates)), None)


# Column aliases of the three what-if sliders.
SCENARIO_FEATURES = {
    "hopelessness": ("hopelessness_density", "hopelessness", "distress_lexicon_density"),
    "post_volume": ("post_volume", "posts_count", "n_posts", "post_count", "volume"),
    "late_night": ("late_night_post_ratio", "late_night_ratio", "night_post_ratio"),
}


def apply_scenarios(panel: DataFrame, scenarios: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every row under every scenario; a scenario is {"scenario": name, slider: percent}."""
    targets = {k: resolve_feature(panel.columns, v) for k, v in SCENARIO_FEATURES.items()}
    rows = F.array(*[
        F.struct(F.lit(str(s["scenario"])).alias("scenario"), *[F.lit(float(s.get(k, 0.0))).alias(k) for k in targets])
        for s in scenarios
    ])
    wide = panel.withColumn("_s", F.explode(rows))
    out = [F.col("_s")["scenario"].alias("scenario")]
    by_column = {c: k for k, c in targets.items() if c}
    for c in panel.columns:
        if c in by_column:
            out.append((F.col(c).cast("double") * (1 + F.col("_s")[by_column[c]] / 100.0)).alias(c))
        else:
            out.append(F.col(c))
    return wide.select(*out)


def valid_events(events: DataFrame) -> DataFrame:
    """Events (label, date string) with a label and a readable date."""
    e = events.select(F.trim("label").alias("label"), dates.to_timestamp_or_null(F.col("date")).cast("date").alias("event_date"))
    return e.where((F.coalesce("label", F.lit("")) != "") & F.col("event_date").isNotNull())


def events_in_range(events: DataFrame, panel: DataFrame) -> DataFrame:
    """Per community and event: the events between its first and last week.

    A community's span is spread over its calendar years, so the join is on the year.
    """
    span = panel.groupBy("community").agg(F.min("week_start").alias("first"), F.max("week_start").alias("last"))
    years = span.withColumn("_year", F.explode(F.sequence(F.year("first"), F.year("last"))))
    inside = F.col("event_date").between(F.col("first"), F.col("last"))
    return events.withColumn("_year", F.year("event_date")).join(years, "_year").where(inside).select("community", "label", "event_date")
