"""The three jobs: posts to features, features to evaluated predictions, predictions to reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidewatch.operators import clean, features, folds, learn, metrics, monitor, scoring, temporal, topics, weekly
from tidewatch.schemas import SCORE_WEIGHTS, STATE_CUTS
from tidewatch.session import cut_lineage
from tidewatch.sources import files


def collect(frames: Iterable[DataFrame], salt: str) -> DataFrame:
    """Sources to stored posts: union, one row per id, personal data out."""
    posts = clean.union_sources(frames)
    posts = posts.withColumn("community", clean.community_key(F.col("community")))
    first = clean.keep_first(clean.repair_ids(posts), ["post_id"], [F.col("created_utc"), F.col("selftext")])
    return clean.strip_personal_data(first, salt)


def prepare(posts: DataFrame, min_length: int = 20) -> DataFrame:
    """Stored posts to clean posts with a clock and a community key."""
    keyed = posts.withColumn("community", clean.community_key(F.col("community")))
    return clean.resolve_clock(clean.clean_posts(keyed, min_length))


def store_clean(posts: DataFrame, path: str, min_length: int = 20) -> DataFrame:
    """Writes the clean posts and returns them read back.

    The feature job reads its input twice: once with the texts and once for (community,
    clock, author).  From a stored table the second read touches three narrow columns
    and no text is cleaned again.
    """
    keep = ("post_id", "community", "ts", "author_hash", "score", "num_comments", "data_source", "clean_text")
    rows = prepare(posts, min_length)
    files.spread_by_community(rows.select(*[c for c in keep if c in rows.columns])).write.mode(
        "overwrite").partitionBy("community").parquet(path)
    return posts.sparkSession.read.parquet(path)


def feature_panel(
    clean_rows: DataFrame, lexicons: Mapping[str, Iterable[str]], valence: Mapping[str, float] | DataFrame | None = None,
    negators: Sequence[str] = (), topic_column: str | None = None, windows: Sequence[int] = (2, 4),
) -> DataFrame:
    """Clean posts to the full feature matrix.

    Sentiment columns (pos, neg, neu, compound) are computed from ``valence`` unless the
    posts already carry them: a mapping travels as literals, a table (token, valence) of any size is joined.  Without
    topics the topic block is three zero columns.
    """
    if isinstance(valence, DataFrame):
        flips = clean_rows.sparkSession.createDataFrame([(n,) for n in negators], "token string") if negators else None
        clean_rows, valence = features.sentiment_join(clean_rows, valence, flips), None
    given = "compound" in clean_rows.columns
    metrics_rows = features.post_metrics(clean_rows, lexicons, valence=None if given else valence or {}, negators=negators)
    panel = features.weekly_features(metrics_rows)
    if topic_column:
        panel = topics.attach_topics(panel, topics.topic_features(topics.topic_counts(clean_rows, topic_column)))
    else:
        panel = topics.no_topics(panel)
    return temporal.add_temporal(panel, windows=windows)


def evaluate(
    panel: DataFrame, columns: Sequence[str], weights: Mapping[str, float] = SCORE_WEIGHTS,
    cuts: Sequence[float] = STATE_CUTS, sequence_length: int = 6, threshold: float = 0.3,
) -> dict[str, DataFrame]:
    """Both models walked forward, their ensemble, metrics and lead times.

    The fold records feed several reports, so they are kept as checkpoints: a few
    hundred rows per community that took thousands of fits.
    """
    scored = weekly.with_week_index(scoring.composite_score(panel, weights, normalize=False))
    tab = cut_lineage(learn.walk_forward(scored, columns, cuts=cuts, threshold=threshold))
    seq = cut_lineage(learn.walk_forward(scored, columns, cuts=cuts, threshold=threshold, sequence_length=sequence_length))
    # A skipped fold stays as a week without values: it ends a run of flagged weeks.
    actual = F.when(~F.col("skipped"), F.col("actual")).alias("actual")
    pick = lambda df: df.select("community", "week_idx", "pred", "prob", actual)
    tabular, sequence = pick(tab), pick(seq)
    ens = metrics.ensemble(sequence, tabular, threshold)
    named = (
        tabular.withColumn("model", F.lit("tabular"))
        .unionByName(metrics.binary(sequence, 2).withColumn("model", F.lit("sequence")))
        .unionByName(metrics.binary(ens, 2).withColumn("model", F.lit("ensemble")))
    )
    return {
        "folds_tabular": tab, "folds_sequence": seq, "predictions": named,
        "metrics": metrics.metric_pack(named), "usefulness": metrics.decision_usefulness(named),
        "lead_time": metrics.lead_time_summary(named), "diagnostics": folds.fold_diagnostics(tab),
        "classes": metrics.per_class(sequence.withColumn("model", F.lit("sequence"))),
    }


def watch(panel: DataFrame, weights: Mapping[str, float] = SCORE_WEIGHTS, cuts: Sequence[float] = STATE_CUTS) -> dict[str, DataFrame]:
    """Drift, level changes and state escalations of a panel."""
    scored = scoring.composite_score(panel, weights, normalize=True)
    labeled = scoring.fit_states(scored, cuts)
    drifted = monitor.drift(panel)
    return {
        "drift": drifted, "changes": monitor.level_changes(drifted),
        "escalations": monitor.escalations(labeled.withColumn("score", F.col("distress_score"))),
    }
