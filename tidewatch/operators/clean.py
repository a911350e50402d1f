"""Row rules, privacy, text cleaning, contracts and de-duplication of posts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions import dates, text
from tidewatch.schemas import CONTRACTS, DELETED_BODIES, PANEL_KEYS
from tidewatch.session import written

#: Repeated keys that ``keep_first`` broadcasts at most, in bytes.
REPEATED_BYTES = 32 << 20


def community_key(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Trimmed lower-case community name, with an optional alias table."""
    key = F.lower(F.trim(c.cast("string")))
    if not aliases:
        return key
    pairs = [F.lit(x) for kv in aliases.items() for x in (kv[0].strip().lower(), kv[1])]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def skip_reason(community: str | None = None, min_chars: int = 10) -> Column:
    """First rule a raw archive row breaks (null = keep).

    Reads is_self, selftext, community, created_utc and an optional corrupt-record
    marker ``_corrupt_record``.
    """
    body = text.strip_unicode(F.coalesce(F.col("selftext"), F.lit("")))
    expr = F.when(F.col("_corrupt_record").isNotNull(), "json")
    expr = expr.when(~F.coalesce(F.col("is_self"), F.lit(False)), "non_self")
    expr = expr.when(F.lower(body).isin(*DELETED_BODIES) | (F.length(body) < min_chars), "body")
    if community:
        expr = expr.when(F.lower(F.trim(F.coalesce(F.col("community"), F.lit("")))) != community.lower(), "community")
    return expr.when(dates.number_or_null(F.col("created_utc")).isNull(), "clock")


def apply_row_rules(raw: DataFrame, community: str | None = None, min_chars: int = 10) -> DataFrame:
    """Adds ``skip_reason`` to every archive row; keep rows where it is null."""
    df = raw if "_corrupt_record" in raw.columns else raw.withColumn("_corrupt_record", F.lit(None).cast("string"))
    return df.withColumn("skip_reason", skip_reason(community, min_chars))


def canonical_archive_rows(ruled: DataFrame, data_source: str) -> DataFrame:
    """Canonical six columns of the rows that broke no rule."""
    body = text.strip_unicode(F.col("selftext"))
    community = F.lower(F.trim(F.col("community")))
    created = dates.number_or_null(F.col("created_utc")).cast("long")
    author = F.trim(F.coalesce(F.col("author"), F.lit("")))
    kept = ruled.where(F.col("skip_reason").isNull())
    return kept.select(
        F.when(F.trim(F.coalesce(F.col("post_id"), F.lit(""))) == "", text.content_id(community, created, body))
        .otherwise(F.trim(F.col("post_id"))).alias("post_id"),
        created.alias("created_utc"),
        body.alias("selftext"),
        community.alias("community"),
        F.when(author.isin("[deleted]", "[removed]", "None"), F.lit("")).otherwise(author).alias("author"),
        F.lit(data_source).alias("data_source"),
    )


def row_rule_counts(ruled: DataFrame, *by: str) -> DataFrame:
    """Counters per file (or any columns): parsed, kept and one count per reason."""
    reason = F.col("skip_reason")
    # A row without a usable clock was parsed, and is booked under the JSON counter.
    return ruled.groupBy(*by).agg(
        F.count_if(reason.isNull() | (reason != "json")).alias("parsed"),
        F.count_if(reason.isNull()).alias("kept"),
        F.count_if(reason.isin("json", "clock")).alias("skipped_json"),
        F.count_if(reason == "non_self").alias("skipped_non_self"),
        F.count_if(reason == "body").alias("skipped_body"),
        F.count_if(reason == "community").alias("skipped_community"),
    )


def repair_ids(posts: DataFrame) -> DataFrame:
    """Blank or placeholder ids become a hash of community, clock and body."""
    made = text.content_id(F.col("community"), F.col("created_utc"), F.coalesce(F.col("selftext"), F.lit("")))
    return posts.withColumn("post_id", F.when(text.is_weak_id(F.col("post_id")), made).otherwise(F.col("post_id")))


def between_dates(posts: DataFrame, start: str | None, end: str | None, clock: str = "created_utc") -> DataFrame:
    """Inclusive range; the end bound is midnight of the end date, as in the source rules."""
    out = posts
    if start:
        out = out.where(F.col(clock) >= F.unix_timestamp(F.lit(start).cast("timestamp")))
    if end:
        out = out.where(F.col(clock) <= F.unix_timestamp(F.lit(end).cast("timestamp")))
    return out


def strip_personal_data(posts: DataFrame, salt: str) -> DataFrame:
    """author -> author_hash; URLs and e-mail addresses out of title and body."""
    out = posts
    if "author" in posts.columns:
        out = out.withColumn("author_hash", text.pseudonym(F.col("author").cast("string"), salt)).drop("author")
    for c in ("title", "selftext"):
        if c in posts.columns:
            out = out.withColumn(c, text.strip_emails(text.strip_urls(F.col(c).cast("string"))))
    return out


def drop_deleted(posts: DataFrame) -> DataFrame:
    return posts.where(~F.coalesce(F.col("selftext"), F.lit("")).isin(*DELETED_BODIES))


def clean_posts(posts: DataFrame, min_length: int = 20) -> DataFrame:
    """Deleted posts out, ``clean_text`` from title and body, short texts out.

    The length rule is an array filter under ``explode``: a plain ``where`` would be
    pushed below the projection and run the cleaning a second time on every text.
    """
    body = text.clean(F.col("selftext"))
    whole = text.join_title(text.clean(F.col("title")), body) if "title" in posts.columns else body
    long_enough = F.filter(F.array(whole), lambda t: F.length(t) >= min_length)
    return drop_deleted(posts).select(*[c for c in posts.columns if c != "clean_text"], F.explode(long_enough).alias("clean_text"))


def resolve_clock(posts: DataFrame, day_column: str = "created_utc_dt") -> DataFrame:
    """``ts`` from the date column, else from unix seconds; rows with neither are dropped."""
    unix = F.timestamp_micros((dates.number_or_null(F.col("created_utc")) * 1_000_000).cast("long"))
    ts = F.coalesce(F.col(day_column).cast("timestamp"), unix) if day_column in posts.columns else unix
    return posts.withColumn("ts", ts).where(F.col("ts").isNotNull())


def missing_columns(df: DataFrame, artifact: str) -> list[str]:
    return sorted(set(CONTRACTS[artifact]) - set(df.columns))


def contract_violations(posts: DataFrame) -> DataFrame:
    """One row of counts of raw-contract violations."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return posts.agg(
        F.count_if(blank("post_id")).alias("blank_post_id"),
        F.count_if(dates.number_or_null(F.col("created_utc")).isNull()).alias("bad_created_utc"),
        F.count_if(blank("community")).alias("blank_community"),
    )


def validate(df: DataFrame, artifact: str) -> DataFrame:
    """Returns ``df`` or raises ValueError when the artifact breaks its contract."""
    missing = missing_columns(df, artifact)
    if missing:
        raise ValueError(f"{artifact} artifact is missing required columns: {missing}")
    if artifact == "raw":
        bad = contract_violations(df).first().asDict()
        broken = {k: v for k, v in bad.items() if v}
        if broken:
            raise ValueError(f"raw artifact has invalid values: {broken}")
    if artifact == "features" and not [c for c in df.columns if c not in PANEL_KEYS]:
        raise ValueError("features artifact must contain at least one feature column")
    return df


def source_compatibility(posts: DataFrame, source: str = "data_source", max_bad: float = 0.10) -> DataFrame:
    """Share of unusable clocks per source and whether the source may be merged."""
    bad = F.avg(dates.number_or_null(F.col("created_utc")).isNull().cast("double"))
    return (
        posts.groupBy(source)
        .agg(F.count("*").alias("n_rows"), bad.alias("bad_clock_share"))
        .withColumn("compatible", F.col("bad_clock_share") <= max_bad)
    )


def keep_first(df: DataFrame, keys: Iterable[str], order: Iterable[Column], most_bytes: int = REPEATED_BYTES) -> DataFrame:
    """One row per key: the first in ``order``; null keys are a key like any other.

    Keys found more than once are told by a count of the keys alone, which is stored.  While they take up to
    ``most_bytes`` they are broadcast: rows of all other keys then pass as they are, without a shuffle, and only repeated
    ones go through the wide aggregate.  Beyond that every row goes through it.  It combines in the map tasks either
    way, so that of a hot key one row per task is shuffled.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]

    def first_of(rows: DataFrame) -> DataFrame:
        picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)

    again = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_again_{k}") for k in keys])
    again = written(again, "repeated-keys")
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"_again_{k}").cast("string")), F.lit(0)) + 32 for k in keys])
    if again.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] > most_bytes:
        return first_of(df)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_again_{k}")) for k in keys])
    single = df.join(F.broadcast(again), same, "left_anti")
    return single.unionByName(first_of(df.join(F.broadcast(again), same, "left_semi")))


def merge_with_fill(primary: DataFrame, fill: DataFrame, key: str = "post_id") -> DataFrame:
    """Union in which primary rows win over fill rows of the same id."""
    both = primary.withColumn("_rank", F.lit(0)).unionByName(fill.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "_rank")]
    order = [F.col("_rank"), *[F.col(c) for c in ("created_utc", "selftext") if c in cols]]
    return keep_first(both, [key], order).drop("_rank")


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    if not frames:
        raise ValueError("no source to read")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ingest_counters(posts: DataFrame, by: str = "data_source") -> DataFrame:
    return posts.groupBy(by).agg(
        F.count("*").alias("row_count"),
        F.min("created_utc").alias("min_created_utc"),
        F.max("created_utc").alias("max_created_utc"),
    )


def volume_gate(clean: DataFrame, weeks: DataFrame, min_posts: int = 50, min_weeks: int = 33) -> DataFrame:
    """Per community: posts, weeks and whether both reach the minimum (report, nothing is dropped)."""
    p = clean.groupBy("community").agg(F.count("*").alias("n_posts"))
    w = weeks.groupBy("community").agg(F.count("*").alias("n_weeks"))
    return p.join(w, "community", "full").select(
        "community",
        F.coalesce("n_posts", F.lit(0)).alias("n_posts"),
        F.coalesce("n_weeks", F.lit(0)).alias("n_weeks"),
        ((F.coalesce("n_posts", F.lit(0)) >= min_posts) & (F.coalesce("n_weeks", F.lit(0)) >= min_weeks)).alias("enough"),
    )
