"""Queries over posts: row rules, ids, clocks, privacy, cleaning, contracts, de-duplication, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import dates, text
from tidewatch.operators import clean, decide, serve
from tidewatch.plans import bindings as b
from tidewatch.plans.registry import query, shown
from tidewatch.sources import files, ledger

SALT = "pepper"

# Archive rows made of documents: some link posts, deleted bodies, bad clocks and blank ids.
ARCHIVE_SQL = """archive AS (
  SELECT CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'd' || doc_id END AS post_id,
         CASE WHEN doc_id % 13 = 0 THEN 'soon' ELSE CAST(1514764800 + doc_id * 3600 AS VARCHAR) END AS created_utc,
         CASE WHEN doc_id % 11 = 0 THEN '[deleted]' ELSE text END AS selftext, ' ' || upper(lang) AS community,
         CASE WHEN doc_id % 7 = 0 THEN '[deleted]' ELSE source END AS author, doc_id % 10 <> 0 AS is_self, doc_id FROM documents),
trimmed AS (SELECT *, regexp_replace(regexp_replace(selftext, '^""" + b.SPACE + "', ''), '" + b.SPACE + """$', '') AS body FROM archive),
ruled AS (SELECT *, CASE WHEN NOT is_self THEN 'non_self' WHEN lower(body) IN ('[deleted]', '[removed]', '') OR length(body) < 10 THEN 'body'
  WHEN lower(trim(community)) <> 'en' THEN 'community' WHEN try_cast(created_utc AS DOUBLE) IS NULL THEN 'clock' END AS skip_reason FROM trimmed)"""


def _archive(spark, sf):
    d = b.table(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("d"), i.cast("string"))).alias("post_id"),
        F.when(i % 13 == 0, "soon").otherwise((F.lit(1514764800) + i * 3600).cast("string")).alias("created_utc"),
        F.when(i % 11 == 0, "[deleted]").otherwise(F.col("text")).alias("selftext"),
        F.concat(F.lit(" "), F.upper("lang")).alias("community"),
        F.when(i % 7 == 0, "[deleted]").otherwise(F.col("source")).alias("author"),
        (i % 10 != 0).alias("is_self"), i,
    )


@query("row_rules", "WITH " + ARCHIVE_SQL + " SELECT doc_id, skip_reason FROM ruled")
def row_rules(spark, sf):
    return clean.apply_row_rules(_archive(spark, sf), "en").select("doc_id", "skip_reason")


@query("row_rule_counts", "WITH " + ARCHIVE_SQL + """
SELECT author, count(*) AS parsed, count(*) FILTER (WHERE skip_reason IS NULL) AS kept, count(*) FILTER (WHERE skip_reason = 'clock') AS skipped_json,
       count(*) FILTER (WHERE skip_reason = 'non_self') AS skipped_non_self, count(*) FILTER (WHERE skip_reason = 'body') AS skipped_body,
       count(*) FILTER (WHERE skip_reason = 'community') AS skipped_community FROM ruled GROUP BY author""")
def row_rule_counts(spark, sf):
    return clean.row_rule_counts(clean.apply_row_rules(_archive(spark, sf), "en"), "author")


@query("archive_posts", "WITH " + ARCHIVE_SQL + """
SELECT CASE WHEN post_id = '' THEN 'hash_' || substr(sha256('en:' || created_utc || ':' || body), 1, 16) ELSE post_id END AS post_id,
       CAST(created_utc AS BIGINT) AS created_utc, sha256(body) AS body_hash, lower(trim(community)) AS community,
       CASE WHEN author = '[deleted]' THEN '' ELSE author END AS author, 'archive' AS data_source FROM ruled WHERE skip_reason IS NULL""")
def archive_posts(spark, sf):
    p = clean.canonical_archive_rows(clean.apply_row_rules(_archive(spark, sf), "en"), "archive")
    return p.withColumn("body_hash", F.sha2("selftext", 256)).drop("selftext")


@query("weak_id_hash", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hash_' || substr(sha256(lang || ':' || (1514764800 + doc_id) || ':' || text), 1, 16)
 ELSE 'd' || doc_id END AS post_id FROM documents""")
def weak_id_hash(spark, sf):
    d = b.table(spark, sf, "documents")
    weak = F.element_at(F.array(F.lit("NaN"), F.lit(" "), F.lit("null"), F.lit("None")), (F.col("doc_id") % 4 + 1).cast("int"))
    posts = d.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, weak).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("post_id"),
        F.col("lang").alias("community"), (F.lit(1514764800) + F.col("doc_id")).alias("created_utc"), F.col("text").alias("selftext"))
    return clean.repair_ids(posts).select("doc_id", "post_id")


@query("unit_normalise", """WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, CASE event_type WHEN 'click' THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE)
  WHEN 'view' THEN CAST(epoch_us(ts) // 1000 AS DOUBLE) WHEN 'error' THEN CAST(epoch_us(ts) // 1000000 AS DOUBLE) * 1e9 END AS num FROM events)
SELECT event_id, event_type, round(CASE event_type WHEN 'click' THEN num WHEN 'view' THEN num / 1000.0::DOUBLE WHEN 'error' THEN num / 1e9::DOUBLE
  WHEN 'signup' THEN CAST(us // 1000000 AS DOUBLE) END, 3) AS created_utc FROM e""")
def unit_normalise(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    sec = F.floor(us / F.lit(1000000)).cast("long")
    e = b.table(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_type") == "click", sec.cast("string"))
        .when(F.col("event_type") == "view", F.floor(us / F.lit(1000)).cast("long").cast("string"))
        .when(F.col("event_type") == "error", (sec.cast("double") * 1e9).cast("string"))
        .when(F.col("event_type") == "signup", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.lit("unknown")).alias("clock"))
    return shown(dates.to_unix_seconds(e, "clock", by="event_type").select("event_id", "event_type", "created_utc"), 3)


@query("date_range", "SELECT count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND epoch_us(ts) // 1000000 <= epoch_us(TIMESTAMP '2024-01-15') // 1000000")
def date_range(spark, sf):
    e = b.table(spark, sf, "events").withColumn("created_utc", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return clean.between_dates(e, "2024-01-08", "2024-01-15").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


URL_SQL = r"(?i)https?://[^\s\x0B\x1c-\x1f\x85\p{Z}]+|www\.[^\s\x0B\x1c-\x1f\x85\p{Z}]+"
MAIL_SQL = r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


@query("pii_strip", f"""WITH t AS (SELECT 'p' || page_id AS id, url AS author, html AS body FROM pages UNION ALL
  SELECT 'd' || doc_id, CASE WHEN doc_id % 5 = 0 THEN '[removed]' ELSE source END, text FROM documents),
s AS (SELECT id, author, body, regexp_replace(regexp_replace(body, '{URL_SQL}', '', 'g'), '{MAIL_SQL}', '', 'g') AS stripped FROM t)
SELECT id, CASE WHEN author IN ('', '[deleted]', '[removed]', 'None') THEN 'anonymous' ELSE substr(sha256(author || '{SALT}'), 1, 16) END AS author_hash,
       length(body) - length(stripped) AS removed_chars, sha256(stripped) AS body_hash FROM s""")
def pii_strip(spark, sf):
    p = b.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("author"), F.col("html").alias("selftext"))
    d = b.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("doc_id") % 5 == 0, "[removed]").otherwise(F.col("source")).alias("author"), F.col("text").alias("selftext"))
    t = clean.union_sources([p, d]).withColumn("_n", F.length("selftext"))
    s = clean.strip_personal_data(t, SALT)
    return shown(s.select("id", "author_hash", (F.col("_n") - F.length("selftext")).alias("removed_chars"), F.sha2("selftext", 256).alias("body_hash")))


@query("clean_text", "WITH " + b.DOCUMENTS + " SELECT post_id, length(clean_text) AS n_clean, sha256(clean_text) AS clean_hash FROM cleaned")
def clean_text(spark, sf):
    c = b.clean_documents(spark, sf)
    return shown(c.select("post_id", F.length("clean_text").alias("n_clean"), F.sha2("clean_text", 256).alias("clean_hash")))


@query("titled_posts", "WITH c AS (SELECT conv_id, turn, lower(trim(regexp_replace(CASE WHEN turn % 2 = 0 THEN role ELSE '' END, '" + b.SPACE + "', ' ', 'g'))) AS title, trim(regexp_replace(lower(regexp_replace(text, '" + URL_SQL + "', '', 'g')), '" + b.SPACE + """', ' ', 'g')) AS body FROM conversations
 WHERE text NOT IN ('[deleted]', '[removed]', ''))
SELECT conv_id, turn, sha256(CASE WHEN title <> '' AND body <> '' THEN title || '. ' || body ELSE title || body END) AS clean_hash FROM c
WHERE length(CASE WHEN title <> '' AND body <> '' THEN title || '. ' || body ELSE title || body END) >= 20""")
def titled_posts(spark, sf):
    c = b.table(spark, sf, "conversations")
    posts = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("title"), F.col("text").alias("selftext"))
    return clean.clean_posts(posts).select("conv_id", "turn", F.sha2("clean_text", 256).alias("clean_hash"))


@query("source_contract", "WITH " + ARCHIVE_SQL + """
SELECT author AS data_source, count(*) AS n_rows, round(avg(CASE WHEN try_cast(created_utc AS DOUBLE) IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS bad_clock_share,
       avg(CASE WHEN try_cast(created_utc AS DOUBLE) IS NULL THEN 1.0::DOUBLE ELSE 0 END) <= 0.10 AS compatible FROM archive GROUP BY author""")
def source_contract(spark, sf):
    return shown(clean.source_compatibility(_archive(spark, sf).withColumnRenamed("author", "data_source")))


@query("contract_violations", "WITH " + ARCHIVE_SQL + """
SELECT count(*) FILTER (WHERE trim(post_id) = '') AS blank_post_id, count(*) FILTER (WHERE try_cast(created_utc AS DOUBLE) IS NULL) AS bad_created_utc,
       count(*) FILTER (WHERE trim(community) = '') AS blank_community FROM archive""")
def contract_violations(spark, sf):
    return clean.contract_violations(_archive(spark, sf))


@query("dedupe_keep_first", """SELECT user_id, event_id, event_type, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def dedupe_keep_first(spark, sf):
    e = b.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return clean.keep_first(e, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("gap_fill_merge", """WITH a AS (SELECT o_orderkey AS post_id, o_totalprice AS score, 0 AS r FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT l_orderkey AS post_id, min(l_extendedprice) AS score, 1 AS r FROM lineitem GROUP BY l_orderkey), u AS (SELECT * FROM a UNION ALL SELECT * FROM f)
SELECT post_id, score FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY r) AS k FROM u) WHERE k = 1""")
def gap_fill_merge(spark, sf):
    primary = b.table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("post_id"), F.col("o_totalprice").alias("score"))
    fill = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("post_id")).agg(F.min("l_extendedprice").alias("score"))
    return clean.merge_with_fill(primary, fill)


@query("source_union", """SELECT data_source, count(*) AS row_count, CAST(sum(CASE WHEN score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS without_score FROM (
 SELECT 'orders' AS data_source, o_totalprice AS score FROM orders UNION ALL SELECT 'events', value FROM events UNION ALL SELECT 'documents', NULL FROM documents) GROUP BY data_source""")
def source_union(spark, sf):
    u = clean.union_sources([
        b.table(spark, sf, "orders").select(F.lit("orders").alias("data_source"), F.col("o_totalprice").alias("score")),
        b.table(spark, sf, "events").select(F.lit("events").alias("data_source"), F.col("value").alias("score")),
        b.table(spark, sf, "documents").select(F.lit("documents").alias("data_source")),
    ])
    return u.groupBy("data_source").agg(F.count("*").alias("row_count"), F.count_if(F.col("score").isNull()).alias("without_score"))


@query("ingest_counters", """SELECT o_orderstatus AS data_source, count(*) AS row_count, min(epoch_us(o_orderdate) // 1000000) AS min_created_utc,
 max(epoch_us(o_orderdate) // 1000000) AS max_created_utc FROM orders GROUP BY o_orderstatus""")
def ingest_counters(spark, sf):
    return clean.ingest_counters(b.order_posts(spark, sf))


@query("mixed_clocks", """SELECT event_type AS community, count(*) AS n, min(epoch_us(coalesce(a, u)) // 1000000) AS first_second, max(epoch_us(coalesce(a, u)) // 1000000) AS last_second
FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN ts END AS a, CASE WHEN event_id % 5 <> 0 THEN make_timestamp((epoch_us(ts) // 1000000) * 1000000) END AS u FROM events)
WHERE coalesce(a, u) IS NOT NULL GROUP BY event_type""")
def mixed_clocks(spark, sf):
    ts = F.col("ts").cast("timestamp")
    e = b.table(spark, sf, "events").select(
        F.col("event_type").alias("community"), F.when(F.col("event_id") % 2 == 0, ts).alias("created_utc_dt"),
        F.when(F.col("event_id") % 5 != 0, F.unix_timestamp(ts).cast("string")).otherwise("n/a").alias("created_utc"))
    return clean.resolve_clock(e).groupBy("community").agg(
        F.count("*").alias("n"), F.min(F.unix_timestamp("ts")).alias("first_second"), F.max(F.unix_timestamp("ts")).alias("last_second"))


@query("community_keys", """SELECT CASE lower(trim(' ' || o_orderpriority || ' ')) WHEN '1-urgent' THEN 'urgent' ELSE lower(trim(o_orderpriority)) END AS community, count(*) AS n FROM orders GROUP BY 1""")
def community_keys(spark, sf):
    c = clean.community_key(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")), {"1-URGENT": "urgent"})
    return b.table(spark, sf, "orders").groupBy(c.alias("community")).agg(F.count("*").alias("n"))


NAMES_SQL = """names AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'wrong_' || event_type || '.jsonl'
  ELSE 'arctic_shift_' || upper(event_type) || '_' || strftime(ts, '%Y%m') || '_' || '202402' || '.jsonl' END AS f FROM events)"""


@query("archive_names", "WITH " + NAMES_SQL + r""", p AS (SELECT nullif(lower(regexp_extract(f, '^arctic_shift_([A-Za-z0-9_]+)_(\d{6})_(\d{6})\.jsonl$', 1)), '') AS community,
  nullif(regexp_extract(f, '^arctic_shift_([A-Za-z0-9_]+)_(\d{6})_(\d{6})\.jsonl$', 2), '') AS first_month FROM names) SELECT community, first_month, count(*) AS n FROM p GROUP BY ALL""")
def archive_names(spark, sf):
    good = F.concat(F.lit("arctic_shift_"), F.upper("event_type"), F.lit("_"), F.date_format("ts", "yyyyMM"), F.lit("_202402.jsonl"))
    f = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("wrong_"), F.col("event_type"), F.lit(".jsonl"))).otherwise(good)
    e = b.table(spark, sf, "events").select(f.alias("f"))
    return e.select(files.archive_community(F.col("f")).alias("community"), files.archive_period(F.col("f"))[0].alias("first_month")).groupBy(
        "community", "first_month").agg(F.count("*").alias("n"))


@query("schema_resolution", """SELECT 'en' AS community, count(*) AS n, min(created_utc) AS lo, max(created_utc) AS hi, count(DISTINCT author) AS authors FROM (
  SELECT 1514764800 + doc_id * 60 AS created_utc, source AS author FROM documents WHERE lower(lang) = 'en')""")
def schema_resolution(spark, sf):
    d = b.table(spark, sf, "documents").select(
        F.upper("lang").alias("SubReddit"), F.col("text").alias("Body"), (F.lit(1514764800) + F.col("doc_id") * 60).alias("Timestamp"),
        F.col("source").alias("User"), F.col("doc_id").alias("Submission_ID"))
    p = files.normalize_posts(d, "en")
    return p.groupBy("community").agg(F.count("*").alias("n"), F.min("created_utc").alias("lo"), F.max("created_utc").alias("hi"), F.countDistinct("author").alias("authors"))


@query("provenance_upsert", "WITH " + b.POSTS + """
SELECT community, week_start, data_source AS source, max(ts) AS logged_at FROM posts GROUP BY ALL""")
def provenance_upsert(spark, sf):
    from tidewatch.operators.weekly import with_week

    p = with_week(b.order_posts(spark, sf)).select("community", "week_start", F.col("data_source").alias("source"), F.col("ts").cast("timestamp_ntz").alias("logged_at"))
    old, new = p.where(F.col("logged_at") < F.lit("1998-06-01").cast("timestamp_ntz")), p.where(F.col("logged_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return ledger.upsert(old, new, ["community", "week_start", "source"], "logged_at")


@query("brief_migration", """WITH o AS (SELECT doc_id AS k, 'old' AS origin FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id AS k, 'new' AS origin FROM documents)
SELECT k, origin FROM o UNION ALL SELECT k, origin FROM n WHERE k NOT IN (SELECT k FROM o)""")
def brief_migration(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("k"))
    old, new = d.where("k % 2 = 0").withColumn("origin", F.lit("old")), d.withColumn("origin", F.lit("new"))
    return ledger.insert_absent(old, new, ["k"])


@query("manifest_changes", """WITH m AS (SELECT doc_id, n_chars, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0),
 c AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents)
SELECT 'f' || doc_id AS path FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = c.doc_id AND m.n_chars = c.n_chars AND m.h = c.h)""")
def manifest_changes(spark, sf):
    d = b.table(spark, sf, "documents")
    path, size = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size_bytes")
    known = d.where("doc_id % 5 <> 0").select(path, size, F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return ledger.changed_files(d.select(path, size, F.sha2(changed, 256).alias("sha256")), known).select("path")


@query("ingestion_record", """SELECT lower(trim(o_orderpriority)) AS community, count(*) AS rows, min(epoch_us(o_orderdate) // 1000000) AS min_created_utc,
  max(epoch_us(o_orderdate) // 1000000) AS max_created_utc, 'ok' AS status FROM orders GROUP BY 1""")
def ingestion_record(spark, sf):
    return ledger.ingestion_record(b.order_posts(spark, sf))


@query("telemetry_rows", """SELECT o_orderpriority || ':' || o_orderstatus AS stage, CAST(count(*) AS BIGINT) AS rows_processed, round(sum(o_totalprice) / 1000.0, 2) AS elapsed_seconds FROM orders GROUP BY 1
UNION ALL SELECT 'events:' || event_type, NULL, CAST(count(*) AS DOUBLE) FROM events GROUP BY 1
UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT), round(sum(l_quantity), 2) FROM lineitem""")
def telemetry_rows(spark, sf):
    runs = b.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") / 1000.0, 2).alias("s"))
    runs = runs.groupBy("o_orderpriority").agg(F.collect_list(F.struct(
        F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("community"), F.col("s").alias("elapsed_seconds"), F.col("n").alias("rows_processed"))).alias("community_runs"))
    steps = b.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("s"))
    steps = steps.agg(F.collect_list(F.struct(F.concat(F.lit("events:"), "event_type").alias("stage"), F.col("s").alias("elapsed_seconds"))).alias("steps"))
    plain = b.table(spark, sf, "lineitem").agg(F.lit("lineitem").alias("stage"), F.round(F.sum("l_quantity"), 2).alias("elapsed_seconds"), F.count("*").alias("rows_processed"))
    profile = clean.union_sources([runs.select("community_runs"), steps, plain])
    return ledger.flatten_profile(profile)


REQUESTS = """requests AS (SELECT event_id AS request_id, event_type AS community, CASE WHEN event_id % 17 = 0 THEN 'someday' ELSE strftime(ts, '%Y-%m-%d') END AS week_start,
  event_id % 19 = 0 AS infinite, event_id % 23 = 0 AS short FROM events)"""


@query("request_validation", "WITH " + REQUESTS + """
SELECT request_id, CASE WHEN community NOT IN ('click', 'view', 'signup', 'error') THEN 'unknown_community' WHEN week_start = 'someday' THEN 'bad_date'
  WHEN infinite THEN 'non_finite_feature' WHEN short THEN 'missing_features' END AS skip_reason FROM requests""")
def request_validation(spark, sf):
    i = F.col("event_id")
    v = F.when(i % 19 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    full = F.create_map(F.lit("value"), v, F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    r = b.table(spark, sf, "events").select(
        i.alias("request_id"), F.col("event_type").alias("community"),
        F.when(i % 17 == 0, "someday").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("week_start"),
        F.when(i % 23 == 0, F.create_map(F.lit("value"), v)).otherwise(full).alias("features"))
    return serve.check_requests(r, ["click", "view", "signup", "error"], ["value", "k"]).select("request_id", "skip_reason")


@query("log_summary", """WITH l AS (SELECT event_type AS community, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 0.0 ELSE value / 20.0 END AS ens,
  value / 15.0 AS tab, CAST(json_extract(props, '$.k') AS INTEGER) > 50 AS has_drift FROM events),
f AS (SELECT community, CASE WHEN coalesce(nullif(ens, 0.0), nullif(tab, 0.0)) >= 0.5 THEN 1.0::DOUBLE ELSE 0 END AS e, CASE WHEN has_drift THEN 1.0::DOUBLE ELSE 0 END AS d FROM l)
SELECT coalesce(community, 'TOTAL') AS community, count(*) AS n_predictions, round(avg(e), 4) AS elevated_rate, round(avg(d), 4) AS drift_rate FROM f GROUP BY ROLLUP (community)""")
def log_summary(spark, sf):
    i = F.col("event_id")
    log = b.table(spark, sf, "events").select(
        F.col("event_type").alias("community"),
        F.when(i % 4 == 0, F.lit(None)).when(i % 9 == 0, F.lit(0.0)).otherwise(F.col("value") / 20.0).alias("ensemble_prob"),
        (F.col("value") / 15.0).alias("tabular_prob"), (F.from_json("props", "k int")["k"] > 50).alias("has_drift"))
    return shown(serve.log_summary(log))


@query("event_calendar", "WITH " + b.POSTS + """, span AS (SELECT community, min(week_start) AS a, max(week_start) AS z FROM posts GROUP BY community),
ev AS (SELECT 'event ' || event_id AS label, CAST(ts AS DATE) - INTERVAL 26 YEAR AS d, event_id FROM events WHERE event_id % 10 <> 0)
SELECT community, count(*) AS n_events FROM span JOIN ev ON d BETWEEN a AND z GROUP BY community""")
def event_calendar(spark, sf):
    i = F.col("event_id")
    when = F.date_format(F.add_months(F.col("ts").cast("date"), -12 * 26), "yyyy-MM-dd")
    e = b.table(spark, sf, "events").select(
        F.when(i % 20 == 0, " ").otherwise(F.concat(F.lit("event "), i.cast("string"))).alias("label"),
        F.when(i % 10 == 0, "some time").otherwise(when).alias("date"))
    from tidewatch.operators.weekly import with_week

    panel = with_week(b.order_posts(spark, sf))
    return decide.events_in_range(decide.valid_events(e), panel).groupBy("community").agg(F.count("*").alias("n_events"))


@query("name_slugs", """SELECT p_partkey, CASE WHEN s = '' THEN 'unknown_file' ELSE s END AS slug FROM (
  SELECT p_partkey, lower(regexp_replace(regexp_replace(p_brand || '  ' || p_name || '.csv', '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS s FROM part)""")
def name_slugs(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", text.slug(F.concat("p_brand", F.lit("  "), "p_name", F.lit(".csv"))).alias("slug"))
