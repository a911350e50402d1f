"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import decontam, importance, kdshards, licenses, line_templates, merkle, pieces, quality_rules, simhash, toxicity, warc, whitening, wordpiece
from tidewatch.llm.common import LOWER, UPPER

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_conditional_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.to_json("found").alias("places"),
    )


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(table(spark, sf_dir, "documents"))


SQL2 = r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, text FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line, list_filter(regexp_split_to_array(
        regexp_replace(string_split(text, chr(10))[i], '(^|[\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '\1<*>', 'g'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS tok FROM l),
f AS (SELECT tok, len(tok) AS n, tok[1:3] AS head, count(DISTINCT doc_id) AS docs FROM t WHERE len(tok) >= 3 GROUP BY tok),
need AS (SELECT *, CASE WHEN n >= 20 THEN 2 ELSE 8 END AS need FROM f),
p AS (SELECT *, unnest(range(1, n + 1)) AS place FROM need),
s AS (SELECT n, head, place, tok[place] AS token, sum(docs) AS support FROM p GROUP BY ALL),
m AS (SELECT p.tok, string_agg(CASE WHEN support >= need THEN tok[p.place] ELSE '<*>' END, ' ' ORDER BY p.place) AS blanked,
             sum(CASE WHEN support >= need THEN 1 ELSE 0 END) AS firm
      FROM p JOIN s ON s.n = p.n AND s.head = p.head AND s.place = p.place AND s.token = p.tok[p.place] GROUP BY p.tok),
lt AS (SELECT t.doc_id, t.i, len(t.tok) AS n, CASE WHEN firm * 10 >= len(t.tok) * 7 THEN blanked ELSE array_to_string(t.tok, ' ') END AS template
       FROM t JOIN m ON m.tok = t.tok),
r AS (SELECT template, min(doc_id) AS first FROM lt GROUP BY template, n HAVING count(DISTINCT doc_id) >= CASE WHEN n >= 20 THEN 2 ELSE 8 END),
gone AS (SELECT lt.doc_id, lt.i FROM lt JOIN r USING (template) WHERE lt.doc_id <> r.first),
b AS (SELECT t.doc_id, count(*) FILTER (len(t.tok) > 0) AS n_lines, count(gone.i) AS n_dropped,
             coalesce(string_agg(t.line, chr(10) ORDER BY t.i) FILTER (gone.i IS NULL), '') AS text
      FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, b.text FROM documents d LEFT JOIN b USING (doc_id)
"""


def op3_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


SQL3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(lines) AS n_lines,
      len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))}))) AS n_stop_words,
      len(list_filter(w, lambda x: regexp_matches(x, '[A-Z][A-Z]'))) AS n_capitals FROM d LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',',
      CASE WHEN word_chars * 100 < n_words * 200 OR word_chars * 100 > n_words * 1200 THEN 'word_length' END,
      CASE WHEN n_symbols * 100 > n_words * 10 THEN 'symbols' END, CASE WHEN n_capitals * 100 > n_words * 30 THEN 'capitals' END,
      CASE WHEN n_stop_words * 100 < n_words * 8 THEN 'stop_words' END, CASE WHEN n_dup_lines * 100 > n_lines * 40 THEN 'repeated_lines' END) AS broken_rules FROM c)
SELECT *, NOT base_failed AND broken_rules = '' AS kept FROM v
"""


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS7 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL7 = f"""
WITH d AS (SELECT doc_id, {_WORDS7} AS w FROM documents),
b AS (SELECT item_id, {_WORDS7} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM starts),
place AS (SELECT d.doc_id, d.w, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS p FROM d, (SELECT DISTINCT size FROM win) s WHERE len(d.w) >= s.size),
m AS (SELECT place.doc_id, place.p, win.size, win.item_id FROM place JOIN win
      ON win.size = place.size AND win.gram = array_to_string(place.w[place.p:place.p + place.size - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def op4_wordpiece_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.piece_counts(table(spark, sf_dir, "documents"))


def op5_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload, octet_length(encode(payload)) AS n, array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, k * 5 + 1, 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest,
        max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM d
"""


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws the share of the rows that the labels call good."""
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)")
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    return importance.resampled(table(spark, sf_dir, "documents"), labels.where("quality = 1"), share=share)


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return coded.select(
        "doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.hex(F.xxhash64("piece_ids")).alias("pieces_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op11_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen leaves of near equal bytes."""
    placed = kdshards.shards(table(spark, sf_dir, "documents"), leaves=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, seen={"text": merkle.tampered(F.col("text"), F.col("doc_id"))}).drop("seen")


def _sql13() -> str:
    """The tree level by level; a group or table that is down to one node keeps it."""
    def enc(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    low = f"CASE WHEN crc % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    fields = [enc(c) for c in ("doc_id", "source", "lang", "n_chars")]
    crc = ("xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')], lambda c, b: "
           "list_reduce([xor(c, b)] || repeat([CAST(0 AS BIGINT)], 8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)")
    parts = [f"d AS (SELECT *, {crc} AS crc FROM documents)",
             f"v AS (SELECT doc_id, source, sha256(concat({', '.join(fields)}, {enc('text')})) AS leaf, sha256(concat({', '.join(fields)}, {enc('(' + low + ')')})) AS seen FROM d)",
             "f0 AS (SELECT *, leaf AS digest, seen AS now, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, seen) - 1 AS p FROM v)"]

    def climb(name: str, group: str, levels: int) -> str:
        """``levels`` times: nodes of a level (one row each), their runs, and every document's fold through its run."""
        for k in range(levels):
            parts.append(f"{name}n{k} AS (SELECT DISTINCT {group}, p, digest FROM {name}{k})")
            parts.append(f"{name}r{k} AS (SELECT {group}, r, run, sum(held) OVER (PARTITION BY {group}) AS nodes FROM (SELECT {group}, p // 16 AS r, string_agg(digest, '' ORDER BY p) AS run, count(*) AS held FROM {name}n{k} GROUP BY ALL))")
            left, right = "left(run, 64 * (p % 16))", "substr(run, 64 * (p % 16) + 65)"
            parts.append(f"{name}{k + 1} AS (SELECT x.* EXCLUDE (digest, now, proof, p), CASE WHEN nodes > 1 THEN sha256(run) ELSE digest END AS digest, CASE WHEN nodes > 1 THEN sha256({left} || now || {right}) ELSE now END AS now, "
                         f"CASE WHEN nodes > 1 THEN proof || {left} || {right} ELSE proof END AS proof, p // 16 AS p FROM {name}{k} x JOIN {name}r{k} y ON x.{group} IS NOT DISTINCT FROM y.{group} AND x.p // 16 = y.r)")
        return f"{name}{levels}"

    last = climb("f", "source", 6)
    parts.append(f"t0 AS (SELECT * EXCLUDE (p), digest AS subroot, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS p, 1 AS every FROM {last})")
    last = climb("t", "every", 4)
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = digest AS verified FROM {last}"


QUERIES: dict[str, Query] = {
    "op1_conditional_compression": op1_conditional_compression,
    "op2_line_templates": op2_line_templates,
    "op3_rule_table": op3_rule_table,
    "op4_wordpiece_lengths": op4_wordpiece_lengths,
    "op5_indexed_warc": op5_indexed_warc,
    "op6_ordinal_toxicity": op6_ordinal_toxicity,
    "op7_positional_index": op7_positional_index,
    "op7_proximity": op7_proximity,
    "op8_simhash": op8_simhash,
    "op9_sampled_pieces": op9_sampled_pieces,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_jacobi_davidson": op11_jacobi_davidson,
    "op12_kd_shards": op12_kd_shards,
    "op13_butterfly_manifest": op13_butterfly_manifest,
}
ORACLE: dict[str, str] = {"op2_line_templates": SQL2, "op3_rule_table": SQL3, "op5_indexed_warc": SQL5, "op7_positional_index": SQL7, "op13_butterfly_manifest": _sql13()}
