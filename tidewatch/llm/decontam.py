"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

An item is cut into windows of ten consecutive words (a shorter item is one window).  The counts of the item words over
all documents rank the words of each window by rarity.  The index stores, for the few rarest words of every window,
one posting per place in the training texts: term, document, position and the words around it.  A window starts
where the list of its rarest word, moved back by that word's place in the window, meets the moved lists of the next
rarest words; what is left is compared word for word with the stored neighbourhood.

Frequent words are never in a window's lists unless all its words are frequent, and lists meet on (document, start),
so a word or passage that a third of the documents share is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import ascii_lower, fits, small_side, split_words, stored

#: Characters between words: ASCII but for digits and (after lower-casing) letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists that are intersected for a window, rarest first; the words beyond are compared in place.
LISTS = 2
#: Words of a window that may be lacking where it is near, per hundred: one of ten.
LACKING = 10


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), GAPS)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and words: rows that repeat an id with another text, or have none, stay apart by the key."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, words) and which items hold them (window, item_id).

    Windows are known by the SHA-256 of their words.  Items of null or blank text have none.
    """
    words = items.select(F.col("item_id").cast("string"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    held = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    held = held.select("item_id", "words", F.sha2(F.array_join("words", " "), 256).alias("window"))
    held = stored(held.distinct(), "windows")
    return held.groupBy("window").agg(F.first("words").alias("words")), held.select("window", "item_id").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n: its places in all of ``docs``, for the given terms only."""
    places = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return places.join(small_side(terms, 64), "term").groupBy("term").agg(F.count("*").alias("n"))


def rare_terms(wins: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """window, size, rank (1: rarest), ranks (distinct words), term and place (0-based, the first one in the window).

    Windows with a word that no document has are left out: they occur nowhere.
    """
    each = wins.select("window", F.size("words").alias("size"), F.posexplode("words").alias("place", "term"))
    each = each.groupBy("window", "size", "term").agg(F.min("place").alias("place")).join(counts, "term", "left")
    over = Window.partitionBy("window")
    each = each.withColumn("rank", F.row_number().over(over.orderBy(F.col("n").asc_nulls_first(), "term")))
    each = each.withColumn("ranks", F.count("*").over(over)).withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(over))
    return each.where((F.col("rank") <= lists) & (F.col("least") > 0)).select("window", "size", "rank", "ranks", "term", "place")


def postings(docs: DataFrame, terms: DataFrame, reach: int = WINDOW) -> DataFrame:
    """The index: term, doc_id, key, pos and, for terms marked ``near``, the words from ``reach`` - 1 before to after.

    ``terms`` has term and near.  ``left`` is the number of words before pos in ``around``.
    """
    words = keyed(docs)
    left = F.least(F.col("pos"), F.lit(reach - 1))
    around = F.slice("words", F.col("pos") - left + 1, left + reach)
    if fits(terms, 64):  # the words stay in the row that is being exploded and are sliced for its hits only
        each = words.select("doc_id", "key", "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(terms), "term")
        return each.select("term", "doc_id", "key", "pos", left.alias("left"), F.when(F.col("near"), around).alias("around"))
    bare = stored(words.select("doc_id", "key", F.posexplode("words").alias("pos", "term")).join(terms, "term"), "bare-postings")
    near = bare.where("near").groupBy("doc_id", "key").agg(F.collect_set(F.struct("pos", "term")).alias("at"))
    near = near.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "at")
    near = words.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "words", F.explode("at").alias("p"))
    near = near.select("p.term", "doc_id", "key", "p.pos", "words").select("term", "doc_id", "key", "pos", left.alias("left"), around.alias("around"))
    return bare.where("NOT near").select("term", "doc_id", "key", "pos", left.alias("left"), F.lit(None).cast("array<string>").alias("around")).union(near)


def phrase_matches(index: DataFrame, wins: DataFrame, rare: DataFrame, lists: int = LISTS) -> DataFrame:
    """Exact places of windows: doc_id, key, window, start and size.

    Starts where the moved lists of the rarest words agree, then where all words do.
    """
    first = rare.where("rank = 1").join(wins, "window").select("term", "window", "size", "ranks", "place", "words")
    here = F.col("left") - F.col("place") + 1  # where the window would begin in the neighbourhood, from 1
    found = index.where("around IS NOT NULL").join(first, "term").where(here >= 1)
    found = found.select("doc_id", "key", "window", "size", "ranks", (F.col("pos") - F.col("place")).alias("start"), "words", F.slice("around", F.greatest(here, F.lit(1)), F.col("size")).alias("there"))
    for k in range(2, lists + 1):
        wanted = rare.where(F.col("rank") == k).select("window", F.col("term").alias("t"), F.col("place").alias("p"))
        places = index.select("term", F.col("doc_id").alias("d"), F.col("key").alias("k"), "pos")
        on = (F.col("t") == F.col("term")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("start") + F.col("p") == F.col("pos"))
        met = found.where(F.col("ranks") >= k).join(wanted, "window").join(places, on, "left_semi").drop("t", "p")
        found = met.unionByName(found.where(F.col("ranks") < k))
    return found.where(F.col("there") == F.col("words")).select("doc_id", "key", "window", "start", "size")


def proximity_matches(index: DataFrame, rare: DataFrame, within: int = WINDOW) -> DataFrame:
    """Windows whose listed rarest words all lie within ``within`` consecutive words of a text, in any order.

    doc_id, key, window and the first position of a place that holds them all.  Places of a document are walked in
    order with the last position of each word, so a frequent word costs its places, not pairs of them.
    """
    places = index.select("term", "doc_id", "key", "pos").join(rare.select("term", "window", "rank"), "term")
    lists = rare.groupBy("window").agg(F.count("*").alias("lists"))
    over = Window.partitionBy("doc_id", "key", "window").orderBy("pos").rangeBetween(0, within - 1)
    met = places.withColumn("met", F.size(F.collect_set("rank").over(over))).join(lists, "window").where("met = lists")
    return met.groupBy("doc_id", "key", "window").agg(F.min("pos").alias("pos"))


def near_matches(docs: DataFrame, wins: DataFrame, size: int = WINDOW, lacking: int = LACKING) -> DataFrame:
    """Windows near a place of a text: doc_id, key and window.

    A run of consecutive words, longer than the window by what may lack, holds all but that of the window's distinct
    words in any order.  Of the rarest words of a window, one more than may lack, one must be there: their places are
    looked up in the index, and all words of the window are counted in the neighbourhood stored with each.
    """
    lack = lambda n: F.floor(n * lacking / 100).cast("int")
    reach = size + size * lacking // 100
    words = wins.select("window", F.size("words").alias("size"), F.array_distinct("words").alias("words"))
    words = words.withColumn("may", lack(F.size("words"))).withColumn("span", F.col("size") + F.col("may")).withColumn("need", F.size("words") - F.col("may"))
    each = words.select("window", "may", F.explode("words").alias("term"))
    terms = stored(each.select("term").distinct(), "near-words")
    counts = stored(term_counts(docs, terms), "near-counts")
    over = Window.partitionBy("window").orderBy(F.col("n").asc_nulls_first(), "term")
    rare = each.join(counts, "term", "left").withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= F.col("may") + 1)
    rare = stored(rare.where(F.col("n").isNotNull()).select("term", "window"), "near-rare")
    wanted = stored(rare.select("term").distinct().withColumn("near", F.lit(True)), "near-terms")
    index = stored(postings(docs, wanted, reach), "near-postings")
    wanted_words = stored(rare.join(words, "window").select("term", "window", "words", "span", "need"), "near-windows")
    found = index.where("around IS NOT NULL").join(small_side(wanted_words, 512), "term")
    held = lambda there: F.size(F.array_intersect(there, F.col("words"))) >= F.col("need")
    found = found.where(held(F.col("around")))
    starts = F.sequence(F.greatest(F.lit(1), F.col("left") + 2 - F.col("span")), F.col("left") + 1)
    found = found.where(F.exists(starts, lambda i: held(F.slice("around", i, F.col("span")))))
    return found.select("doc_id", "key", "window").distinct()


def proximity(docs: DataFrame, items: DataFrame, size: int = WINDOW, lacking: int = LACKING) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_near (windows near a place of the text), n_near_items, near_items_sha256
    and near.

    Exact places are near as well; so are reordered windows and those of which few words were changed, left out or put
    in (see ``near_matches``).  Null, blank and repeated rows and null ids are treated as in ``contamination``.
    """
    wins, holders = windows(items, size)
    found = stored(near_matches(docs, stored(wins, "window-words"), size, lacking), "near-matches")
    listed = found.join(holders, "window").groupBy("doc_id", "key").agg(
        F.count_distinct("window").alias("n_near"), F.array_sort(F.collect_set("item_id")).alias("items"))
    report = listed.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_near", "items")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"))
    out = rows.join(report, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    n_near, items_of = F.coalesce("n_near", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", n_near.alias("n_near"), F.size(items_of).cast("long").alias("n_near_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("near_items_sha256"), (n_near > 0).alias("near"),
    )


def build_index(docs: DataFrame, wins: DataFrame, lists: int = LISTS, reach: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The stored postings of the rarest words of ``wins``, and the ranking (see ``rare_terms``)."""
    terms = stored(wins.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = stored(term_counts(docs, terms), "term-counts")
    rare = stored(rare_terms(wins, counts, lists), "rare-terms")
    wanted = stored(rare.groupBy("term").agg(F.bool_or(F.col("rank") == 1).alias("near")), "index-terms")
    return stored(postings(docs, wanted, reach), "postings"), rare


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, lists: int = LISTS) -> tuple[DataFrame, DataFrame]:
    """Exact window places in ``docs`` (doc_id, key, window, start, size), and the items of each window."""
    wins, holders = windows(items, size)
    wins = stored(wins, "window-words")
    index, rare = build_index(docs, wins, lists, size)
    return stored(phrase_matches(index, wins, rare, lists).distinct(), "phrase-matches"), holders


def _covered(spans: Column) -> Column:
    """Places inside any of the (start, end) spans, which come sorted."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, x: F.struct(
        (acc.n + F.greatest(x.end - F.greatest(x.start, acc.upto), F.lit(0))).alias("n"), F.greatest(acc.upto, x.end).alias("upto"))
    return F.aggregate(spans, begin, step, lambda acc: acc.n)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    Words inside an occurrence of a window are hit, once each.  Null and blank texts have no words.  Repeated rows get
    equal rows; a null doc_id is one more id, a null item_id hits but is not listed.  Without items all are clean.
    """
    found, holders = matches(docs, items, size, lists)
    spans = found.groupBy("doc_id", "key", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    hits = spans.groupBy("doc_id", "key").agg(_covered(F.array_sort(F.collect_list(F.struct("start", "end")))).alias("n_hit"))
    listed = found.select("doc_id", "key", "window").distinct().join(holders, "window").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    report = hits.join(listed, [hits.doc_id.eqNullSafe(listed.doc_id), hits.key == listed.key]).select(hits.doc_id.alias("d"), hits.key.alias("k"), "n_hit", "items")
    sizes = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = sizes.join(report, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an occurrence of a window, all columns kept."""
    found, _ = matches(docs, items)
    hit = found.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    return docs.join(hit, docs.doc_id.cast("long").eqNullSafe(hit._d) & (F.xxhash64(docs.text) == hit._k), "left_anti")
