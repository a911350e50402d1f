"""Line de-duplication by a log-template tree, with DataFrame functions only.

A line is a row of tokens; a token with a digit is a variable field from the start.  The tree has a fixed depth: the
first level is the number of tokens, the next ones the leading tokens, and what is left is a leaf.  Within a leaf a
token is constant at its place if enough documents of the leaf have it there, else it is a field.  A line whose share
of constant tokens is high enough becomes the template with its fields blanked; any other line stays its own template.
A template found in enough documents recurs: it is kept in the first of them and dropped from all others.

Only narrow rows (ids, counts, positions) are shuffled until the end, where the texts meet their dropped positions.
A line or leaf that very many documents share is counted by partial sums and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import SPACES, small_side, stored

FIELD = "<*>"
#: White space, inside a character class.
WIDE = r"\x20\x09-\x0D"
#: Tokens of a line below which it is left alone (headings, rulers, single words).
MIN_TOKENS = 3
#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Share of constant tokens, in tenths, from which a line follows a template.
LIKE_TENTHS = 7
#: Documents from which a template recurs: a long line may not even come twice, a short one comes up by chance.
LONG_TOKENS, LONG_DOCS, SHORT_DOCS = 20, 2, 8


def needed(n: Column) -> Column:
    return F.when(n >= LONG_TOKENS, LONG_DOCS).otherwise(SHORT_DOCS)


def tokens_of(line: Column) -> Column:
    """Tokens with numbers masked; a blank line gives one empty token."""
    masked = F.regexp_replace(line, rf"(^|[{WIDE}])[^{WIDE}0-9]*+[0-9][^{WIDE}]*+", rf"$1{FIELD}")
    return F.split(F.trim(F.when(line.rlike("[0-9]"), masked).otherwise(line), F.lit(" \t\n\x0b\x0c\r")), SPACES)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), "text")


def line_ids(docs: DataFrame) -> DataFrame:
    """doc, key, pos, n, leaf and form (MD5 of the masked tokens) of every line with enough tokens."""
    each = keyed(docs).select(F.col("_id").alias("doc"), F.col("_key").alias("key"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    # Told by the first tokens alone: a filter on their number would cut every line twice.
    enough = rf"^[{WIDE}]*+(?:[^{WIDE}]++[{WIDE}]++){{{MIN_TOKENS - 1}}}[^{WIDE}]"
    each = each.where(F.col("line").rlike(enough)).select("doc", "key", "pos", tokens_of(F.col("line")).alias("t"))
    leaf = F.xxhash64(F.size("t"), F.array_join(F.slice("t", 1, DEPTH), " "))
    return each.select("doc", "key", "pos", F.size("t").alias("n"), leaf.alias("leaf"), F.unhex(F.md5(F.array_join("t", " "))).alias("form"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def template_lines(docs: DataFrame) -> DataFrame:
    """doc, key, pos, n and template of each line that may recur: its form is found again, or its leaf holds others."""
    lines = stored(line_ids(docs), "lines")
    forms = lines.groupBy("form").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.count("*").alias("c"), F.min(F.struct("doc", "key", "pos")).alias("at"))
    forms = stored(forms, "line-forms")
    leaves = forms.groupBy("leaf").agg(F.count("*").alias("forms"), F.sum("c").alias("all"), F.first("n").alias("n"))
    shared = stored(leaves.where((F.col("forms") > 1) & (F.col("all") >= needed(F.col("n")))).select("leaf"), "shared-leaves")
    mixed = stored(forms.join(small_side(shared, 16), "leaf", "left_semi"), "mixed-forms")
    again = forms.where((F.col("c") >= needed(F.col("n")))).select("form")
    live = stored(again.union(mixed.select("form")).distinct(), "live-forms")
    lines = stored(lines.join(small_side(live, 48), "form", "left_semi"), "live-lines")

    # a line of each form of a mixed leaf, fetched by its place
    docs_of = lines.groupBy("form", "doc", "key").agg(F.lit(1)).groupBy("form").agg(F.count("*").alias("docs"))
    places = stored(mixed.groupBy(F.col("at.doc").alias("d"), F.col("at.key").alias("k")).agg(F.collect_list(F.struct("form", "leaf", "n", "at.pos")).alias("places")), "form-places")
    texts = keyed(docs).select("_id", "_key", "text").join(small_side(places, 256), _same("_id", "d") & (F.col("_key") == F.col("k")))
    texts = texts.select(text_lines(F.col("text")).alias("lines"), F.explode("places").alias("p"))
    texts = texts.select("p.form", "p.leaf", "p.n", tokens_of(F.element_at("lines", F.col("p.pos") + 1)).alias("t")).dropDuplicates(["form"])
    tokens = stored(texts.join(docs_of, "form").select("form", "leaf", "n", "docs", F.posexplode("t").alias("place", "token")), "form-tokens")
    support = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support"))
    tokens = tokens.join(support, ["leaf", "place", "token"]).withColumn("firm", F.col("support") >= needed(F.col("n")))
    blanked = F.struct("place", F.when(F.col("firm"), F.col("token")).otherwise(FIELD).alias("token"))
    named = tokens.groupBy("form", "n").agg(F.sum(F.col("firm").cast("int")).alias("firm"), F.array_sort(F.collect_list(blanked)).alias("t"))
    named = named.where(F.col("firm") * 10 >= F.col("n") * LIKE_TENTHS)
    named = stored(named.select("form", F.unhex(F.md5(F.array_join("t.token", " "))).alias("template")), "form-templates")
    out = lines.join(small_side(named, 96), "form", "left")
    return stored(out.select("doc", "key", "pos", "n", F.coalesce("template", "form").alias("template")), "template-lines")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """d, k and positions (0-based) of the lines that go, one row per document that loses any."""
    lines = template_lines(docs)
    each = lines.groupBy("template", "n", "doc", "key").agg(F.lit(1))
    recurring = each.groupBy("template", "n").agg(F.count("*").alias("docs"), F.min(F.struct("doc", "key")).alias("first"))
    recurring = stored(recurring.where(F.col("docs") >= needed(F.col("n"))).select("template", "first.doc", "first.key"), "recurring")
    recurring = recurring.select("template", F.col("doc").alias("fd"), F.col("key").alias("fk"))
    gone = lines.join(small_side(recurring, 64), "template").where(~(_same("doc", "fd") & (F.col("key") == F.col("fk"))))
    return stored(gone.groupBy(F.col("doc").alias("d"), F.col("key").alias("k")).agg(F.collect_set("pos").alias("positions")), "dropped")


def _applied(docs: DataFrame) -> DataFrame:
    """row (the columns of ``docs``, text without its dropped lines), n_lines and n_dropped."""
    gone = dropped_lines(docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"))
    rows = rows.join(gone, _same("_id", "d") & (F.col("_key") == F.col("k")), "left")
    rows = rows.select("row", "positions", text_lines(F.col("row.text")).alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.array_join(F.transform(F.array_except(every, F.col("positions")), lambda i: F.element_at("lines", i + 1)), "\n")
    lost = F.col("positions").isNotNull()
    return rows.select(
        F.when(lost, F.col("row").withField("text", kept)).otherwise(F.col("row")).alias("row"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"),
        F.when(lost, F.size("positions")).otherwise(0).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``.

    Every row and column stays; a text that loses all lines becomes empty, a null text stays null, empty ones stay
    empty.  The first document of a template is the one with the least doc_id (a null one comes first); rows that
    repeat both id and text are one document and are treated alike.  Repeats within a document are left.  An empty
    table gives no rows.
    """
    return _applied(docs).select("row.*")


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (lines with a token), n_dropped and the text that is left, by the rules of ``dedup_lines``."""
    return _applied(docs).select("row.doc_id", "n_lines", "n_dropped", "row.text")
