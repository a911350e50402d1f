"""The corpus pipeline: documents through four filters and a tokeniser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import decontam, line_templates, pieces, simhash, toxicity
from tidewatch.llm.common import stored


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores until no column has it, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is low; the model is fitted on the labelled ones of ``docs``.

    Null, empty and wordless texts have severity 0 and stay; very long texts are scored whole, repeated rows alike.
    An empty table, or one without labels of both kinds, loses nothing.  All columns are kept.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that recur; n_chars follows the text.

    A document that loses all lines stays with an empty text, a null text stays null, and so does its n_chars.  A line
    recurs by documents, so repeated rows of one doc_id count once.  An empty table stays empty; other columns are kept.
    """
    return line_templates.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Texts without a word (null, empty) are a group of their own; very long texts are taken whole; of rows that share
    the smallest doc_id one stays.  An empty table stays empty; all columns are kept.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay, repeated rows go or stay alike, very long texts are searched whole; an
    empty table, or an empty benchmark, loses nothing.  All columns are kept.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids; ``text`` is what they decode to, which is the text before.

    A null text stays null, with null ids; an empty one has no ids.  The ids are in ``piece_ids``; where the table has
    such a column, that is kept and the new one has underscores after its name.
    """
    ids = free_name("piece_ids", docs.columns)
    back = free_name("decoded", [*docs.columns, ids])
    coded = pieces.decode(pieces.encode(docs, into=ids), into=back, ids=ids)
    return coded.select(*[F.col(f"`{back}`").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], ids)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode_decode),
]
ORACLE_SQL = None  # the fit of the first stage has no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after every stage; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
