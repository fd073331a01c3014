"""From raw documents to packed training sequences, stage by stage.

Each stage gets what the one before it kept, read from Parquet.  All stages but
the last keep all columns, whatever their names, and give no rows for an empty
table.  Texts of any length are read whole.  Rows with null id or text, and
empty texts, stay unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import linededup, mixing, packing, simhash, toxicity
from tidemill.llm.common import fresh, scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; rows of one id and text stay or go together."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing but white space is left go.

    n_chars follows the text.  Documents of less than three lines, and rows with
    the same id and text, which are one document, keep what they have.
    """
    (removed,) = fresh(docs, "_removed")
    out = linededup.drop_repeated_lines(docs, removed)
    out = out.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return out.select(*[F.when(F.col(removed) > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Rows without id, text or words are in no group; rows of one id stay or go together.
    """
    return simhash.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of each source as its target weight says, ``mixing.SHARE`` of all tokens.

    A null source is one of its own; rows of one source, id and text stay or go together.
    """
    return mixing.keep_mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token run of each document goes: (bin_id, doc_id, part, first_token, n_tokens, bin_offset).

    Texts without tokens have no row; null ids and repeated rows are packed like others.
    """
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("simhash", near), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what the stages before the last keep is written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            where = scratch(spark, name)
            docs.write.parquet(where)
            docs = spark.read.parquet(where)
    return docs


#: A trained classifier and a greedy plan have no SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None
