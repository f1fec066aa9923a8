"""A corpus pipeline over the documents table: STAGES in order, each on what the one before
it kept. run() applies them to the whole table; each stage is written and read again in between.

All but the last stage return COLUMNS of their rows, whatever others there are. An empty table gives an
empty result in each. Rows that repeat are taken one by one, and long texts whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, near_dups, packing, toxicity
from graphloom.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels teach by the rows that op3 learns from. Null and empty
    texts have the score of the intercept; a null doc_id has no label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fit(docs, labels), "__score")
    return scored.filter("__score < 0.5").drop("__score")


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines stay in one document; n_chars follows the text. Documents that
    lost all their text, and only those, go. A null text comes back as the empty one; rows with a
    null doc_id lose no line."""
    rows = docs.select(*COLUMNS)
    kept = line_dedup.dedup(rows, line_dedup.LineIndex.of(rows))
    kept = kept.filter((F.col("n_dropped") == 0) | (F.trim(F.col("text")) != ""))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8): that of the
    smallest doc_id, with all its rows. Texts without words, and rows with a null doc_id, stay."""
    kept = near_dups.components(docs, width=5).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their targets, a row for each copy; packing needs no order.
    Null and empty texts have size 0, a null source is one of its own, ties go by hash."""
    return mixing.mix(docs.select(*COLUMNS), ordered=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 ids; a null or empty text is its closing id alone."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("line dedup", repeated_lines_out), ("near dedup", near_copies_out), ("mixing", mixed), ("packing", packed)]

#: Model scores and tokens are beyond SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
