"""Helpers shared by the corpus operators: words, scratch tables and fixed hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, partitions

__all__ = ["GAP", "SPACE", "WORD", "fair_join", "materialize", "mix64", "partitions", "text_batches", "type_of"]

#: The six ASCII white-space characters that separate words and are stripped from lines.
SPACE = " \t\n\x0b\x0c\r"
#: As Java and RE2 character classes: a word, and what separates words.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 500


def text_batches(spark: SparkSession) -> None:
    """Have whole texts go to Python in batches of TEXT_ROWS: with the session's default of
    10,000, buffers for one batch of long documents fill a worker's memory. The setting stays
    for the session, as plans read it when they run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def fair_join(rows: DataFrame, few: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """rows joined with few by keys, where few has a bounded number of rows for each. Keys that
    more than a fair share of the rows hold (2 * partitions of them at most) meet theirs by broadcast, the
    others by a shuffle, so no task gets the rows of a hot key. Both must be cheap to read again."""
    counts = materialize(rows.groupBy(*keys).agg(F.count("*").alias("__n")))
    fair = (counts.agg(F.sum("__n")).first()[0] or 0) // (2 * partitions(rows.sparkSession))
    names = list(keys)
    hot = counts.filter(F.col("__n") > fair + 64).select(*names)
    if hot.isEmpty():
        return rows.join(few, names, how)
    hot = F.broadcast(hot)
    warm = rows.join(hot, names, "left_semi").join(F.broadcast(few.join(hot, names, "left_semi")), names, how)
    return warm.unionByName(rows.join(hot, names, "left_anti").join(few, names, how))
