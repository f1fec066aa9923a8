"""Exact top-k by inner product with a vector-approximation file.

Rows are kept as whole-number vectors. The approximation file is a table of its own: every component is
put into one of 2^BITS cells between the smallest and the largest value of its dimension, a byte
each, and BLOCK rows at most make one record. Only the file is scanned for all queries: from the cells
come a lower and an upper bound of each inner product, and a row is a candidate for a query if
its upper bound reaches the k-th largest lower bound. Exact vectors are read by candidates alone,
first those with the k largest bounds of each query, then those whose bound still reaches
the k-th exact score; after that the k-th result is certain. Nothing is approximate in the result.

Queries are never collected: distinct query vectors make blocks of QUERIES, and each record of the file
meets each block of queries once, in a join by block number (dealt out further where there are
few blocks). Of equal vectors only the k + 1 rows of the smallest ids can be in a result, and equal queries are
searched once, so a vector that a third of all rows hold is neither one task's nor a square of pairs.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows
with a null id, take no part; shorter vectors count as filled up with zeros; rows that share
the query's id are its own; other repeated rows are candidates each; queries are taken once
an id and vector; ties go to the smaller id; ids may have any type that can be ordered; components
so large that a score might not fit a long are a ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fair_join, materialize, partitions

BITS = 6
BLOCK, QUERIES = 4096, 512
_EXACT = 1 << 53


def scaled(rows: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """id, v: floor(factor * component) of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.expr("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    rows = rows.select(F.col(id_col).alias("id"), v.alias("v")).filter(whole)
    return rows.select("id", F.transform("v", lambda x: F.floor(x * factor)).alias("v"))


def matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


class Grid:
    """The cells of each dimension: from low on, of width step."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        self.low, self.step = low, np.maximum(1, -(-(high - low + 1) // (1 << bits)))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.step).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x rows) of the inner products. Whole numbers: below
        2^53 double precision has them exactly, else they stay integers."""
        down = self.low + cells.astype(np.int64) * self.step
        up = down + self.step - 1
        reach = int(np.abs(queries).max(initial=0)) * int(max(np.abs(down).max(initial=0), np.abs(up).max(initial=0))) * max(1, queries.shape[1])
        kind = np.float64 if 2 * reach < _EXACT else np.int64
        plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        down, up = down.T.astype(kind), up.T.astype(kind)
        low = plus @ down + minus @ up
        return low.astype(np.int64), (low if (self.step == 1).all() else plus @ up + minus @ down).astype(np.int64)


def _packed(rows: DataFrame, dims: int, size: int, grid: Grid | None = None) -> DataFrame:
    """keys, data: records of `size` rows (n, v) at most; data holds cells or, without a grid, vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), size):
                part = pdf.iloc[s : s + size]
                m = matrix(part["v"].to_numpy(), dims)
                yield pd.DataFrame({"keys": [part["n"].to_numpy()], "data": [(m if grid is None else grid.cells(m)).tobytes()]})

    return rows.select("n", "v").mapInPandas(run, "keys array<long>, data binary")


def candidates(file: DataFrame, asked: DataFrame, grid: Grid, dims: int, k: int) -> DataFrame:
    """q, n, low, up: for each query the rows of the file whose upper bound reaches the k-th largest
    lower bound that the task has seen so far (k or more, if there are that many)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, np.ndarray] = {}  # by block of queries: the k largest lower bounds of each
        for pdf in batches:
            for keys, data, block, q_keys, q_data in zip(pdf["keys"], pdf["data"], pdf["block"], pdf["q_keys"], pdf["q_data"], strict=True):
                queries = np.frombuffer(q_data, dtype=np.int64).reshape(-1, dims)
                low, up = grid.bounds(np.frombuffer(data, dtype=np.uint8).reshape(-1, dims), queries)
                top = low if low.shape[1] <= k else np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
                if block in best:
                    top = np.concatenate([best[block], top], axis=1)
                best[block] = top = np.sort(top, axis=1)[:, -k:]
                floor = top[:, 0] if top.shape[1] == k else np.full(len(queries), np.iinfo(np.int64).min)
                i, j = np.nonzero(up >= floor[:, None])
                yield pd.DataFrame({"q": np.asarray(q_keys)[i], "n": np.asarray(keys)[j], "low": low[i, j], "up": up[i, j]})

    asked = asked.withColumnsRenamed({"keys": "q_keys", "data": "q_data"})
    blocks = asked.count()
    deal = max(1, -(-2 * partitions(file.sparkSession) // max(1, blocks)))
    places = F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("place")
    numbers = F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias("block")
    here = file.select("keys", "data", F.pmod(F.xxhash64("keys"), F.lit(deal)).cast("int").alias("place"), numbers)
    pairs = here.join(asked.select("*", places), ["block", "place"])
    return pairs.select("keys", "data", "block", "q_keys", "q_data").mapInPandas(run, "q long, n long, low long, up long")


def search(queries: DataFrame, rows: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """query_id, rank, id, score: the k rows (id, v) of the largest inner product with each
    query (id, v), whole numbers both."""
    most = k + 1  # one of them may be the query's own
    held = rows.groupBy("id", "v").agg(F.count("*").alias("copies"))
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    held = held.withColumn("place", least).filter(F.col("place") <= most).select(F.monotonically_increasing_id().alias("n"), "id", "v", "copies")
    held = materialize(held)
    asked = materialize(queries.select("id", "v").distinct())
    vectors = materialize(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("n"), "v"))
    (dims, low, high), (q_dims, *q_range) = _range(held), _range(vectors)
    dims = max(dims, q_dims)
    largest, q_largest = (max([0, *(abs(int(x)) for r in rs for x in r)]) for rs in ((low, high), q_range))
    if largest * q_largest * max(1, dims) >= 1 << 62:
        raise ValueError("the components are so large that a score might not fit a long")
    fill = lambda x: np.concatenate([x, np.zeros(dims - len(x), dtype=np.int64)])
    grid = Grid(np.minimum(fill(low), 0) if len(low) < dims else low, np.maximum(fill(high), 0) if len(high) < dims else high, bits)
    file = materialize(_packed(held, dims, BLOCK, grid))
    blocks = materialize(_packed(vectors.coalesce(max(1, vectors.count() // (4 * QUERIES))), dims, QUERIES))
    blocks = _numbered(blocks)
    found = materialize(candidates(file, blocks, grid, dims, most))

    by = Window.partitionBy("q")
    kth = found.withColumn("r", F.row_number().over(by.orderBy(F.col("low").desc()))).filter(F.col("r") <= most).groupBy("q").agg(F.when(F.count("*") == most, F.min("low")).alias("least"))
    found = found.join(kth, "q").filter(F.col("least").isNull() | (F.col("up") >= F.col("least")))
    found = found.select("q", "n", "up", F.row_number().over(by.orderBy(F.col("up").desc(), "n")).alias("r"))
    product = F.aggregate(F.zip_with("v", "qv", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.join(vectors.select(F.col("n").alias("q"), F.col("v").alias("qv")), "q").join(held, "n")
        return both.select("q", "id", "copies", product.alias("score"))

    found = materialize(found)
    first = materialize(exact(found.filter(F.col("r") <= most)))
    certain = first.groupBy("q").agg(F.min("score").alias("least"))
    rest = exact(found.filter(F.col("r") > most).join(certain, "q").filter(F.col("up") >= F.col("least")))
    best = first.union(rest).withColumn("r", F.row_number().over(by.orderBy(F.col("score").desc(), "id"))).filter(F.col("r") <= most).drop("r")
    asked = asked.select(F.col("id").alias("query_id"), "v").transform(lambda a: fair_join(a, vectors, "v")).select("query_id", F.col("n").alias("q"))
    each = fair_join(materialize(asked), best, "q").filter(F.col("id") != F.col("query_id"))
    each = each.select("query_id", "id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _range(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(dimensions, smallest, largest component of each) of the vectors v; one row a task comes to
    the driver. Shorter vectors have zeros there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = False
        for pdf in batches:
            if len(pdf):
                dims = max(len(low), *(len(v) for v in pdf["v"]), 1)
                m = matrix(pdf["v"].to_numpy(), dims)
                if seen:
                    m = np.concatenate([m, matrix([low, high], dims)])
                low, high, seen = m.min(axis=0), m.max(axis=0), True
        if seen:
            yield pd.DataFrame({"low": [low], "high": [high]})

    got = rows.select("v").mapInPandas(run, "low array<long>, high array<long>").collect()
    dims = max([0, *(len(r["low"]) for r in got)])
    if not got:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return dims, matrix([r["low"] for r in got], dims).min(axis=0), matrix([r["high"] for r in got], dims).max(axis=0)


def _numbered(blocks: DataFrame) -> DataFrame:
    """blocks with their numbers from 0, as block: from the sizes of their tasks, a row each."""
    ranked = materialize(blocks.withColumn("__m", F.monotonically_increasing_id()))
    part, at, offsets = F.shiftright("__m", 33), 0, []
    for p, n in sorted(ranked.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, at))
        at += n
    few = blocks.sparkSession.createDataFrame(offsets, "__p long, __o long")
    number = (F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
    return ranked.withColumn("__p", part).join(F.broadcast(few), "__p").select(number.alias("block"), "keys", "data")
