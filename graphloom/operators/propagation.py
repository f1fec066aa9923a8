"""Label propagation by rounds of join, tally and argmax.

A vertex takes the label of the largest weight among its neighbours; on a tie it keeps the label
it has, else takes the lowest (or, with random ties, one by hash). Vertices move in halves that
are drawn anew for each round, and only those of which a neighbour has changed since they
were last tried; when none is left, the labelling is a fixed point."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import PRIME, draw
from ..sources.scratch import discard, materialize, materialize_compact, set_conf
from . import graph

log = logging.getLogger(__name__)

#: Rounds after which propagation stops in any case (a directed graph may go round for ever); the
#: result says whether it converged.
MAX_ROUNDS = 200
#: Labels (of all runs) up to which they are broadcast to the lists of neighbours; beyond, they are joined.
HELD_LABELS = 4_000_000
#: Lists of neighbours that a task holds at once.
LISTS = 500
#: Edges that are shuffled at once to make lists of neighbours.
SLICE = 25_000_000


def tally(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """src, cluster, w: the weight of each label among a vertex's neighbours. labels: v, cluster."""
    near = labels.select(F.col("v").alias("dst"), "cluster")
    return adj.join(near, "dst").groupBy("src", "cluster").agg(F.sum("w").alias("w"))


def argmax(tallied: DataFrame, labels: DataFrame, ties: Column | None = None) -> DataFrame:
    """v, cluster: the heaviest label of each vertex; weights are compared to nine decimals."""
    now = labels.select(F.col("v").alias("src"), F.col("cluster").alias("now"))
    order = F.struct(F.round("w", 9).alias("w"), (F.col("cluster") == F.col("now")).alias("same"), (-F.col("cluster") if ties is None else ties).alias("o"), "cluster")
    best = tallied.join(now, "src").groupBy("src").agg(F.max(order).alias("best"))
    return best.select(F.col("src").alias("v"), F.col("best.cluster").alias("cluster"))


def moved(labels: DataFrame, best: DataFrame) -> DataFrame:
    new = best.select("v", F.col("cluster").alias("new"))
    return labels.join(new, "v", "left").select("v", F.coalesce("new", "cluster").alias("cluster"))


def frontier(adj: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """v: vertices that have an edge to one whose label changed, and another label than it."""
    changed = after.join(before.select("v", F.col("cluster").alias("old")), "v").filter("cluster <> old").select(F.col("v").alias("dst"), F.col("cluster").alias("theirs"))
    mine = after.select(F.col("v").alias("src"), F.col("cluster").alias("mine"))
    return adj.join(changed, "dst").join(mine, "src").filter("mine <> theirs").select(F.col("src").alias("v")).distinct()


def fixed_rounds(adj: DataFrame, labels: DataFrame, rounds: int, first: int = 0) -> DataFrame:
    """Rounds in which the vertices of even and odd number move in turn."""
    for r in range(first, first + rounds):
        turn = adj.filter(F.col("src") % 2 == r % 2)
        labels = moved(labels, argmax(tally(turn, labels), labels))
        if r % 2:
            labels = materialize(labels)
    return labels


def start(adj: DataFrame, vertices: DataFrame, init: str = "own") -> DataFrame:
    """v, cluster: the own number, or that of the strongest neighbour."""
    own = vertices.select(F.col("id").alias("v"), F.col("id").alias("cluster"))
    if init == "own":
        return own
    if init != "strongest":
        raise ValueError("init is 'own' or 'strongest'")
    best = adj.groupBy("src").agg(F.max(F.struct("w", -F.col("dst"))).alias("m")).select(F.col("src").alias("v"), (-F.col("m")["col2"]).alias("cluster"))
    return moved(own, best)


@dataclass
class Result:
    labels: DataFrame
    rounds: int
    changed: list[int]
    converged: bool


def propagate(adj: DataFrame, labels: DataFrame, max_rounds: int | None = None, seed: int = 0, random_ties: bool = False) -> Result:
    """Rounds until a fixed point, or max_rounds. adj must be a written table."""
    # the draw of the halves is a column that each pair of rounds redraws from itself and the vertex, so
    # that rounds are the same generated code
    again = (draw(F.col("draw"), seed) + F.pmod(F.col("v"), F.lit(PRIME)) * 69621) % PRIME
    state = materialize(labels.select("v", "cluster", draw(F.col("v"), seed).alias("draw"), F.lit(False).alias("changed"), F.lit(True).alias("left")))
    changes: list[int] = []
    for r in range(max_rounds or MAX_ROUNDS):
        half = F.col("draw") % 2 == r % 2
        pending = state.select("v", "cluster", "draw", F.col("left").alias("pending"))
        if changes and changes[-1]:  # the neighbours of what has changed are to be tried
            near = adj.join(state.filter("changed").select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v")).distinct().withColumn("near", F.lit(True))
            pending = state.join(near, "v", "left").select("v", "cluster", "draw", (F.col("left") | F.coalesce("near", F.lit(False))).alias("pending"))
        turn = pending.filter(F.col("pending") & half).select(F.col("v").alias("src"))
        ties = F.xxhash64("src", "cluster", F.lit(seed), F.lit(r)) if random_ties else None
        best = argmax(tally(adj.join(turn, "src", "left_semi"), state), state, ties).select("v", F.col("cluster").alias("new"))
        changed = F.coalesce(F.col("new") != F.col("cluster"), F.lit(False))
        drawn = again if r % 2 else F.col("draw")
        after = materialize(pending.join(best, "v", "left").select("v", F.coalesce("new", "cluster").alias("cluster"), drawn.alias("draw"), changed.alias("changed"), (F.col("pending") & ~half).alias("left")))
        n_changed, n_left = after.agg(F.count_if("changed"), F.count_if("left")).first()
        discard(state)
        state = after
        changes.append(n_changed)
        log.info("round %d: %d vertices changed, %d wait for their turn", r + 1, n_changed, n_left)
        if not n_changed and not n_left:
            return Result(state.select("v", "cluster"), r + 1, changes, True)
    return Result(state.select("v", "cluster"), len(changes), changes, False)


def neighbours(adj: DataFrame) -> DataFrame:
    """A written table of lists: src, dst, w. adj is read once for each SLICE of its edges, of which one at a time lies in shuffle files."""
    n = -(-adj.count() // SLICE) or 1
    entries = adj.select("src", F.struct(F.col("dst").cast("int").alias("dst"), "w").alias("e"))
    lists = lambda rows: rows.groupBy("src").agg(F.collect_list("e").alias("e")).select(F.col("src").cast("int").alias("src"), "e.dst", "e.w")
    return materialize_compact(*[lists(entries.filter(F.pmod("src", F.lit(n)) == i)) for i in range(n)])


def short_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Python gets LISTS rows at once."""
    return set_conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(LISTS))


def flat(lists: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(src, how many neighbours each has, dst, w) of rows of neighbours()."""
    src, dst, w = (c.flatten() if isinstance(c, pa.ListArray) else c for c in lists.columns)
    return src.to_numpy(), np.diff(lists.columns[1].offsets.to_numpy()), dst.to_numpy(), w.to_numpy()


def _draws(x: np.ndarray, seed: int) -> np.ndarray:
    """draw() of functions.scalar for an array."""
    salt = seed * 16807 % PRIME
    h = (x % PRIME * 48271 + (salt + 11)) % PRIME
    h = (h * h + (salt * 3 + 7)) % PRIME
    h = (h * 69621 + 13) % PRIME
    return (h * h + h) % PRIME


def propagate_lists(lists: DataFrame, size: int, runs: int, weights: Callable, max_rounds: int | None = None, seed: int = 0) -> tuple[np.ndarray, list[int], bool]:
    """(labels, changes, converged) of propagate() for copies of a graph that differ in their weights; vertex v of run r has
    the number r * size + v. labels: a row for each run, with vertices as labels. lists: neighbours(), of numbers below size.
    weights(run, src, dst, w, starts): the weights in a run and which edges it has (None: all); src: for each edge, starts: where lists begin."""
    spark = lists.sparkSession
    labels = np.tile(np.arange(size, dtype=np.int32), (runs, 1))
    number = np.arange(runs * size, dtype=np.int64).reshape(runs, size)
    draws, left, changed = _draws(number, seed), np.ones((runs, size), dtype=bool), np.zeros((runs, size), dtype=bool)
    changes: list[int] = []
    for r in range(max_rounds or MAX_ROUNDS):
        half = draws % 2 == r % 2
        held = spark.sparkContext.broadcast((labels, left, changed, half))

        def round_(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            labels, left, changed, half = held.value
            for batch in batches:
                for at in range(0, batch.num_rows, LISTS):
                    src, sizes, dst, w = flat(batch.slice(at, LISTS))
                    starts = np.append(0, np.cumsum(sizes)[:-1])
                    every = np.repeat(np.arange(len(src)), sizes)
                    for run in range(runs):
                        touched = changed[run][dst]
                        tried = left[run][src] | np.logical_or.reduceat(touched, starts)
                        if not tried.any():
                            continue
                        use = tried[every]  # only lists that wait or have a changed vertex
                        s, n, d = src[tried], sizes[tried], dst[use]
                        begin, of = np.append(0, np.cumsum(n)[:-1]), np.repeat(np.arange(len(s)), n)
                        own, kept = weights(run, s[of], d, w[use], begin)
                        near = np.logical_or.reduceat(touched[use] if kept is None else touched[use] & kept, begin)
                        turn = (left[run][s] | near) & half[run][s]
                        use = turn[of] if kept is None else turn[of] & kept
                        row, new = _heaviest(of[use], labels[run][d[use]], own[use], labels[run][s], size)
                        moves = new != labels[run][s[row]]
                        v = s[row[moves]]
                        yield pa.RecordBatch.from_pydict({"run": [run], "near": [s[near].astype(np.int32).tobytes()], "v": [v.astype(np.int32).tobytes()], "new": [new[moves].astype(np.int32).tobytes()]}, schema=pa.schema([("run", pa.int32()), ("near", pa.binary()), ("v", pa.binary()), ("new", pa.binary())]))

        with short_batches(spark):
            found = lists.mapInArrow(round_, "run int, near binary, v binary, new binary").collect()
        held.destroy()
        pending, changed, labels = left.copy(), np.zeros_like(changed), labels.copy()
        for x in found:
            near, v, new = (np.frombuffer(x[c], dtype=np.int32) for c in ("near", "v", "new"))
            pending[x["run"], near] = True
            changed[x["run"], v] = True
            labels[x["run"], v] = new
        left = pending & ~half
        if r % 2:
            draws = (_draws(draws, seed) + number % PRIME * 69621) % PRIME
        changes.append(int(changed.sum()))
        log.info("round %d: %d vertices changed, %d wait for their turn", r + 1, changes[-1], left.sum())
        if not changes[-1] and not left.any():
            return labels, changes, True
    return labels, changes, False


def _heaviest(of: np.ndarray, label: np.ndarray, w: np.ndarray, now: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, label): argmax() for each row of `of`, whose labels are now."""
    if not len(of):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    key = of.astype(np.int64) * size + label
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total = np.round(np.add.reduceat(w[order], starts), 9)
    row, label = np.divmod(key[starts], size)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    top = total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(row))))
    row, label = row[top], label[top]  # by row, then by label: the first one unless the present one is among them
    same = label == now[row]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    lasts = np.logical_or.reduceat(same, first)
    return row[first], np.where(lasts, now[row[first]], label[first])


def relabel_dense(labels: DataFrame) -> DataFrame:
    """Clusters renumbered 1 to k in the order of their labels."""
    few = graph.number(labels.select("cluster").distinct(), [F.col("cluster")], "k")
    return labels.join(few, "cluster").select("v", (F.col("k") + 1).alias("cluster"))


def relabel_first_seen(labels: DataFrame) -> DataFrame:
    """Clusters renumbered 1 to k in the order of their first vertex."""
    few = graph.number(labels.groupBy("cluster").agg(F.min("v").alias("first")), [F.col("first")], "k")
    return labels.join(few, "cluster").select("v", (F.col("k") + 1).alias("cluster"))


def deparse_communities(groups: DataFrame, names: str = "names") -> DataFrame:
    """name, group from rows of arrays of names; groups are numbered from 1 by column 'group'."""
    return groups.select("group", F.explode(names).alias("name")).select("name", "group")


def modularity(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the weighted modularity of an undirected adjacency."""
    a, b = (labels.select(F.col("v").alias(x), F.col("cluster").alias(f"c_{x}")) for x in ("src", "dst"))
    inside = adj.join(a, "src").join(b, "dst").agg(F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("total"))
    squares = adj.join(a, "src").groupBy("c_src").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    return inside.join(F.broadcast(squares), F.lit(True)).select((F.col("inside") / F.col("total") - F.col("squares") / (F.col("total") * F.col("total"))).alias("modularity"))
