"""Graph preparation: index, adjacency, degrees, loops, normalization, reweighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import PRIME, draw, logistic, sigmoid_cutoff
from ..sources.scratch import materialize

#: Vertices of which the index is broadcast to the edges.
FEW = 500_000


def number(rows: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """Consecutive numbers from 0 in the given order, without a window over the whole table: a
    range sort, and offsets from the sizes of its partitions (one row each on the driver)."""
    ranked = materialize(rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    sizes = sorted(ranked.groupBy(part.alias("p")).count().collect())
    offsets, at = [], 0
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    few = rows.sparkSession.createDataFrame(offsets, "__p long, __o long")
    return ranked.withColumn("__p", part).join(F.broadcast(few), "__p").withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__o")


def vertex_names(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()


def index(edges: DataFrame) -> DataFrame:
    """name, id: vertices numbered from 0 by (length, name)."""
    return number(vertex_names(edges), [F.length("name"), F.col("name")])


def by_index(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges between numbers; a name that the index lacks is an error, a null end drops its edge."""
    if vertices.count() <= FEW:
        vertices = F.broadcast(vertices)
    a, b = (vertices.select(F.col("name").alias(n), F.col("id").alias(i)) for n, i in (("src", "__a"), ("dst", "__b")))

    def found(name: str, number: str) -> Column:
        missing = F.raise_error(F.concat(F.lit("the index has no vertex "), F.col(name))).cast("long")
        return F.when(F.col(number).isNull(), missing).otherwise(F.col(number)).alias(name)

    ends = edges.filter("src is not null and dst is not null")
    return ends.join(a, "src", "left").join(b, "dst", "left").select(found("src", "__a"), found("dst", "__b"), "w")


def adjacency(edges: DataFrame, directed: bool = False) -> DataFrame:
    """src, dst, w, both ways if undirected; an edge of a vertex to itself gives two entries."""
    rows = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    return rows if directed else rows.union(rows.select("dst", "src", "w"))


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("src").agg(F.count("*").alias("degree"))


def offsets(adj: DataFrame, vertices: DataFrame) -> DataFrame:
    """id, degree, offset of the rows of each vertex, as a CSR layout has them. The running sum
    goes over ranges of ids and over the table of ranges."""
    deg = vertices.select("id").join(degrees(adj), F.col("id") == F.col("src"), "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    deg = deg.withColumn("__r", F.shiftright("id", 12))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = deg.groupBy("__r").agg(F.sum("degree").alias("n")).select("__r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__r").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return deg.join(ranges, "__r").select("id", "degree", (F.col("__o") + F.coalesce(F.sum("degree").over(inside), F.lit(0))).alias("offset"))


def with_loops(adj: DataFrame, vertices: DataFrame, weight: float, key: str = "id") -> DataFrame:
    """One (v, v, weight) for each vertex; a negative weight counts as 0 and adds nothing."""
    if weight <= 0:
        return adj
    return adj.union(vertices.select(F.col(key), F.col(key), F.lit(float(weight))))


def _per_vertex(adj: DataFrame, f) -> DataFrame:
    """f(w) of each vertex, by an aggregate and a join: a hot vertex is combined before it is
    shuffled, and the join can split it."""
    return adj.join(adj.groupBy(F.col("src").alias("__s")).agg(f("w").alias("__w")), F.col("src") == F.col("__s"))


def normalize_sum(adj: DataFrame) -> DataFrame:
    total = F.nullif(F.col("__w"), F.lit(0.0))
    return _per_vertex(adj, F.sum).select("src", "dst", F.coalesce(F.col("w") / total, F.lit(0.0)).alias("w"))


def normalize_max(adj: DataFrame) -> DataFrame:
    return _per_vertex(adj, F.max).select("src", "dst", F.coalesce(F.col("w") / F.nullif(F.col("__w"), F.lit(0.0)), F.lit(0.0)).alias("w"))


def rescaled_cutoff(adj: DataFrame, slope: float, cutoff: float = 0.2) -> DataFrame:
    """In-memory reweighting: by the maximum, logistic, by the maximum; edges below the cutoff go."""
    curved = normalize_max(adj).withColumn("w", logistic(F.col("w"), slope))
    return normalize_max(curved).filter(F.col("w") >= cutoff)


def reweighted(adj: DataFrame, slope: float, cutoff: float = 0.2) -> DataFrame:
    """Out-of-core reweighting: edges stay, with weight 0 at or below the cutoff."""
    return adj.withColumn("w", sigmoid_cutoff(F.col("w"), slope, cutoff))


def sampled(adj: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Each edge with the probability most / degree of its source; off unless it is called."""
    joined = adj.join(degrees(adj).withColumnRenamed("src", "__s"), F.col("src") == F.col("__s"))
    u = draw(F.col("src") * 31 + F.col("dst"), seed) / float(PRIME)
    return joined.filter(u < F.lit(float(most)) / F.col("degree")).select("src", "dst", "w")
