"""The registered queries of the graph, forest and network operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import cluster_edge_lists, cluster_graph
from ..functions.scalar import ACTIVATIONS, LOSSES, gini
from ..operators import consensus, forest, graph, mlp, splits
from ..operators import propagation as lp
from ..sources import edges as io
from ..sources.scratch import discard, materialize, materialize_compact, scratch_path
from . import graphs
from .graphs import table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["A", "N", "R"]


def _indexed(edges: DataFrame, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, adjacency by number), both written."""
    edges = materialize(edges)
    vertices = graph.index(edges)
    vertices = materialize(vertices)
    return vertices, materialize(graph.adjacency(graph.by_index(edges, vertices), directed))


def _ga(spark: SparkSession, sf_dir: str, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    return _indexed(graphs.supplier_part(spark, sf_dir), directed)


def _named(labels: DataFrame, vertices: DataFrame) -> DataFrame:
    return labels.join(vertices, F.col("v") == F.col("id")).select("name", "cluster")


def lp_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, adj = _ga(spark, sf_dir)
    own = lp.start(adj, vertices)
    return _named(lp.moved(own, lp.argmax(lp.tally(adj, own), own)), vertices)


def edges_supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.supplier_part(spark, sf_dir)


def edges_customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.customer_supplier(spark, sf_dir)


def edges_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.embedding_graph(spark, sf_dir)


def edgelist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.write_edges(graphs.supplier_part(spark, sf_dir), scratch_path(spark))
    return io.read_edges(spark, path)


def edges_ignore_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.write_edges(graphs.customer_supplier(spark, sf_dir), scratch_path(spark), ",")
    return io.read_edges(spark, path, ",", ignore_weights=True)


def vertex_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.index(graphs.supplier_part(spark, sf_dir)).select("name", "id")


def vertex_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.adjacency(graphs.supplier_part(spark, sf_dir))).withColumnRenamed("src", "name")


def directed_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graphs.supplier_part(spark, sf_dir)
    out = graph.degrees(graph.adjacency(edges, directed=True))
    return graph.vertex_names(edges).join(out, F.col("name") == F.col("src"), "left").select("name", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, adj = _ga(spark, sf_dir)
    return graph.offsets(adj, vertices)


def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graphs.customer_supplier(spark, sf_dir)
    looped = graph.with_loops(graph.adjacency(edges), graph.vertex_names(edges), 2.0, "name")
    return looped.groupBy("src").agg(F.count("*").alias("degree"), F.sum("w").alias("w"))


def self_loops_after_max_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graphs.customer_supplier(spark, sf_dir)
    looped = graph.with_loops(graph.normalize_max(graph.adjacency(edges)), graph.vertex_names(edges), 0.5, "name")
    return looped.groupBy("src").agg(F.count("*").alias("degree"), F.round(F.sum("w"), 6).alias("w"))


def weights_sum_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.normalize_sum(graph.adjacency(graphs.supplier_part(spark, sf_dir))).select("src", "dst", F.round("w", 10).alias("w"))


def weights_max_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.normalize_max(graph.adjacency(graphs.supplier_part(spark, sf_dir))).select("src", "dst", F.round("w", 6).alias("w"))


def parallel_edge_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.col("l_quantity").alias("w"))
    return graph.adjacency(rows).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def sigmoid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = graph.normalize_sum(graph.adjacency(graphs.supplier_part(spark, sf_dir)))
    return graph.reweighted(adj, 4.0, 0.2).select("src", "dst", F.round("w", 6).alias("w"))


def sigmoid_rescaled_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = graph.adjacency(graphs.supplier_part(spark, sf_dir))
    return graph.rescaled_cutoff(adj, 2.0, 0.55).select("src", "dst", F.round("w", 6).alias("w"))


def sigmoid_negative_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = graph.adjacency(graphs.supplier_part(spark, sf_dir))
    return graph.reweighted(adj, -1.0).select("src", "dst", "w")


def edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by number, each with the probability 5 / degree of its source."""
    return graph.sampled(_ga(spark, sf_dir)[1], 5)


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_discount") * 40 - 2
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"))
    out = [F.round(f(F.col("x")), 6).alias(f"{n}{d}") for n, fs in ACTIVATIONS.items() for f, d in zip(fs, ("", "_slope"), strict=True)]
    return rows.select("l_orderkey", "l_linenumber", *out)


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    e, o = F.col("l_discount") * 10, F.col("l_tax") * 10
    out = [F.round(f(e, o), 6).alias(f"{n}{d}") for n, fs in LOSSES.items() for f, d in zip(fs, ("", "_slope"), strict=True)]
    return rows.select("l_orderkey", "l_linenumber", *out)


def _after(spark: SparkSession, sf_dir: str, rounds: int, directed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    vertices, adj = _ga(spark, sf_dir, directed)
    return vertices, adj, lp.fixed_rounds(adj, lp.start(adj, vertices), rounds)


def label_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, adj, labels = _after(spark, sf_dir, 1)
    return lp.tally(adj, labels)


def label_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, adj, labels = _after(spark, sf_dir, 1)
    return lp.argmax(lp.tally(adj, labels), labels)


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, adj = _ga(spark, sf_dir)
    one = materialize(lp.fixed_rounds(adj, lp.start(adj, vertices), 1))
    return lp.frontier(adj, one, lp.fixed_rounds(adj, one, 1, first=1))


def lp_fixed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, _, labels = _after(spark, sf_dir, 4)
    return _named(labels, vertices)


def lp_directed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, _, labels = _after(spark, sf_dir, 4, directed=True)
    return _named(labels, vertices)


def lp_strongest_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, adj = _ga(spark, sf_dir)
    return lp.start(adj, vertices, "strongest")


def relabel_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.relabel_dense(materialize(_after(spark, sf_dir, 2)[2]))


def relabel_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp.relabel_first_seen(materialize(_after(spark, sf_dir, 2)[2]))


def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, 4)[2].groupBy("cluster").agg(F.count("*").alias("size"))


def deparse_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    return lp.deparse_communities(groups.withColumn("group", F.col("n_regionkey") + 1))


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, adj, labels = _after(spark, sf_dir, 4)
    return lp.modularity(adj, labels).select(F.round("modularity", 9).alias("modularity"))


def lp_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, adj = _ga(spark, sf_dir)
    return _named(lp.relabel_dense(lp.propagate(adj, lp.start(adj, vertices)).labels), vertices)


def flp_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole call for a graph in memory: maxima to 1, loops of 0.5, until nothing changes."""
    found = cluster_graph(graphs.customer_supplier(spark, sf_dir), self_loops=True)
    return found.select(F.col("Vertex").alias("name"), F.col("Cluster").alias("cluster"))


def flp_out_of_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole call for edge-list files: sums to 1, until nothing changes, cluster table written and read."""
    path = io.write_edges(graphs.supplier_part(spark, sf_dir), scratch_path(spark))
    return cluster_edge_lists(spark, path).select(F.col("Vertex").alias("name"), F.col("Cluster").alias("cluster"))


def flp_consensus_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_graph(graphs.embedding_graph(spark, sf_dir), consensus=True)
    return found.select(F.col("Vertex").alias("name"), F.col("Cluster").alias("cluster"))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The labels after rounds 1, 2 and 3 as three runs."""
    vertices, adj = _ga(spark, sf_dir)
    labels, runs = lp.start(adj, vertices), None
    for r in range(3):
        labels = materialize(lp.fixed_rounds(adj, labels, 1, first=r))
        own = labels.select(F.lit(r).alias("run"), "v", "cluster")
        runs = own if runs is None else runs.union(own)
    return adj, runs


def comembership_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj, runs = _runs(spark, sf_dir)
    return consensus.comembership_edges(adj, runs, 3).select("src", "dst", "n")


def comembership_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("run"), F.col("n_regionkey").alias("cluster")), F.struct(F.lit(1).alias("run"), (F.col("n_nationkey") % 3).alias("cluster")), F.struct(F.lit(2).alias("run"), (F.length("n_name") % 4).alias("cluster")))).alias("k")
    runs = n.select(F.col("n_nationkey").alias("v"), kinds).select("v", "k.run", "k.cluster")
    return consensus.comembership_pairs(runs, 3).select("v1", "v2", F.round("w", 6).alias("w"))


def consensus_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj, runs = _runs(spark, sf_dir)
    return consensus.comembership_edges(adj, runs, 3).groupBy("src").agg(F.round(F.sum("w"), 6).alias("w"), F.count_if(F.col("w") > 0).alias("kept"))


def consensus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize_compact(graphs.embedding_graph(spark, sf_dir))
    vertices = materialize(graph.index(edges))
    numbered = materialize_compact(graph.by_index(edges, vertices))
    discard(edges)
    found = consensus.consensus(graph.adjacency(numbered), vertices, scaled=True)
    return _named(lp.relabel_dense(found.labels), vertices)


def gini_impurity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("l_returnflag") == c) for c in FLAGS]
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(gini(counts), 6).alias("gini"))


def gini_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = splits.long_features(graphs.returns(spark, sf_dir), FEATURES, "l_returnflag")
    return splits.gini_best(cells, FLAGS).select("feature", "threshold", F.round("gain", 9).alias("gain"))


def sse_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = splits.long_features(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax", "l_extendedprice"], "l_quantity", ["l_returnflag"])
    return splits.sse_best(cells, ["l_returnflag"]).select("l_returnflag", "feature", "threshold", F.round("gain", 2).alias("gain"))


def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.majority(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_suppkey"])


def tabulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tabulate(graphs.returns(spark, sf_dir), "l_quantity", "id")


def stump_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a split at quantity 25 with their majority and impurity."""
    rows = graphs.returns(spark, sf_dir).withColumn("side", F.when(F.col("l_quantity") <= 25, "left").otherwise("right"))
    impurity = rows.groupBy("side").agg(F.round(gini([F.count_if(F.col("l_returnflag") == c) for c in FLAGS]), 6).alias("gini"))
    return splits.majority(rows, "l_returnflag", ["side"]).join(impurity, "side").select("side", "class", "n", "gini")


def stump_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("side", F.when(F.col("l_quantity") <= 25, "left").otherwise("right"))
    return rows.groupBy("side").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.count("*").alias("n"))


#: Hand-written trees over FEATURES; leaves are classes of FLAGS.
FIXED = forest.Forest(
    [
        forest.Tree.from_arrays([0, 2, 3, -1, -1, -1, 1, -1, -1], [25.0, 0.05, 0.04, 0.0, 1.0, 2.0, 30000.0, 1.0, 0.0], [0.1, 0.05, 0.05, 0, 0, 0, 0.02, 0, 0]),
        forest.Tree.from_arrays([1, -1, 0, -1, -1], [20000.0, 1.0, 40.0, 2.0, 0.0], [0.1, 0, 0.05, 0, 0]),
        forest.Tree.from_arrays([2, -1, -1], [0.03, 2.0, 1.0], [0.1, 0, 0]),
    ],
    FEATURES,
    FLAGS,
)


def tree_predict_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graphs.returns(spark, sf_dir)
    return rows.select("id", forest.compiled(FIXED.trees[0], [F.col(c) for c in FEATURES]).alias("leaf"))


def forest_vote_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = forest.predict(FIXED, graphs.returns(spark, sf_dir), FEATURES)
    return voted.select("id", *[F.round(c, 6).alias(f"vote_{c}") for c in FLAGS])


def forest_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_numbers = forest.Forest(FIXED.trees, FEATURES, None)
    return forest.predict(as_numbers, graphs.returns(spark, sf_dir), FEATURES).select("id", F.round("prediction", 6).alias("prediction"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = forest.predict(FIXED, graphs.returns(spark, sf_dir), FEATURES)
    return forest.confusion(voted.withColumn("predicted", forest.predicted_class(FIXED, voted)), "l_returnflag", "predicted")


def tree_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, inner nodes and depth of the fixed trees, from their table of nodes."""
    nodes = FIXED.table(spark)
    return nodes.groupBy("tree_id").agg(F.count_if(F.col("leaf_value").isNotNull()).alias("leaves"), F.count_if(F.col("leaf_value").isNull()).alias("internal"), F.max("depth").alias("depth"))


def bootstrap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(graphs.numbered_returns(spark, sf_dir).select("id"))
    out = None
    for t in range(3):
        for kind in (True, False):
            own = forest.bootstrap(rows, t, replace=kind).agg(F.lit(t).alias("tree"), F.lit(kind).alias("replaced"), F.sum("copies").alias("drawn"), F.count("*").alias("distinct_rows"))
            out = own if out is None else out.union(own)
    return out


def forest_train_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    names = [f"x{i}" for i in range(rows.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    rows = rows.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(names)])
    rows = rows.withColumn("label", F.col("label").cast("string"))
    model = forest.fit(rows, names, "label", "vec_id", nodesize=5, seed=7)
    voted = forest.predict(model, rows, names)
    return voted.select("vec_id", "label", forest.predicted_class(model, voted).alias("predicted"))


def forest_votes_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trained forest's votes must be: shares that sum to 1 over all classes."""
    rows = graphs.numbered_returns(spark, sf_dir)
    model = forest.fit(rows, FEATURES, "l_returnflag", "id", ntree=5, nodesize=50, seed=3)
    voted = forest.predict(model, rows, FEATURES)
    return voted.select("id", F.round(sum(F.col(c) for c in FLAGS), 9).alias("votes"), F.lit(len(model.classes)).alias("classes"))


def _nodes(model: forest.Forest, spark: SparkSession) -> DataFrame:
    t = model.table(spark)
    return t.select("node_id", "feature", F.round("threshold", 6).alias("threshold"), F.round("leaf_value", 4).alias("leaf_value"))


def tree_fit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a grown tree of depth 1 over all rows and features."""
    rows = graphs.numbered_returns(spark, sf_dir)
    return _nodes(forest.fit(rows, FEATURES, "l_returnflag", "id", ntree=1, mtry=4, replace=False, sampsize=rows.count(), max_depth=1), spark)


def tree_fit_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graphs.numbered_returns(spark, sf_dir)
    return _nodes(forest.fit(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "id", ntree=1, mtry=3, replace=False, sampsize=rows.count(), max_depth=1), spark)


def forest_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by three features: predictions of a regression forest lie within the range of the prices."""
    rows = graphs.numbered_returns(spark, sf_dir)
    model = forest.fit(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "id", ntree=5, mtry=3, nodesize=50, max_depth=5, seed=199)
    least, most = rows.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return forest.predict(model, rows, model.columns).select("id", F.col("prediction").between(least, most).alias("within"))


def dendrogram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawing of the fixed trees: leaves below, height and midpoint of each node."""
    rows = [(i, k, n["members"], n["height"], n["midpoint"]) for i in range(len(FIXED.trees)) for k, n in enumerate(FIXED.dendrogram(i))]
    return spark.createDataFrame(rows, "tree_id int, node_id int, members int, height double, midpoint double")


_NET = mlp.Network(
    [np.array([[0.5, -0.25, 0.75, 0.1], [-0.6, 0.4, 0.2, -0.3], [0.3, 0.3, -0.5, 0.8]]), np.array([[0.7, -0.2, 0.4]])],
    [np.array([0.1, -0.2, 0.05]), np.array([-0.1])],
    ["tanh", "sigmoid"],
)
_SCALE = {"l_quantity": 50.0, "l_extendedprice": 100000.0, "l_discount": 0.1, "l_tax": 0.08}


def _inputs() -> list:
    return [F.col(c) / s for c, s in _SCALE.items()]


def mlp_forward_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graphs.returns(spark, sf_dir)
    return rows.select("id", F.round(_NET.expression(_inputs())[0], 6).alias("output"))


def mlp_loss_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _NET.expression(_inputs())[0]
    target = (F.col("l_returnflag") == "N").cast("double")
    rows = graphs.returns(spark, sf_dir).select("l_returnflag", LOSSES["squared"][0](out, target).alias("l"))
    return rows.groupBy("l_returnflag").agg(F.round(F.avg("l"), 6).alias("loss"))


MLP_PASSES = 3


def mlp_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graphs.returns(spark, sf_dir).select("id", *[(F.col(c) / s).alias(c) for c, s in _SCALE.items()])
    rows = rows.withColumn("y", F.col("l_quantity") * 0.5 + F.col("l_discount") * 0.3)
    net, _ = mlp.train(rows, FEATURES, ["y"], "id", [4], rate=0.5, epoch_size=max(1, rows.count()), passes=MLP_PASSES)
    return mlp.predict(net, rows, FEATURES).select("id", F.round(F.get("output", F.lit(0)), 6).alias("output"))


QUERIES = {
    f.__name__: f
    for f in (
        lp_round1, edges_supplier_part, edges_customer_supplier, edges_similarity, edgelist_roundtrip, edges_ignore_weights, vertex_index, vertex_degree, directed_out_degree, csr_offsets,
        self_loops, self_loops_after_max_norm, weights_sum_norm, weights_max_norm, parallel_edge_tally, sigmoid_weights, sigmoid_rescaled_cutoff, sigmoid_negative_slope, edge_sample, activations, losses,
        label_tally, label_argmax, frontier, lp_fixed_rounds, lp_directed_rounds, lp_strongest_start, relabel_dense, relabel_first_seen, community_sizes, deparse_communities, modularity, lp_converged, flp_in_memory, flp_out_of_core, flp_consensus_rescaled,
        comembership_edges, comembership_pairs, consensus_weights, consensus_clusters, gini_impurity, gini_best_split, sse_best_split, majority_class, tabulate,
        stump_classify, stump_regress, tree_predict_fixed, forest_vote_fraction, forest_mean, confusion_matrix, tree_describe, bootstrap_sizes, forest_train_predict, forest_votes_sum,
        tree_fit_classify, tree_fit_regress, forest_regression, dendrogram_nodes,
        mlp_forward_fixed, mlp_loss_fixed, mlp_train,
    )
}
