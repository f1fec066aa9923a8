import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.api import cluster_edge_lists, cluster_graph, deparse_communities
from graphloom.functions.scalar import SLOPES
from graphloom.operators import consensus, graph
from graphloom.operators import propagation as lp
from graphloom.plans import queries
from graphloom.sources import edges as io
from graphloom.sources.scratch import materialize, materialize_compact

#: Two triangles that a weak edge joins.
TRIANGLES = [("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.9), ("x", "y", 0.9), ("y", "z", 0.9), ("x", "z", 0.9), ("c", "x", 0.1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, w double")


def groups(rows):
    out = {}
    for name, c in rows:
        out.setdefault(c, set()).add(name)
    return sorted(map(frozenset, out.values()), key=sorted)


def test_index_is_by_length_then_name(spark):
    got = graph.index(frame(spark, [("bb", "a", 1.0), ("c", "aaa", 1.0)])).orderBy("id").collect()
    assert [(r["name"], r["id"]) for r in got] == [("a", 0), ("c", 1), ("bb", 2), ("aaa", 3)]


def test_self_edge_gives_two_entries_and_parallel_edges_stay(spark):
    adj = graph.adjacency(frame(spark, [("a", "a", 1.0), ("a", "b", 2.0), ("a", "b", 3.0)]))
    assert adj.filter("src = 'a' and dst = 'a'").count() == 2
    assert adj.filter("src = 'b'").count() == 2


def test_every_vertex_is_normalized(spark):
    adj = graph.adjacency(frame(spark, TRIANGLES))
    assert all(abs(r[0] - 1) < 1e-12 for r in graph.normalize_sum(adj).groupBy("src").agg(F.sum("w")).select("sum(w)").collect())
    assert all(r[0] == 1 for r in graph.normalize_max(adj).groupBy("src").agg(F.max("w")).select("max(w)").collect())
    zero = graph.normalize_sum(frame(spark, [("a", "b", 0.0)]))
    assert zero.first()["w"] == 0.0


def test_weights_are_parsed_whole(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("a\tb\t1.5\nb\tc\t12\nc\td\t5\nd\te\t1e-3")  # without a last newline
    got = io.read_edges(spark, str(tmp_path / "e.tsv")).collect()
    assert sorted(r["w"] for r in got) == [1e-3, 1.5, 5.0, 12.0]


@pytest.mark.parametrize(("text", "kinds"), [("a\tb\t1\na\tb\n", {}), ("a\n", {}), ("a\tb\n", {}), ("a\tb\tx\n", {}), ("a\n", {"ignore_weights": True})])
def test_bad_edge_lists(spark, tmp_path, text, kinds):
    (tmp_path / "e.tsv").write_text(text)
    with pytest.raises(ValueError):
        io.read_edges(spark, str(tmp_path / "e.tsv"), **kinds)


def test_separator_is_no_pattern(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a|b|2\n")
    assert io.read_edges(spark, str(tmp_path / "e.txt"), "|").first()["w"] == 2.0


def test_triangles_converge_to_two_clusters(spark):
    got = cluster_graph(frame(spark, TRIANGLES)).collect()
    assert groups(got) == [frozenset("abc"), frozenset("xyz")]
    assert {r["Cluster"] for r in got} == {1, 2}


@pytest.mark.parametrize("mode", ["cutoff", "rescaled"])
def test_consensus_keeps_the_triangles(spark, mode):
    edges = frame(spark, TRIANGLES)
    vertices = materialize(graph.index(edges))
    adj = materialize(graph.normalize_max(graph.adjacency(graph.by_index(edges, vertices))))
    for pairs in ("edges", "all"):
        found = consensus.consensus(adj, vertices, (0.0, 1.0, 2.0), mode=mode, pairs=pairs)
        assert found.converged
        names = found.labels.join(vertices, F.col("v") == F.col("id")).select("name", "cluster").collect()
        assert groups(names) == [frozenset("abc"), frozenset("xyz")]


def test_directed_sink_and_isolated_vertices_keep_their_label(spark):
    got = dict(cluster_graph(frame(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("q", "q", 1.0)]), directed=True).collect())
    assert len(got) == 4
    assert got["q"] not in {got["a"], got["b"], got["c"]}


def test_edge_order_and_file_split_make_no_difference(spark, tmp_path):
    lines = [f"{a}\t{b}\t{w}\n" for a, b, w in TRIANGLES]
    (tmp_path / "one.tsv").write_text("".join(lines))
    (tmp_path / "two.tsv").write_text("".join(lines[:3:-1]))
    (tmp_path / "three.tsv").write_text("".join(lines[:4]))
    one = cluster_edge_lists(spark, str(tmp_path / "one.tsv"))
    two = cluster_edge_lists(spark, [str(tmp_path / "two.tsv"), str(tmp_path / "three.tsv")])
    assert sorted(one.collect()) == sorted(two.collect())


def test_cluster_files_round_trip(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("".join(f"{a}\t{b}\t{w}\n" for a, b, w in TRIANGLES))
    path = cluster_edge_lists(spark, str(tmp_path / "e.tsv"), outfile=str(tmp_path / "out"), return_table=False)
    assert io.read_clusters(spark, path).count() == 6


def test_rounds_are_counted(spark):
    edges = frame(spark, TRIANGLES)
    vertices = materialize(graph.index(edges))
    adj = materialize(graph.adjacency(graph.by_index(edges, vertices)))
    assert lp.propagate(adj, lp.start(adj, vertices), max_rounds=1).rounds == 1


def test_argument_checks(spark):
    edges = frame(spark, TRIANGLES)
    with pytest.raises(ValueError):
        cluster_graph(edges, iterations=-1)
    with pytest.raises(ValueError):
        cluster_graph(edges, consensus=[-1.0])
    with pytest.warns(UserWarning):
        cluster_graph(edges, self_loops=-1.0, iterations=2)


def test_deparse(spark):
    assert deparse_communities([["a", "b"], ["c"]]) == {"a": 1, "b": 1, "c": 2}


def test_the_registered_consensus_runs_over_all_slopes(spark, sf_dir, monkeypatch):
    """Its edge weights are ninths."""
    runs, plain = [], consensus.comembership_edges
    monkeypatch.setattr(consensus, "comembership_edges", lambda adj, found, n: runs.append((n, found.select("run").distinct().count())) or plain(adj, found, n))
    assert queries.consensus_clusters(spark, sf_dir).count() > 0
    assert runs == [(len(SLOPES), len(SLOPES))] and len(SLOPES) == 9


def test_missing_files_and_names_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        io.read_edges(spark, [str(tmp_path / "nowhere.tsv")])
    edges = frame(spark, [("a", "b", 1.0), ("b", "zz", 1.0)])
    few = graph.index(edges).filter("name <> 'zz'")
    with pytest.raises(Exception, match="no vertex zz"):
        graph.by_index(edges, few).collect()


def test_scratch_tables_of_a_call_are_removed(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("".join(f"{a}\t{b}\t{w}\n" for a, b, w in TRIANGLES))
    left = lambda: {p for p in (tmp_path.parent / "..").resolve().glob("*/checkpoints/graphloom-*")}
    before = left()
    path = cluster_edge_lists(spark, str(tmp_path / "e.tsv"), outfile=str(tmp_path / "out"), return_table=False)
    assert left() <= before and io.read_clusters(spark, path).count() == 6


@pytest.mark.parametrize("mode", ["cutoff", "rescaled"])
def test_consensus_over_lists_is_that_of_joined_copies(spark, monkeypatch, mode):
    """The same labels and rounds, with directed, parallel and zero edges, and with no copy of an edge written."""
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 500), rng.integers(0, 60, 500), rng.integers(0, 5, 500) / 4, strict=True)]
    adj, vertices = spark.createDataFrame(rows, "src long, dst long, w double"), spark.range(64)
    joined = consensus.consensus(adj, vertices, mode=mode, seed=2, max_rounds=12, held_labels=0)
    monkeypatch.setattr(consensus, "propagate", lambda *_: pytest.fail("copies were written"))
    held = consensus.consensus(adj, vertices, mode=mode, seed=2, max_rounds=12)
    assert held.changed == joined.changed and held.converged == joined.converged
    assert sorted(held.labels.collect()) == sorted(joined.labels.collect())


def test_a_call_with_consensus_writes_no_copies(spark, monkeypatch):
    monkeypatch.setattr(consensus, "propagate", lambda *_: pytest.fail("copies were written"))
    found = cluster_graph(spark.createDataFrame(TRIANGLES, "src string, dst string, w double"), consensus=True).collect()
    groups = {r["Vertex"]: r["Cluster"] for r in found}
    assert groups["a"] == groups["b"] == groups["c"] != groups["x"] == groups["y"] == groups["z"]


@pytest.mark.parametrize("mode", ["cutoff", "rescaled"])
def test_lists_are_made_in_slices_and_scaled_by_their_maxima(spark, monkeypatch, mode):
    """Slices of 40 of the 500 edges, weights divided in the lists and co-membership without rows for edges: the labels of joined copies."""
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 500), rng.integers(0, 60, 500), rng.integers(0, 5, 500) / 4, strict=True)]
    adj, vertices = spark.createDataFrame(rows, "src long, dst long, w double"), spark.range(64)
    joined = consensus.consensus(graph.normalize_max(adj), vertices, mode=mode, max_rounds=12, held_labels=0)
    monkeypatch.setattr(lp, "SLICE", 40)
    lists = lp.neighbours(adj)
    assert sorted((r["src"], d, w) for r in lists.collect() for d, w in zip(r["dst"], r["w"], strict=True)) == sorted(rows)
    assert len(lists.select("src").distinct().collect()) == lists.count()
    held = consensus.consensus(adj, vertices, mode=mode, max_rounds=12, scaled=True)
    assert held.changed == joined.changed and sorted(held.labels.collect()) == sorted(joined.labels.collect())


def test_a_compact_table_leaves_no_shuffle_files_and_keeps_its_dictionary(spark):
    """Numbers with six decimals take fewer than the 8 bytes of a double."""
    w = F.round(F.rand(1) * 0.02, 6)
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum(".data" in f.getName() for f in map(files.getAllFiles().apply, range(files.getAllFiles().size())))
    before = shuffles()
    made = materialize_compact(spark.range(400_000).select((F.col("id") % 20_000).alias("v"), w.alias("w")).repartition(1))
    deadline = time.time() + 20
    while shuffles() > before and time.time() < deadline:
        time.sleep(0.2)
    assert shuffles() <= before
    size = sum(Path(f.removeprefix("file:")).stat().st_size for f in made.inputFiles())
    assert made.count() == 400_000 and size < 400_000 * 6
