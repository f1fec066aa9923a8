import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.operators import forest, mlp
from graphloom.plans import queries


def frame(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, float(a), float(b), "u" if c else "v", float(3 * a - 2 * b), "yes" if a + c > 0.6 else "no") for i, (a, b, c) in enumerate(zip(rng.normal(size=n), rng.normal(size=n), rng.integers(0, 2, n), strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y double, k string").cache()


@pytest.mark.parametrize("cells", [forest.LOCAL_CELLS, 0])
def test_classification(spark, cells):
    rows = frame(spark)
    model = forest.fit(rows, ["a", "b", "c"], "k", "id", mtry=3, seed=1, local_cells=cells)
    voted = forest.predict(model, rows, ["a", "b", "c"])
    assert voted.filter(forest.predicted_class(model, voted) == F.col("k")).count() > 0.95 * rows.count()
    assert voted.filter(F.abs(F.col("yes") + F.col("no") - 1) > 1e-9).count() == 0
    assert "forest of 10 trees" in repr(model)


@pytest.mark.parametrize("cells", [forest.LOCAL_CELLS, 0])
def test_regression(spark, cells):
    rows = frame(spark)
    model = forest.fit(rows, ["a", "b"], "y", "id", mtry=2, max_depth=8, nodesize=3, seed=1, local_cells=cells)
    got = forest.predict(model, rows, ["a", "b"]).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2.0))), F.var_pop("y")).first()
    assert got[0] < 0.1 * got[1]
    assert max(t.depth.max() for t in model.trees) <= 8


def test_an_extra_column_changes_nothing(spark):
    rows = frame(spark)
    model = forest.fit(rows, ["a", "b"], "y", "id", seed=3)
    a = forest.predict(model, rows, ["a", "b"]).select("id", "prediction")
    b = forest.predict(model, rows.withColumn("zz", F.rand()), ["a", "b"]).select("id", "prediction")
    assert a.exceptAll(b).count() == 0


def test_leaves_are_majority_and_mean():
    x = np.zeros((5, 1))
    assert forest.grow(x, np.array([1, 0, 0, 0, 1.0]), np.ones(5), 2, 1, 1, None, 0).threshold[0] == 0
    assert forest.grow(x, np.array([1, 2, 3, 4, 5.0]), np.ones(5), 0, 1, 1, None, 0).threshold[0] == 3
    assert len(forest.grow(x, np.array([1, 0.0, 0, 0, 1]), np.ones(5), 2, 1, 1, None, 0).feature) == 1  # no gain, no split


def test_arrays_trees_and_drawings():
    t = forest.Tree.from_arrays([0, -1, 1, -1, -1], [0.5, 1, 2.0, 2, 3], [0.1, 0, 0.2, 0, 0])
    assert t.apply(np.array([[0.5, 9], [0.6, 2.0], [np.nan, 3.0]])).tolist() == [1, 2, 3]
    assert t.members().tolist() == [3, 1, 2, 1, 1]
    model = forest.Forest([t], ["p", "q"], None)
    assert "p <= 0.5" in model.dot() and model.dendrogram()[0]["members"] == 3
    with pytest.raises(ValueError):
        forest.Tree.from_arrays([0, -1], [1, 1], [0, 0])


def test_bad_input(spark):
    rows = frame(spark)
    with pytest.raises(ValueError):
        forest.fit(rows.withColumn("k", F.lit("yes")), ["a"], "k", "id")
    with pytest.raises(ValueError):
        forest.fit(rows, ["a"], "k", "id", mode="regression")
    with pytest.raises(ValueError):
        forest.predict(forest.fit(rows, ["a"], "y", "id", ntree=1, max_depth=1), None, ["a"])


def test_draws(spark):
    rows = frame(spark).select("id")
    assert 500 < forest.bootstrap(rows, 0).agg(F.sum("copies")).first()[0] < 700
    assert forest.bootstrap(rows, 0, replace=False).count() == 380  # ceil(0.632 * 600)


def test_gradient_is_that_of_the_loss():
    net = mlp.Network.init([3, 4, 2], ["tanh", "identity"], seed=2)
    x, y = np.random.default_rng(0).normal(size=(5, 3)), np.zeros((5, 2))
    g, loss = net.gradient(x, y)
    for k, at in ((0, (1, 2)), (1, (0, 3))):
        net.weights[k][at] += 1e-6
        assert abs((net.gradient(x, y)[1] - loss) / 1e-6 - g[2 * k][at]) < 1e-3
        net.weights[k][at] -= 1e-6


def test_training_goes_downhill(spark):
    rows = frame(spark).withColumn("t", 1 / (1 + F.exp(-F.col("y"))))
    _, losses = mlp.train(rows, ["a", "b"], ["t"], "id", [5], rate=2.0, epoch_size=300, passes=8)
    assert losses[-1] < 0.7 * losses[0]


def test_the_registered_forest_uses_all_components(spark, tmp_path, monkeypatch):
    """Labels that only the 41st of 64 components tells."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    rows = [(i, int(v[40] > 0), v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    names, plain = [], forest.fit
    monkeypatch.setattr(forest, "fit", lambda rows, features, *more, **named: names.extend(features) or plain(rows, features, *more, **named))
    got = queries.forest_train_predict(spark, str(tmp_path)).toPandas()
    assert names == [f"x{i}" for i in range(64)]
    assert len(got) == 400 and (got["label"].astype(str) == got["predicted"]).mean() > 0.9


def test_growing_matches_a_plain_search():
    """Every split of a tree is the best one of its rows, by trying all."""
    rng = np.random.default_rng(5)
    x, w = rng.integers(0, 12, (150, 3)).astype(float), rng.integers(1, 3, 150).astype(float)
    x[rng.random((150, 3)) < 0.05] = np.nan
    for n_classes in (3, 0):
        y = rng.integers(0, 3, 150).astype(float) if n_classes else rng.normal(size=150)

        def spread(i):
            if not n_classes:
                return (w[i] * (y[i] - np.average(y[i], weights=w[i])) ** 2).sum()
            return w[i].sum() * (1 - sum((w[i][y[i] == c].sum() / w[i].sum()) ** 2 for c in range(3)))

        tree = forest.grow(x, y, w, n_classes, 3, 4, 4, 0)
        at = [np.arange(150)] + [None] * (len(tree.feature) - 1)
        for k in range(len(at)):
            own = at[k]
            best = 0.0
            for f in range(3):
                for v in np.unique(x[own, f][~np.isnan(x[own, f])]):
                    goes = x[own, f] <= v
                    if 0 < goes.sum() < len(own):
                        best = max(best, spread(own) - spread(own[goes]) - spread(own[~goes]))
            if tree.feature[k] < 0:
                assert best < 1e-9 or w[own].sum() <= 4 or tree.depth[k] == 4 or len(np.unique(y[own])) == 1
                continue
            goes = x[own, tree.feature[k]] <= tree.threshold[k]
            at[tree.left[k]], at[tree.left[k] + 1] = own[goes], own[~goes]
            assert abs(spread(own) - spread(own[goes]) - spread(own[~goes]) - best) < 1e-9


def test_formulas(spark):
    rows = frame(spark)
    assert forest.parse_formula("y ~ . - k", ["a", "b", "y", "k"]) == ("y", ["a", "b"])
    a = forest.fit_formula("y ~ a + b", rows, "id", ntree=2, max_depth=3, seed=1)
    b = forest.fit(rows, ["a", "b"], "y", "id", ntree=2, max_depth=3, seed=1)
    assert a.table(spark).exceptAll(b.table(spark)).count() == 0
    holed = rows.withColumn("a", F.when(F.col("id") > 9, F.col("a")))
    assert forest.fit_formula("y ~ a", holed, "id", "model.frame").columns == ["id", "y", "a"]
    assert forest.fit_formula("y ~ a", holed, "id", "model.frame").count() == rows.count() - 10
    for bad in ("a + b", "y ~ nope"):
        with pytest.raises(ValueError):
            forest.fit_formula(bad, rows, "id")


@pytest.mark.parametrize("kinds", [{"ntree": 0}, {"mtry": "two"}, {"nodesize": -1}, {"sampsize": float("nan")}, {"max_depth": True}, {"weights": "c"}, {"weights": "a"}])
def test_numbers_are_checked(spark, kinds):
    with pytest.raises(ValueError):
        forest.fit(frame(spark), ["a"], "y", "id", **kinds)


@pytest.mark.parametrize("cells", [0, 600])
@pytest.mark.parametrize("y", ["k", "y"])
def test_growing_by_levels_splits_where_tasks_do(spark, y, cells):
    """More values than any number of quantiles, with holes and repeated rows; at 600 cells the lower nodes go to tasks."""
    rows = frame(spark, 900).withColumn("a", F.when(F.col("id") % 17 != 0, F.round("a", 2)))
    rows = rows.union(rows.filter("id < 200").withColumn("id", F.col("id") + 900))
    kinds = dict(ntree=2, mtry=2, nodesize=20, max_depth=6, seed=5, na_omit=False)
    some, own = (forest.fit(rows, ["a", "b"], y, "id", local_cells=c, **kinds) for c in (forest.LOCAL_CELLS, cells))
    for p, q in zip(some.trees, own.trees, strict=True):
        assert p.feature.tolist() == q.feature.tolist() and p.left.tolist() == q.left.tolist()
        assert np.allclose(p.threshold, q.threshold) and np.allclose(p.gain, q.gain)


def test_the_smallest_draws_are_drawn(spark):
    rows = spark.range(5000)
    got = forest.bootstrap(rows, 2, 1234, replace=False, seed=1)
    expected = rows.orderBy(forest.draw(F.col("id"), 1, 2), "id").limit(1234)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in expected.collect())
    assert forest.bootstrap(rows, 2, 6000, replace=False).count() == 5000


def repeated(spark, monkeypatch, y):
    """A forest over 20 copies of each row, where only a table of different rows has few enough cells for tasks."""
    rows = frame(spark, 200).select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r")).withColumn("id", F.col("id") * 20 + F.col("r")).drop("r")
    monkeypatch.setattr(forest, "_fit_levels", lambda *_: pytest.fail("rows were not summed"))
    model = forest.fit(rows, ["a", "b"], y, "id", ntree=3, nodesize=5, seed=3, local_cells=400)
    drawn = forest._drawn(rows.select("id", y, F.array("a", "b").alias("x")).withColumnRenamed(y, "y"), range(3), None, True, 3)
    copies = [forest.bootstrap(rows, t, seed=3).agg(F.sum("copies")).first()[0] for t in range(3)]
    assert list(drawn.agg(*[F.sum(F.get("c", F.lit(t))) for t in range(3)]).first()) == copies
    return forest.predict(model, rows, ["a", "b"])


def test_repeated_rows_are_summed_for_votes(spark, monkeypatch):
    voted = repeated(spark, monkeypatch, "k")
    assert voted.count() == 4000 and voted.filter(F.abs(F.col("yes") + F.col("no") - 1) > 1e-9).count() == 0
    assert voted.filter((F.col("yes") > 0.5) == (F.col("k") == "yes")).count() > 0.95 * 4000


def test_repeated_rows_are_summed_for_means(spark, monkeypatch):
    got = repeated(spark, monkeypatch, "y").agg(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2.0))), F.var_pop("y")).first()
    assert got[0] < 0.1 * got[1]


def test_a_walk_over_ranks_ends_in_the_leaves_of_the_trees():
    """Deep trees, a tree of one leaf, NaN, values at and beside thresholds; no rows."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 9, 3000) / 8, rng.normal(size=3000), np.zeros(3000)], axis=1)
    trees = [forest.grow(x, rng.integers(0, 3, 3000).astype(float), np.ones(3000), 3, 2, 1, None, s) for s in range(3)]
    trees.insert(1, forest.Tree.from_arrays([-1], [2.0], [0]))
    walk = forest.Walk.of(trees, 3)
    x = np.concatenate([x, np.nextafter(x, -9), np.nextafter(x, 9), np.where(rng.random(x.shape) < 0.3, np.nan, x)])
    assert max(t.depth.max() for t in trees) > 12
    np.testing.assert_array_equal(walk.values_of(list(x.T)), np.stack([t.apply(x) for t in trees]))
    assert walk.values_of([np.zeros(0)] * 3).shape == (4, 0)


def test_copies_of_a_draw_are_those_of_its_quotient(spark):
    """Draws beside each step of the distribution, against steps over doubles."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    own = sorted({min(forest.PRIME - 1, max(0, math.ceil(s * forest.PRIME) + d)) for s in steps for d in (-2, -1, 0, 1)} | {0, forest.PRIME - 1})
    total, p, exact = 0.0, math.exp(-1.0), []
    for k in range(12):
        total += p
        exact.append(total)
        p /= k + 1
    got = dict(spark.createDataFrame([(u,) for u in own], "u long").select("u", forest._poisson(F.col("u"))).collect())
    assert got == {u: sum(u / float(forest.PRIME) >= s for s in exact) for u in own}


def test_draws_are_grouped_by_columns(spark, monkeypatch):
    """An array as a key is normalized and hashed value by value for each row."""
    plans, plain = [], forest.materialize
    monkeypatch.setattr(forest, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    forest.fit(frame(spark, 300), ["a", "b"], "y", "id", ntree=2, max_depth=1)
    assert "Aggregate [__x0" in plans[0]


def test_rows_are_numbered_by_their_files_without_a_sort(spark, tmp_path, monkeypatch):
    """Files of several row groups: ids from 0 in the order of paths and rows, alike for any dealing, and no table is written."""
    (tmp_path / "lineitem.parquet").mkdir()
    row = lambda i: (i // 7, i % 7, float(i), float(i) * 2, 0.1, 0.2, "ANR"[i % 3])
    kind = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    names = [c.split()[0] for c in kind.split(", ")]
    for at, n, name in ((0, 5000, "b"), (5000, 30, "c"), (5030, 1000, "a")):
        pq.write_table(pa.table(dict(zip(names, zip(*map(row, range(at, at + n))), strict=True))), tmp_path / "lineitem.parquet" / f"{name}.parquet", row_group_size=700)
    monkeypatch.setattr("graphloom.operators.graph.materialize", lambda *_: pytest.fail("a table was written"))
    expected = [*range(5030, 6030), *range(5000), *range(5000, 5030)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "8k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted(queries.graphs.numbered_returns(spark, str(tmp_path)).select("id", "l_quantity").collect())
            assert got == [(i, float(q)) for i, q in enumerate(expected)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_growing_takes_a_bounded_number_of_bytes_a_row():
    """Two executor tasks grow trees side by side, beside the JVM."""
    rng, n = np.random.default_rng(3), 100_000
    x = np.stack([rng.integers(0, 50, n) / 1.0, rng.random(n), rng.integers(0, 11, n) / 100, rng.integers(0, 9, n) / 100], axis=1)
    for y, k in ((rng.integers(0, 3, n).astype(float), 3), (rng.random(n), 0)):
        tracemalloc.start()
        tree = forest.grow(x, y, rng.poisson(60, n) + 1.0, k, 2, 50, None, 1)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(tree.feature) > 10_000 and most < 180 * n


@pytest.mark.parametrize("k", [3, 0])
def test_growing_in_blocks_of_nodes_gives_the_same_tree(monkeypatch, k):
    """With holes and, for votes, rows without a class; places of more nodes than short numbers hold are sorted by halves."""
    rng, n = np.random.default_rng(6), 30_000
    x = np.stack([rng.random(n), rng.integers(0, 5, n) / 1.0], axis=1)
    x[rng.random((n, 2)) < 0.05] = np.nan
    y = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 3, n)) if k else rng.normal(size=n)
    whole = forest.grow(x, y, np.ones(n), k, 2, 20, None, 1)
    monkeypatch.setattr(forest, "GROW_ROWS", 200)
    blocks = forest.grow(x, y, np.ones(n), k, 2, 20, None, 1)
    for c in ("feature", "threshold", "gain", "left"):
        np.testing.assert_allclose(getattr(blocks, c), getattr(whole, c), atol=1e-9)
    assert len(whole.feature) > 1000
    order = rng.integers(0, 1 << 18, n).astype(np.int32)
    np.testing.assert_array_equal(forest._order(order, 1 << 18), np.argsort(order, kind="stable"))


def test_tables_of_more_rows_than_a_task_holds_go_by_queries(spark, monkeypatch):
    """Few features: the number of cells alone does not bound a task's memory."""
    rows, seen, plain = frame(spark, 300), [], forest._grown
    monkeypatch.setattr(forest, "LOCAL_ROWS", 100)
    monkeypatch.setattr(forest, "_grown", lambda rows, *more: seen.append(rows.groupBy("tree", "node").count().agg(F.max("count")).first()[0]) or plain(rows, *more))
    model = forest.fit(rows, ["a"], "y", "id", ntree=2, seed=1)
    assert len(model.trees) == 2 and min(len(t.feature) for t in model.trees) > 100
    assert seen and max(seen) <= 100
