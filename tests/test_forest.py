"""The random forest against a plain version on raw values, and its bounds: parts, groups and batches change nothing."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lendscope.operators import attribution as A
from lendscope.operators import forest as R
from lendscope.operators import models as M
from lendscope.operators.boosting import BoostedTrees
from lendscope.session import scratch_path

from test_boosting import assemble, table

SMALL = {"weightCol": "weight", "trees": 5, "depth": 4, "least": 3, "bins": 16}


def plain_forest(x, y, w, keys, edges, trees, depth, least, seed):
    """One node at a time: every cut of the tried features on raw values, rows repeated as often as they were drawn."""
    out = np.zeros(len(x))
    for t in range(trees):
        times = R.times_drawn(keys, t, seed)

        def grow(drawn, asked, node, level):
            weight, ones = (times * w)[drawn].sum(), (times * w * y)[drawn].sum()
            out[asked] += ones / weight / trees
            impurity = lambda r: 2 * (times * w * y)[r].sum() * (times * w * (1 - y))[r].sum() / max((times * w)[r].sum(), 1e-300)
            best = (1e-12, None)
            if level < depth:
                for j in R.drawn_features(t, np.array([node]), seed, x.shape[1])[0]:
                    for cut in [*edges[j], np.inf]:
                        left = x[:, j] <= cut  # a missing value is never below
                        a, b = drawn[left[drawn]], drawn[~left[drawn]]
                        if min(times[a].sum(), times[b].sum()) < least:
                            continue
                        gain = (impurity(drawn) - impurity(a) - impurity(b)) / weight
                        if gain > best[0] + 1e-12:
                            best = (gain, (left, a, b))
            if best[1] is not None:
                out[asked] -= ones / weight / trees
                left, a, b = best[1]
                grow(a, asked[left[asked]], 2 * node + 1, level + 1)
                grow(b, asked[~left[asked]], 2 * node + 2, level + 1)

        grow(np.flatnonzero(times), np.arange(len(x)), 0, 0)
    return out


def scores(model, data):
    return [r.p for r in model.transform(data).orderBy("id").select(vector_to_array("probability")[1].alias("p")).collect()]


@pytest.mark.parametrize("missing", [False, True])
def test_forest_equals_plain_forest_however_it_is_cut(spark, monkeypatch, missing):
    df, x, y, w = table(spark, missing=missing)
    data = assemble().transform(df)
    estimator = R.RandomForest(**SMALL)
    blocks, edges, _ = BoostedTrees(weightCol="weight", bins=16)._table(data)
    plain = [F.col(c) for c in df.columns]
    keys = np.array([r.k for r in data.orderBy("id").select(F.xxhash64(vector_to_array("features"), *plain).alias("k")).collect()])
    model = estimator.fit(data)
    want = plain_forest(x, y, w, keys, edges, 5, 4, 3, estimator.getOrDefault("seed"))
    assert np.allclose(scores(model, data), want, atol=1e-9)
    assert len(set(np.round(want, 6))) > 10 and model.featureImportances.toArray().sum() == pytest.approx(1.0)
    # Nodes split from summed bins, trees in batches and other partitions: bit by bit the same trees.
    monkeypatch.setattr(R, "GROUP_ROWS", 60)
    monkeypatch.setattr(R, "DRAWN_ROWS", 1_000)
    monkeypatch.setattr("lendscope.operators.boosting.LEAST_ROWS_A_TASK", 100)
    assert estimator.fit(data.repartition(5)).getOrDefault("nodes") == model.getOrDefault("nodes")


def test_forest_saved_and_explained(spark):
    df, *_ = table(spark)
    pipeline = Pipeline(stages=[assemble(), R.RandomForest(**SMALL)]).fit(df)
    path = scratch_path(spark, "test_forest/model")
    pipeline.write().overwrite().save(path)
    assert scores(PipelineModel.load(path), df) == scores(pipeline, df)
    explain = A.explainer(pipeline, ["a", "b", "c", "d"])
    rows = A.with_contributions(df, pipeline, explain).select(vector_to_array("probability")[1].alias("p"), "contributions").collect()
    assert explain.scale == "probability" and all(sum(r.contributions) + explain.base == pytest.approx(r.p, abs=1e-9) for r in rows)


@pytest.mark.parametrize("rows, want", [([], 0.5), ([(0.0, 1.0)], 1.0), ([(float("nan"), 0.0)] * 3, 0.0)])
def test_forest_of_few_rows(spark, rows, want):
    data = spark.createDataFrame([(i, *r, 1.0) for i, r in enumerate(rows)], "id long, a double, label double, weight double")
    data = data.selectExpr("id", "a", "a b", "a c", "a d", "label", "weight")
    model = Pipeline(stages=[assemble(), R.RandomForest(**SMALL)]).fit(data)
    asked = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double")
    assert scores(model, asked) == [pytest.approx(want)] if rows else True


def test_candidate_keeps_the_reference_sizes():
    forest = M.random_forest()
    assert [forest.getOrDefault(p) for p in ("trees", "depth", "least")] == [200, 12, 5]


def test_forest_of_uneven_weights_and_counts_by_class(spark, monkeypatch):
    """Rows of a class that weigh alike are counted once a cell; other weights take three sums, to the same trees."""
    df, x, y, w = table(spark, missing=True)
    estimator, plain = R.RandomForest(**SMALL), [F.col(c) for c in df.columns]
    uneven = df.withColumn("weight", F.col("weight") + F.col("id") % 3)
    for data, weights, numbers in ((df, w, 1), (uneven, w + np.arange(len(w)) % 3, 3)):
        data = assemble().transform(data)
        blocks, edges, _ = BoostedTrees(weightCol="weight", bins=16)._table(data)
        keys = np.array([r.k for r in data.orderBy("id").select(F.xxhash64(vector_to_array("features"), *plain).alias("k")).collect()])
        run = R.Grower(blocks, edges, float(weights.sum()), len(x), depth=4, least=3, seed=42)
        rows = run.blocks()
        by_class = run.by_class
        parts = rows.map(lambda b: len(R.added_values(R.times_drawn(b[3], 0, 42), b[1], b[2], by_class))).collect()
        assert set(parts) == {numbers} and (by_class is None) == (numbers == 3)
        monkeypatch.setattr(R, "GROUP_ROWS", 60)
        cut = estimator.fit(data).getOrDefault("nodes")
        monkeypatch.setattr(R, "GROUP_ROWS", 10**6)
        model = estimator.fit(data)
        assert model.getOrDefault("nodes") == cut
        assert np.allclose(scores(model, data), plain_forest(x, y, weights, keys, edges, 5, 4, 3, 42), atol=1e-9)


def test_draws_are_those_of_the_uniform_numbers():
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 200_000)
    for tree in range(3):
        assert (R.times_drawn(keys, tree, 42) == np.searchsorted(R.POISSON, R._uniform(keys, 42 + tree), side="right")).all()


def test_bins_are_unpacked_from_bytes():
    rng = np.random.default_rng(2)
    layout = R.Layout.of([np.arange(n) for n in (254, 1, 60, 1, 1, 5, 0, 1, 9)])
    bins = np.stack([rng.integers(0, n, 500) for n in layout.widths], 1)
    assert any(len(g) > 2 for g in layout.groups)
    assert (R.unpacked(np.ascontiguousarray(layout.codes(bins, 999).T), layout) == bins.T).all()
