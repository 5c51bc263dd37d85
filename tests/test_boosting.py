"""Boosted trees, their contributions and the batched K-Means against plain versions."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lendscope.operators import attribution as A
from lendscope.operators import boosting as B
from lendscope.operators import kmeans as KM
from lendscope.session import scratch_path


def table(spark, n=500, seed=3, missing=False):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.random(n), rng.integers(0, 2, n).astype(float)])
    y = (x[:, 0] + 0.5 * x[:, 1] - 2 * x[:, 2] * x[:, 3] + rng.normal(size=n) * 0.3 > 0.8).astype(float)
    w = np.where(y > 0, 2.5, 1.0)
    if missing:
        x[rng.random(n) < 0.3, 0] = np.nan
    rows = [(i, *map(float, r), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label double, weight double")
    return df, x, y, w


def assemble():
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features", handleInvalid="keep")


def plain_rounds(x, y, w, edges, rounds, depth, rate, penalty, least):
    """One row at a time in numpy: every cut of every feature tried on raw values, no bins, no fixed points."""
    margin, losses, trees = np.zeros(len(x)), [], []

    def grow(rows, g, h, level):
        total = g[rows].sum() ** 2 / (h[rows].sum() + penalty)
        best = (1e-12, None)
        if level < depth:
            for j, cuts in enumerate(edges):
                gone = np.isnan(x[rows, j])
                for cut in [*cuts, np.inf]:
                    for to_left in (False, True):
                        left = np.where(gone, to_left, x[rows, j] <= cut)
                        a, b = rows[left], rows[~left]
                        if h[a].sum() < least or h[b].sum() < least:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + penalty) + g[b].sum() ** 2 / (h[b].sum() + penalty) - total
                        if gain > best[0] + 1e-9 * abs(best[0]):
                            best = (gain, (j, cut, to_left, a, b))
        if best[1] is None:
            return {rows_: -rate * g[rows].sum() / (h[rows].sum() + penalty) for rows_ in rows}
        return {**grow(best[1][3], g, h, level + 1), **grow(best[1][4], g, h, level + 1)}

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        losses.append(float((w * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum()))
        leaves = grow(np.arange(len(x)), w * (p - y), w * p * (1 - p), 0)
        margin = margin + np.array([leaves[i] for i in range(len(x))])
    losses.append(float((w * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum()))
    return margin, losses


@pytest.mark.parametrize("missing", [False, True])
def test_booster_equals_plain_booster(spark, missing):
    df, x, y, w = table(spark, missing=missing)
    est = B.BoostedTrees(weightCol="weight", rounds=4, depth=3, rate=0.3, rows=1.0, columns=1.0, bins=16)
    data = assemble().transform(df)
    _, edges, _ = est._table(data)
    model = est.fit(data)
    margin, losses = plain_rounds(x, y, w, edges, 4, 3, 0.3, 1.0, 1.0)
    got = model.transform(data).withColumn("m", model.margin(F.col("features"))).orderBy("id").select("m", F.col("probability")).collect()
    assert np.allclose([r.m for r in got], margin, atol=1e-6)
    assert np.allclose([r.probability[1] for r in got], 1 / (1 + np.exp(-margin)), atol=1e-6)
    assert np.allclose(model.training_loss, losses, rtol=1e-6)
    assert losses[-1] < losses[0]


def test_booster_is_alike_in_every_partitioning_and_saved(spark):
    df, *_ = table(spark, missing=True)
    est = B.BoostedTrees(weightCol="weight", rounds=3, depth=3)
    one, many = (est.fit(assemble().transform(df.repartition(n))) for n in (1, 7))
    assert one.getOrDefault("trees") == many.getOrDefault("trees") and one.training_loss == many.training_loss
    assert est.copy({est.seed: 5}).fit(assemble().transform(df)).getOrDefault("trees") != one.getOrDefault("trees")
    path = scratch_path(spark, "test_models/boosted")
    PipelineModel([assemble(), one]).write().overwrite().save(path)
    again = PipelineModel.load(path).transform(df).select("id", F.col("probability").alias("p"), "prediction")
    assert sorted(again.collect()) == sorted(one.transform(assemble().transform(df)).select("id", F.col("probability").alias("p"), "prediction").collect())
    assert abs(sum(one.featureImportances) - 1) < 1e-9


def test_booster_edges(spark):
    df, *_ = table(spark, 40)
    with pytest.raises(ValueError, match="label"):
        B.BoostedTrees().fit(assemble().transform(df.withColumn("label", F.lit(2.0))))
    none = B.BoostedTrees(rounds=2).fit(assemble().transform(df.limit(0)))
    assert {r.probability[1] for r in none.transform(assemble().transform(df)).collect()} == {0.5}
    flat = B.BoostedTrees(rounds=2, depth=2, weightCol="weight").fit(assemble().transform(df.withColumns({c: F.lit(1.0) for c in "abcd"})))
    assert all((t.feature < 0).all() for t in flat.forest)


def brute_paths(nodes, x):
    """Contributions by listing every root-to-leaf path of every tree and taking those that the row satisfies."""
    out = np.zeros((len(x), nodes.n_features))

    def paths(at, before):
        if nodes.left[at] < 0:
            yield before, at
            return
        yield from paths(nodes.left[at], [*before, (at, True, nodes.left[at])])
        yield from paths(nodes.right[at], [*before, (at, False, nodes.right[at])])

    for i, row in enumerate(x):
        for root in nodes.roots:
            taken = []
            for steps, leaf in paths(root, []):
                def goes_left(n):
                    v = row[nodes.feature[n]]
                    return bool(nodes.missing_left[n]) if np.isnan(v) else v <= nodes.threshold[n]
                if all(goes_left(n) == left for n, left, _ in steps):
                    taken.append((steps, leaf))
            assert len(taken) == 1
            for n, _, to in taken[0][0]:
                out[i, nodes.feature[n]] += nodes.value[to] - nodes.value[n]
    return out


def test_contributions_sum_to_the_prediction_and_equal_all_paths(spark):
    df, x, *_ = table(spark, 200, missing=True)
    filled = df.fillna(0.0, ["a"])
    names = ["a", "b", "c", "d"]
    boosted = Pipeline(stages=[assemble(), B.BoostedTrees(weightCol="weight", rounds=3, depth=3, rate=0.3)]).fit(df)
    forest = Pipeline(stages=[assemble(), RandomForestClassifier(weightCol="weight", numTrees=5, maxDepth=3, seed=1)]).fit(filled)
    linear = Pipeline(stages=[assemble(), LogisticRegression(weightCol="weight", regParam=0.01)]).fit(filled)
    for model, data in ((boosted, df), (forest, filled), (linear, filled)):
        means = [r for r in data.agg(*[F.avg(c) for c in names]).first()]
        explain = A.explainer(model, names, means)
        rows = A.with_contributions(data, model, explain).orderBy("id").select("contributions", F.col("probability").alias("p")).collect()
        got = np.array([r.contributions for r in rows])
        p = np.array([r.p[1] for r in rows])
        want = np.log(p / (1 - p)) if explain.scale == "log-odds" else p
        assert np.allclose(got.sum(1) + explain.base, want, atol=1e-9)
        if model is not linear:
            nodes = A.boosted_nodes(model.stages[-1]) if model is boosted else A.forest_nodes(model.stages[-1])
            values = np.array([list(r) for r in data.orderBy("id").select(*names).collect()], float)
            assert np.allclose(got, brute_paths(nodes, values), atol=1e-12)
    explain = A.explainer(boosted, names)
    scored = A.with_contributions(df, boosted, explain)
    top = A.top_rows(scored, explain, ["id"], top_n=2).collect()
    long = {(r.id, r.raw_feature): r.contribution for r in A.contribution_rows(scored, explain, ["id"]).collect()}
    assert len(long) == 200 * 4
    for r in top:
        rivals = sorted((c for (i, _), c in long.items() if i == r.id and (c > 0) == (r.direction == "risk")), key=abs, reverse=True)
        assert abs(abs(r.contribution) - abs(rivals[r["rank"] - 1])) < 1e-4
    texts = scored.withColumns(A.factor_texts(explain, 2)).select("id", "risk_factors").collect()
    for r in texts:
        assert r.risk_factors == ", ".join(t.feature for t in sorted((t for t in top if t.id == r.id and t.direction == "risk"), key=lambda t: t["rank"]))


def plain_lloyd(x, centres, tol, most):
    """K-Means from given centres, one cluster at a time."""
    for _ in range(most):
        near = np.array([[((r - c) ** 2).sum() for c in centres] for r in x]).argmin(1)
        moved = np.array([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(len(centres))])
        shift, centres = ((moved - centres) ** 2).sum(), moved
        if shift <= tol:
            break
    return centres, sum(((r - centres) ** 2).sum(1).min() for r in x)


def test_batched_kmeans_equals_single_fits(spark):
    df, x, *_ = table(spark, 300)
    vecs = assemble().transform(df).select("id", "features")
    sample = KM.hashed_sample(vecs, 100, 1)
    made = [KM.seeds(sample, 4, (1, s)) for s in range(3)]
    fits = KM.lloyd(vecs.repartition(5), [KM.Fit(k, s, made[s][:k].copy()) for k in (2, 3, 4) for s in range(3)], 1e-4, 50)
    for f in fits:
        centres, cost = plain_lloyd(x, made[f.start][:f.k], 1e-4, 50)
        assert np.allclose(f.centres, centres, atol=1e-6) and f.cost == pytest.approx(cost, rel=1e-6)
    best = KM.best_fits(vecs, [2, 3, 4], 4)
    assert best[4].cost < best[3].cost < best[2].cost
    again = KM.best_fits(vecs.repartition(3), [2, 3, 4], 4)
    assert all((best[k].centres == again[k].centres).all() and best[k].cost == again[k].cost for k in best)
    model = KM.NearestCentre.of(best[3])
    path = scratch_path(spark, "test_models/centres")
    model.write().overwrite().save(path)
    got = [r.segment for r in KM.NearestCentre.load(path).transform(vecs).orderBy("id").collect()]
    assert got == KM.distances(x, best[3].centres).argmin(1).tolist()


def test_sample_silhouette_equals_brute_force(spark):
    df, x, *_ = table(spark, 700)
    vecs = assemble().transform(df).select("id", "features")
    fits = KM.best_fits(vecs, [2, 4], 2)
    sample = KM.hashed_sample(vecs, 500, 42)
    assert len(sample) == 500 and (sample == KM.hashed_sample(vecs.repartition(9), 500, 42)).all()
    got = KM.sample_silhouettes(vecs, fits, rows=500)
    for k, f in fits.items():
        labels = [int(np.argmin([((r - c) ** 2).sum() for c in f.centres])) for r in sample]
        scores = []
        for i, r in enumerate(sample):
            d = np.sqrt(((sample - r) ** 2).sum(1))
            mean = {c: np.mean([d[j] for j in range(500) if labels[j] == c and j != i]) for c in set(labels) if c != labels[i] or labels.count(c) > 1}
            a = mean.get(labels[i])
            b = min(v for c, v in mean.items() if c != labels[i])
            scores.append(0.0 if a is None else (b - a) / max(a, b))
        assert got[k] == pytest.approx(np.mean(scores), abs=1e-9)
    lone = np.array([[0.0], [1.0], [1.5]])
    assert KM.silhouettes_of(lone, np.array([0, 1, 1]), slice(0, 3))[0] == 0.0
    assert (KM.silhouettes_of(lone, np.array([0, 0, 0]), slice(0, 3)) == 0).all()


def test_blocks_walk_and_sum_like_single_rows(spark):
    df, x, *_ = table(spark, 400, missing=True)
    est = B.BoostedTrees(weightCol="weight", depth=3, rate=0.3, columns=1.0, bins=9)
    data = assemble().transform(df.repartition(3))
    run = est.booster(data)
    assert run.table.count() <= 8 and len(run.layout.groups) < run.d  # rows lie in blocks, narrow features share a byte
    tree = run.round()
    codes = run.layout.codes(B.binned(x, run.edges, run.missing), run.missing)
    at = B.walked(run.layout.steps(tree), np.ascontiguousarray(codes.T), 3)
    assert np.allclose(tree.value[at], tree.margins(x))
    counted = []
    level = run._level
    run._level = lambda blocks, tree, depth, columns, nodes: counted.append((depth, len(nodes))) or level(blocks, tree, depth, columns, nodes)
    run.round()
    assert counted == [(0, 1), (1, 1), (2, 2)]  # one child of each split node
    blocks = run._open(2)
    tree, columns = run.trees[1], np.arange(run.d)
    parts = [level(blocks, tree, 2, columns, np.array([n]))[0] for n in range(4)]
    assert (np.concatenate(parts, 1) == level(blocks, tree, 2, columns, np.arange(4))[0]).all()
    assert (sum(parts) == level(blocks, tree, 0, columns, np.arange(1))[0]).all()
    big = np.array([2**60, 3, -(2**59), 2**60 + 1], np.int64)
    assert B.summed(np.array([0, 0, 1, 2]), big, 4).tolist() == [2**60 + 3, -(2**59), 2**60 + 1, 0]
    assert B.summed(np.array([2, 0, 2]), np.array([5, -7, 6], np.int64), 3).tolist() == [-7, 0, 11]


def test_kmeans_sums_of_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(50, 3)), np.zeros((7, 3))])
    twice = np.array([[[0.0, 0, 0], [0, 0, 0], [9, 9, 9]], [[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]])
    whole = rng.integers(-2**30, 2**30, (57, 2)).astype(float)
    (added, near), = KM.sums_of(x, whole, [twice])
    for f in range(2):
        far = np.array([((x - c) ** 2).sum(1) for c in twice[f]]).T
        at = far.argmin(1)  # the first among equals
        assert np.allclose(near[f], far.min(1))
        assert all((added[f, c] == whole[at == c].sum(0)).all() for c in range(3))
    df, *_ = table(spark, 300)
    blocks = KM.blocked(assemble().transform(df.coalesce(1)))
    assert blocks.agg(F.sum("n")).first()[0] == 300 and blocks.count() < 10
    assert KM.lloyd(assemble().transform(df.limit(0)), [KM.Fit(2, 0, np.zeros((2, 4)))], 1e-4, 5)[0].cost == 0.0


def test_margins_are_kept_between_rounds_and_given_up(spark, monkeypatch):
    """However often margins are kept anew or written, the trees are the same; the table is laid out for the executors once."""
    import os

    df, *_ = table(spark, missing=True)
    data = assemble().transform(df)
    est = B.BoostedTrees(weightCol="weight", depth=2, rate=0.3)
    found = []
    for keep, checkpoint in ((5, 50), (2, 4), (1, 1)):
        monkeypatch.setattr(B, "KEEP_ROUNDS", keep)
        monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", checkpoint)
        run, kept, files = est.booster(data), set(), set()
        for _ in range(8):
            run.round()
            kept.add(run.kept.id())
            files.add(run.file)
        assert len(kept) <= 1 + 8 // keep and (len(files - {None}) >= 2) == (checkpoint < 8)
        found.append((B.pack(run.trees), [*run.losses, run.final_loss()]))
        paths = [f.removeprefix("file:") for f in files - {None}]
        run.close()
        assert not any(os.path.exists(p) for p in paths) and run.kept is None
    assert found[0] == found[1] == found[2]


def test_sums_of_whole_floats_are_exact():
    big = np.array([2.0**60, 3.0, -(2.0**59), 2.0**53 + 2], float)
    assert not B.below_53_bits(big) and B.below_53_bits(np.array([2.0**40, -5.0]))
    assert B.summed(np.array([0, 0, 1, 2]), big, 4).tolist() == [2**60 + 3, -(2**59), 2**53 + 2, 0]
