"""Random forest (F2) as a ``pyspark.ml`` estimator, grown over blocks of binned rows.

Each tree draws its rows with replacement (Poisson counts by a keyed hash) and each node its features. A node of many rows
is split from sums of (rows, weight, weight of class 1) by (node, feature, bin): tasks add up their rows, the sums of a tree
meet in one task, which finds its cuts, and the driver sees these cuts only. Once a node has ``GROUP_ROWS`` rows at most, its
rows move, once, to one task that grows all that is below it. So a tree's deep levels cost neither a job each nor sums of
thousands of small nodes from every task. Where all rows of a class weigh the same, one count of both classes by cell gives
all three sums.

* a cut's gain is what it takes off the weighted Gini impurity; each side keeps at least ``least`` drawn rows;
* values on a cut go left, missing values (NaN) right;
* sums are whole numbers: no order of tasks and no rerun changes a bit of the result. Rows equal in all columns share
  their draws.
"""

from __future__ import annotations

import base64
import io
import math
import operator
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope import settings as S
from lendscope.operators.boosting import MOST_BINS, BoostedTrees, Layout, _mixed, _uniform, block_of
from lendscope.operators.walks import Walker, feature_rows
from lendscope.session import forget

#: Rows of a node, about, from which one task grows the rest of it; drawn rows of the trees that are grown together.
GROUP_ROWS = 2_000_000
DRAWN_ROWS = 200_000_000
#: Cumulative shares of Poisson counts with mean 1 (0 to 9 times).
POISSON = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(9)])
#: The same by the upper 16 bits of a row's hash; ``UNSETTLED`` where these leave it open.
UNSETTLED = 255
_LOW, _HIGH = (np.searchsorted(POISSON, np.arange(i, 2**16 + i) / 2.0**16, side="right") for i in (0, 1))
TIMES = np.where(_LOW == _HIGH, _LOW, UNSETTLED).astype(np.uint8)
#: Both classes' counts in one float: class 1 from this bit on.
CLASS_BITS = 26
BOTH = np.concatenate([np.arange(2.0 * POISSON.size), np.arange(2.0 * POISSON.size) * 2.0**CLASS_BITS])
#: A node as trees are grown: its tree and place (children of i: 2i + 1, 2i + 2), cut (feature -1: a leaf), weights and gain.
NODE = np.dtype([("tree", "<i4"), ("node", "<i8"), ("feature", "<i4"), ("bin", "<i4"), ("weight", "<i8"), ("ones", "<i8"), ("gain", "<f8")])


def taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[at]`` without a check of the places."""
    return np.take(values, at, mode="clip")


def times_drawn(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    z = _mixed(keys, seed + tree)
    times = taken(TIMES, (z >> np.uint64(48)).view(np.int64))
    open_ = np.flatnonzero(times == UNSETTLED)
    times[open_] = np.searchsorted(POISSON, z[open_].astype(np.float64) / 2.0**64, side="right")
    return times


def drawn_features(tree: int, nodes: np.ndarray, seed: int, d: int) -> np.ndarray:
    """The features that each node tries, (nodes, about the root of d), ascending."""
    keys = ((np.int64(tree) << 40) + nodes.astype(np.int64)[:, None]) * d + np.arange(d)
    return np.sort(np.argsort(_uniform(keys, seed + 2**20), 1, kind="stable")[:, :math.ceil(math.sqrt(d))], 1)


def added_values(times: np.ndarray, y: np.ndarray, weight: np.ndarray | None, by_class: tuple | None) -> list[np.ndarray]:
    """What is added up of drawn rows: both classes' counts as one number, or, without ``by_class`` (the one weight of
    each class), rows, weight and weight of class 1."""
    if by_class is not None:
        return [taken(BOTH, times + (2 * POISSON.size) * y)]
    return [times.astype(float), (times * weight).astype(float), (times * weight * y).astype(float)]


def counted(sums: list[np.ndarray], by_class: tuple | None) -> np.ndarray:
    """Whole numbers of sums of ``added_values``: of both classes, or the three sums. Those of several blocks can be added."""
    if by_class is None:
        return np.stack(sums).astype(np.int64)
    both = sums[0].astype(np.int64)
    return np.stack([both & (2**CLASS_BITS - 1), both >> CLASS_BITS])


def whole_sums(counts: np.ndarray, by_class: tuple | None) -> np.ndarray:
    """Rows, weight and weight of class 1 from ``counted``."""
    if by_class is None:
        return counts
    zero, one = counts
    return np.stack([zero + one, zero * by_class[0] + one * by_class[1], one * by_class[1]])


def node_sums(node: np.ndarray, rows: np.ndarray, tried: np.ndarray, bins: np.ndarray, values: list, width: int) -> list[np.ndarray]:
    """Sums of each of ``values`` by (node, tried feature, bin). ``rows``: places in ``bins`` (features, rows)."""
    nodes, k = tried.shape
    flat, n, first = bins.ravel(), bins.shape[1], node * width
    out = [np.empty((nodes, k, width)) for _ in values]
    for s in range(k):
        cell = taken(tried[:, s] * n, node)
        cell += rows
        cell = first + taken(flat, cell)
        for total, v in zip(out, values):
            total[:, s] = np.bincount(cell, v, nodes * width).reshape(nodes, width)
    return out


def best_cuts(sums: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Each node's best cut (sums by node, feature and bin of rows, weight, ones): place of the feature, bin, gain, sums on the left.

    Ties go to the first feature, then the lowest bin; a node without a cut gains minus infinity.
    """
    total = sums[:, :, :1].sum(3, keepdims=True)
    left = np.cumsum(sums[..., :-1], 3)
    right = total - left

    def impurity(s: np.ndarray) -> np.ndarray:
        return 2.0 * s[2] * (s[1] - s[2]) / np.maximum(s[1], 1)

    gain = (impurity(total) - impurity(left) - impurity(right)) / np.maximum(total[1], 1)
    gain = np.where((left[0] >= least) & (right[0] >= least), gain, -np.inf)
    n, cuts = np.arange(len(gain)), gain.shape[2]
    at = gain.reshape(len(gain), -1).argmax(1)
    s, b = np.divmod(at, cuts)
    return s, b, gain[n, s, b], left[:, n, s, b]


def unpacked(codes: np.ndarray, layout: Layout) -> np.ndarray:
    """Bins (features, rows) of a block's bytes (groups, rows); the last bin of a feature has its missing values."""
    out = np.empty((len(layout.widths), codes.shape[1]), np.uint8)
    for rest, group in zip(codes, layout.groups):
        for j in reversed(group[1:]):
            upper = rest // np.uint8(layout.widths[j])
            out[j] = rest - upper * np.uint8(layout.widths[j])
            rest = upper
        out[group[0]] = rest
    return out


def may_split(rows: np.ndarray, weight: np.ndarray, ones: np.ndarray, least: int) -> np.ndarray:
    return (rows >= 2 * least) & (ones > 0) & (ones < weight)


def children(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Values of left and right children in turn (last axis)."""
    return np.stack([left, right], -1).reshape(*left.shape[:-1], -1)


def subtree(tree: int, start: int, bins: np.ndarray, values: list, by_class: tuple | None, width: int, depth: int, least: int,
            seed: int) -> np.ndarray:
    """The nodes at and below ``start``, which holds the given rows (bins by feature, and their ``added_values``)."""
    d, n = bins.shape
    flat, rows, node = bins.ravel(), np.arange(n), np.zeros(n, np.int64)
    places, totals = np.array([start]), whole_sums(counted([np.array([v.sum()]) for v in values], by_class), by_class)
    level, found = int(math.log2(start + 1)), []
    open_ = may_split(*totals, least) & (level < depth)
    while True:
        out, wide = np.zeros(len(places), NODE), np.flatnonzero(open_)  # rows are those of the wide nodes
        out["tree"], out["node"], out["feature"], out["weight"], out["ones"] = tree, places, -1, totals[1], totals[2]
        found.append(out)
        if not len(wide):
            return np.concatenate(found)
        tried = drawn_features(tree, places[wide], seed, d)
        s, b, gain, left = best_cuts(whole_sums(counted(node_sums(node, rows, tried, bins, values, width), by_class), by_class), least)
        feature, cut = tried[np.arange(len(wide)), s], gain > 0
        cuts = wide[cut]
        out["feature"][cuts], out["bin"][cuts], out["gain"][cuts] = feature[cut], b[cut], gain[cut]
        places = children(2 * places[cuts] + 1, 2 * places[cuts] + 2)
        totals = children(left[:, cut], totals[:, cuts] - left[:, cut])
        level += 1
        open_ = may_split(*totals, least) & (level < depth)
        if open_.any():
            to = np.full((len(wide), 2), -1)
            to[cut] = np.where(open_, np.cumsum(open_) - 1, -1).reshape(-1, 2)
            cell = taken(feature * n, node)
            cell += rows
            node *= 2
            node += taken(flat, cell) > taken(b, node >> 1)
            node = taken(to.ravel(), node)
            held = np.flatnonzero(node >= 0)
            rows, node, values = rows[held], node[held], [v[held] for v in values]


def resting(cuts: tuple[np.ndarray, np.ndarray], bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The node at which each of ``rows`` (of ``bins``, by feature) rests under a tree's cuts so far (feature and bin by node)."""
    feature, cut = cuts
    n = bins.shape[1]
    flat, first, inner = bins.ravel(), np.where(feature >= 0, feature, 0).astype(np.int64) * n, feature >= 0
    at, open_, here = np.zeros(len(rows), np.int64), None, None  # open_: those still on their way, if not all
    if not inner[0]:
        return at
    here = at
    while len(here):
        cell = taken(first, here)
        cell += rows if open_ is None else rows[open_]
        right = taken(flat, cell) > taken(cut, here)
        here = 2 * here
        here += 1
        here += right
        more = taken(inner, here)
        if more.all():
            continue
        if open_ is None:
            at, open_ = here.copy(), np.flatnonzero(more)
        else:
            at[open_] = here
            open_ = open_[more]
        here = here[more]
    return at


class Grower:
    """The trees of one fit over a written table of blocks (as in ``boosting``)."""

    def __init__(self, table: DataFrame, edges: list[np.ndarray], weight: float, n: int, *, depth: int, least: int, seed: int):
        self.table, self.n, self.depth, self.least, self.seed = table, n, depth, least, seed
        self.layout, self.d = Layout.of(edges), len(edges)
        self.width = max(self.layout.widths)
        #: Whole steps of one unit of weight: sums of rows drawn 9 times each stay below 2^52.
        self.scale = 2.0 ** min(30, 48 - math.ceil(math.log2(weight + 2)))
        #: The weights of class 0 and 1 in steps, where all rows of a class have the same one.
        self.by_class: tuple | None = None

    def blocks(self):
        """The rows, kept on the executors by block: bytes, class, weight in steps and key. Finds ``by_class``."""
        layout, scale = self.layout, self.scale

        def opened(rows):
            for row in rows:
                codes, y, w, key, _ = block_of(row, len(layout.groups))
                yield codes, y > 0, np.rint(w * scale).astype(np.int64), key

        def weights(block) -> list[tuple]:
            _, y, w, _ = block
            return [(int(of.min()), int(of.max())) if len(of) else None for of in (w[~y], w[y])]

        def both(a: list, b: list) -> list:
            return [(min(x[0], z[0]), max(x[1], z[1])) if x and z else x or z for x, z in zip(a, b)]

        blocks = self.table.rdd.mapPartitions(opened).persist(StorageLevel.MEMORY_AND_DISK)
        ends = blocks.map(weights).fold([None, None], both)
        if all(e is None or e[0] == e[1] for e in ends):
            self.by_class = tuple(e[0] if e else 0 for e in ends)
        return blocks

    def _cuts(self, blocks, trees: dict, wide: dict[int, np.ndarray]) -> dict[int, tuple]:
        """For each tree the cuts of its ``wide`` nodes: features tried, and what ``best_cuts`` and the nodes' sums give."""
        layout, width, seed, least, d, by_class = self.layout, self.width, self.seed, self.least, self.d, self.by_class

        def sums(parts):
            held: dict[int, np.ndarray] = {}
            for codes, y, w, key in parts:
                bins = unpacked(codes, layout)
                for tree, nodes in wide.items():
                    times = times_drawn(key, tree, seed)
                    rows = np.flatnonzero(times > 0)
                    node = np.zeros(len(rows), np.int64)
                    if nodes[-1]:
                        place = np.full(2 * nodes[-1] + 3, -1)
                        place[nodes] = np.arange(len(nodes))
                        node = taken(place, resting(trees[tree], bins, rows))
                        here = np.flatnonzero(node >= 0)
                        rows, node = rows[here], node[here]
                    values = added_values(times[rows], y[rows], w[rows] if by_class is None else None, by_class)
                    found = counted(node_sums(node, rows, drawn_features(tree, nodes, seed, d), bins, values, width), by_class)
                    held[tree] = held[tree] + found if tree in held else found
            yield from held.items()

        def cut(item):
            tree, counts = item
            whole = whole_sums(counts, by_class)
            return tree, (drawn_features(tree, wide[tree], seed, d), *best_cuts(whole, least), whole[:, :, 0].sum(2))

        parts = max(1, min(len(wide), self.table.sparkSession.sparkContext.defaultParallelism))
        return dict(blocks.mapPartitions(sums).reduceByKey(operator.add, parts).map(cut).collect())

    def _top(self, blocks, numbers: range) -> tuple[dict, dict[int, np.ndarray], list[np.ndarray]]:
        """Split the nodes of many rows: the cuts of each tree, the nodes left to single tasks, and the finished nodes."""
        size = 2 ** (self.depth + 1) - 1
        trees = {t: (np.full(size, -1, np.int32), np.zeros(size, np.int32)) for t in numbers}
        small: dict[int, list] = {t: [] for t in numbers}
        wide: dict[int, np.ndarray] = {}
        for t in numbers:
            if self.n > GROUP_ROWS and self.depth:
                wide[t] = np.zeros(1, np.int64)
            else:
                small[t].append(np.zeros(1, np.int64))
        done, level = [], 0
        while wide:
            cuts = self._cuts(blocks, {t: tuple(a[:2**(level + 1) - 1] for a in trees[t]) for t in wide}, wide)
            level += 1
            for t, (tried, s, b, gain, left, total) in cuts.items():
                nodes = wide[t]
                feature = np.where(gain > 0, tried[np.arange(len(nodes)), s], -1)
                trees[t][0][nodes], trees[t][1][nodes] = feature, b
                out = np.zeros(len(nodes), NODE)
                out["tree"], out["node"], out["feature"], out["bin"] = t, nodes, feature, b
                out["weight"], out["ones"], out["gain"] = total[1], total[2], np.where(gain > 0, gain, 0.0)
                done.append(out)
                cut = gain > 0
                below = np.concatenate([2 * nodes[cut] + 1, 2 * nodes[cut] + 2])
                held = np.concatenate([left[:, cut], (total - left)[:, cut]], 1)
                order = np.argsort(below)
                below, held = below[order], held[:, order]
                more = may_split(*held, self.least) & (level < self.depth) & (held[0] > GROUP_ROWS)
                small[t].append(below[~more])
                wide[t] = below[more]
            wide = {t: nodes for t, nodes in wide.items() if len(nodes)}
        return trees, {t: np.sort(np.concatenate(a)) for t, a in small.items()}, done

    def grow(self, blocks, numbers: range) -> np.ndarray:
        """All nodes of some trees, grown together."""
        trees, small, done = self._top(blocks, numbers)
        layout, scale, seed, depth, least, width = self.layout, self.scale, self.seed, self.depth, self.least, self.width
        by_class, groups, context = self.by_class, len(layout.groups), self.table.sparkSession.sparkContext
        cuts = context.broadcast((trees, small))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops, ends = cuts.value
            for batch in batches:
                for row in batch.to_pylist():
                    codes, y, w, key, _ = block_of(row, groups)
                    bins, weight = unpacked(codes, layout), np.rint(w * scale).astype(np.int64)
                    for tree, nodes in ends.items():
                        times = times_drawn(key, tree, seed)
                        rows = np.flatnonzero(times > 0)
                        place = np.full(len(tops[tree][0]), len(nodes), np.uint16 if len(nodes) < 2**16 else np.int64)
                        place[nodes] = np.arange(len(nodes))
                        at = taken(place, resting(tops[tree], bins, rows))
                        order = np.argsort(at, kind="stable")
                        stops = np.cumsum(np.bincount(at, minlength=len(nodes) + 1)[:-1])
                        rows = rows[order][:stops[-1] if len(stops) else 0]
                        moved, drawn = codes[:, rows], 2 * times[rows] + (y[rows] > 0).astype(np.uint8)
                        weights = weight[rows] if by_class is None else None
                        parts = [(int(n), slice(a, b)) for n, a, b in zip(nodes, [0, *stops[:-1]], stops) if b > a]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([tree] * len(parts), pa.int32()), pa.array([n for n, _ in parts], pa.int64()),
                            pa.array([moved[:, r].tobytes() for _, r in parts], pa.binary()),
                            pa.array([drawn[r].tobytes() for _, r in parts], pa.binary()),
                            pa.array([None if weights is None else weights[r].tobytes() for _, r in parts], pa.binary())],
                            names=["tree", "node", "codes", "times", "weight"])

        def rest(key: tuple, rows: pa.Table) -> pa.Table:
            codes = np.concatenate([np.frombuffer(c, np.uint8).reshape(groups, -1) for c in rows["codes"].to_pylist()], 1)
            drawn = np.frombuffer(b"".join(rows["times"].to_pylist()), np.uint8)
            times, y = (drawn >> 1).astype(np.int64), drawn & 1
            weight = np.frombuffer(b"".join(rows["weight"].to_pylist()), np.int64) if by_class is None else None
            nodes = subtree(key[0].as_py(), key[1].as_py(), unpacked(codes, layout), added_values(times, y, weight, by_class), by_class,
                            width, depth, least, seed)
            return pa.table({"nodes": pa.array([nodes.tobytes()], pa.binary())})

        moved = self.table.mapInArrow(spread, "tree int, node bigint, codes binary, times binary, weight binary")
        grown = (moved.repartition(4 * context.defaultParallelism, "tree", "node").groupBy("tree", "node")
                 .applyInArrow(rest, "nodes binary").collect())  # the model's own nodes: bounded by trees and depth
        cuts.unpersist()
        return np.concatenate([np.zeros(0, NODE), *done, *[np.frombuffer(r["nodes"], NODE) for r in grown]])


class _ForestParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features; NaN is missing", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0 or 1", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight of a row", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "vector (of class 0, of class 1)", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "the likelier class", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    least = Param(Params._dummy(), "least", "least drawn rows of a child", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a feature, 254 at most", TypeConverters.toInt)

    def __init__(self, **given):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", weightCol="", probabilityCol="probability", predictionCol="prediction",
                         trees=S.FOREST_TREES, depth=S.FOREST_DEPTH, least=S.FOREST_MIN_LEAF, seed=S.RANDOM_STATE, bins=MOST_BINS)


class RandomForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``RandomForestModel``. Rows without a label raise; a weight column is optional; no rows give the even odds."""

    @keyword_only
    def __init__(self, **given):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RandomForestModel":
        get = self.getOrDefault
        table, edges, weight = BoostedTrees(**{n: get(n) for n in ("featuresCol", "labelCol", "weightCol", "bins")})._table(dataset)
        parts = [np.zeros(0, NODE)]
        scale, total = 1.0, (0, 0)
        if edges:
            length = F.length("y") / 8  # a block's rows
            n = int(table.agg(F.coalesce(F.sum(length), F.lit(0.0))).first()[0])
            run = Grower(table, edges, weight, n, **{p: get(p) for p in ("depth", "least", "seed")})
            blocks, scale = run.blocks(), run.scale
            together = max(1, DRAWN_ROWS // max(1, n))
            parts += [run.grow(blocks, range(t, min(t + together, get("trees")))) for t in range(0, get("trees"), together)]
            total = blocks.map(lambda b: np.array([b[2].sum(), (b[2] * b[1]).sum()])).fold(np.zeros(2, np.int64), operator.add)
            blocks.unpersist()
        forget(table)
        nodes = np.concatenate(parts)
        empty = np.setdiff1d(np.arange(get("trees")), nodes["tree"])  # trees that drew no row have the mean of all
        bare = np.zeros(len(empty), NODE)
        bare["tree"], bare["feature"], bare["weight"], bare["ones"] = empty, -1, total[0], total[1]
        model = RandomForestModel(nodes=pack(np.concatenate([nodes, bare]), edges, scale))
        return model._set(**{p.name: get(p.name) for p in _ForestParams().params})


def pack(nodes: np.ndarray, edges: list[np.ndarray], scale: float) -> str:
    """Trees as text: arrays by node (``feature`` -1 and ``left`` 0 at a leaf; the right child follows the left one)."""
    nodes = nodes[np.lexsort((nodes["node"], nodes["tree"]))]
    place = (nodes["tree"].astype(np.int64) << 40) + nodes["node"]
    inner = nodes["feature"] >= 0
    left = np.where(inner, np.searchsorted(place, (nodes["tree"].astype(np.int64) << 40) + 2 * nodes["node"] + 1), 0)
    flat = np.concatenate([*[np.append(e, math.inf) for e in edges], np.zeros(0)])
    first = np.cumsum([0, *[len(e) + 1 for e in edges]])
    threshold = np.full(len(nodes), math.inf)
    threshold[inner] = flat[first[nodes["feature"][inner]] + nodes["bin"][inner]]
    weight, ones = nodes["weight"] / scale, nodes["ones"] / scale
    value = np.where(weight > 0, ones / np.where(weight > 0, weight, 1.0), 0.5)
    # Importances: gains by weight, as shares within a tree, then over all trees.
    d, trees = len(edges), int(nodes["tree"].max(initial=-1)) + 1
    by_tree = np.zeros((trees, d))
    np.add.at(by_tree, (nodes["tree"][inner], nodes["feature"][inner]), (nodes["gain"] * weight)[inner])
    sums = by_tree.sum(1, keepdims=True)
    whole = (by_tree / np.where(sums > 0, sums, 1.0)).sum(0)
    out = io.BytesIO()
    np.savez_compressed(out, feature=nodes["feature"].astype(np.int32), threshold=threshold, left=left.astype(np.int32), value=value, cover=weight,
                        roots=np.flatnonzero(nodes["node"] == 0), importances=whole / whole.sum() if whole.sum() else whole)
    return base64.b64encode(out.getvalue()).decode()


@lru_cache(maxsize=4)
def unpack(text: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(base64.b64decode(text))) as found:
        return dict(found)


def walker(a: dict[str, np.ndarray]) -> Walker:
    inner = a["feature"] >= 0
    return Walker(a["feature"], a["threshold"], np.where(inner, a["left"], -1), np.where(inner, a["left"] + 1, -1), np.zeros(len(inner), bool), a["roots"])


def probabilities(of: Walker, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean over the trees of the shares of class 1 (``value``) in the leaves of each row (raw values)."""
    return of.summed(value, x) / len(of.trees)


class RandomForestModel(Model, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Mean of the trees' shares of class 1. Saved and loaded with the ML writer (the nodes are a parameter)."""

    nodes = Param(Params._dummy(), "nodes", "the trees' nodes as text", TypeConverters.toString)

    @keyword_only
    def __init__(self, **given):
        super().__init__()
        self._setDefault(nodes="")
        self._set(**self._input_kwargs)

    @property
    def arrays(self) -> dict[str, np.ndarray]:
        return unpack(self.getOrDefault("nodes"))

    @property
    def numFeatures(self) -> int:
        return len(self.arrays["importances"])

    @property
    def featureImportances(self) -> DenseVector:
        """Gain of a feature's splits by weight, as a share within each tree, then over all trees."""
        return Vectors.dense(self.arrays["importances"])

    def probability(self, features: Column) -> Column:
        """Probability of class 1, by Arrow batch."""
        shared = SparkSession.active().sparkContext.broadcast((walker(self.arrays), self.arrays["value"]))

        @F.pandas_udf("double")
        def of(x: pd.Series) -> pd.Series:
            return pd.Series(probabilities(*shared.value, feature_rows(x)))

        return of(vector_to_array(features))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn("_p", self.probability(F.col(self.getOrDefault("featuresCol"))))
        return (out.withColumn(self.getOrDefault("probabilityCol"), array_to_vector(F.array(F.lit(1.0) - F.col("_p"), F.col("_p"))))
                .withColumn(self.getOrDefault("predictionCol"), (F.col("_p") > 0.5).cast("double")).drop("_p"))
