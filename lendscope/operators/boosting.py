"""Second-order boosted trees (F3) as an ``pyspark.ml`` estimator.

Every round fits one tree to the gradient g = w (p - y) and the Hessian h = w p (1 - p) of the logistic loss. Feature
values are binned once and written as blocks of rows (matrices of bytes; features of few bins share a byte), which the
executors keep with the running margins. A round computes g and h of its rows once and keeps them too; a level of its tree
is found from sums of g and h by
(node, feature, bin), which each task adds up over its own rows. So a level moves at most nodes x features x bins cells a
task, however many rows there are, and the driver sees these cells, never a row. Of two children only the one with the
smaller h is counted; the other is what its parent has left.

* a split gains GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda), a leaf weighs -G / (H + lambda);
* rows with a missing value (NaN) go to the side that gains more, which the split keeps;
* each tree draws its rows by a keyed hash and its columns by a seed;
* sums are added as whole numbers (a fixed point, fine enough for the total weight): no order of tasks, and no rerun
  after a lost executor, changes a bit of the result.
"""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

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
from pyspark.sql.types import MapType, UserDefinedType, VariantType

from lendscope import settings as S
from lendscope.operators.walks import Walker, feature_rows
from lendscope.session import added_up, ensure_checkpoint_dir, forget, remove, written

#: Bins of a feature (missing values have one more), the rounds after which running margins are kept anew, and those after
#: which they go to the shared folder too: a lost executor's rows are made again from there.
MOST_BINS = 64
KEEP_ROUNDS = 5
CHECKPOINT_ROUNDS = 50
#: Rows of a block at most, and the least and most rows that one task works on, about: the binned table has as many parts
#: as the cluster has cores between these bounds. A task holds one block at a time.
BLOCK_ROWS = 32_768
LEAST_ROWS_A_TASK = 20_000
MOST_ROWS_A_TASK = 4_000_000


@dataclass
class Tree:
    """One tree as node arrays in heap order: the children of node i are 2i + 1 and 2i + 2.

    ``feature`` is -1 at a leaf (and where no node is). ``value`` is what the node would add to the margin as a leaf,
    ``cover`` the sum of h, ``gain`` that of its split. A row goes left if its value is at most ``threshold``, or, when it is
    missing, if ``missing_left``.
    """

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    @property
    def depth(self) -> int:
        return int(math.log2(len(self.feature) + 1)) - 1

    def walk(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: the rows that move on, the nodes they leave, the nodes they reach. ``x`` has raw values."""
        rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            inner = self.feature[at] >= 0
            rows, at = rows[inner], at[inner]
            if not len(rows):
                return
            v = x[rows, self.feature[at]]
            left = np.where(np.isnan(v), self.missing_left[at], v <= self.threshold[at])
            to = 2 * at + np.where(left, 1, 2)
            yield rows, at, to
            at = to

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.value[0])
        for rows, _, to in self.walk(x):
            out[rows] = self.value[to]
        return out


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-m))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each 64-bit key, from the seed: two rounds of multiply and shift."""
    z = keys.astype(np.uint64)
    z += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(shift)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    return z


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each 64-bit key, from the seed."""
    return _mixed(keys, seed).astype(np.float64) / 2.0**64


def split_gains(g: np.ndarray, h: np.ndarray, least: float, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain of every split, and g and h of its left child: (nodes, features, bins, 2), missing values right or left.

    ``g``, ``h``: (nodes, features, bins + 1), the last bin being the missing values. A split that leaves a child less
    than ``least`` of h gains minus infinity. The last cut parts the missing values from all others.
    """
    total_g, total_h = g[:, :1].sum(2)[:, :, None, None], h[:, :1].sum(2)[:, :, None, None]
    left_g, left_h = (np.stack([np.cumsum(a[:, :, :-1], 2), np.cumsum(a[:, :, :-1], 2) + a[:, :, -1:]], -1) for a in (g, h))
    right_g, right_h = total_g - left_g, total_h - left_h
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - total_g**2 / (total_h + penalty)
    return np.where((left_h >= least) & (right_h >= least), gain, -np.inf), left_g, left_h


def best_splits(g: np.ndarray, h: np.ndarray, least: float, penalty: float) -> tuple[np.ndarray, ...]:
    """Best split of each node (sums as in ``split_gains``): feature, bin, missing_left, gain, and g, h of the left child.

    Ties go to the first feature, then the lowest bin, then to missing values on the right.
    """
    gain, left_g, left_h = split_gains(g, h, least, penalty)
    nodes, _, cuts, _ = gain.shape
    flat = gain.reshape(nodes, -1)
    # Gains closer than the sums' own error are ties.
    top = flat.max(1, keepdims=True)
    at = np.argmax(flat >= top - 1e-9 * np.abs(np.where(np.isfinite(top), top, 0.0)), 1)
    f, rest = np.divmod(at, cuts * 2)
    b, side = np.divmod(rest, 2)
    n = np.arange(nodes)
    return f, b, side == 1, flat[n, at], left_g[n, f, b, side], left_h[n, f, b, side]


def bin_edges(rows: DataFrame, n_features: int, most: int = MOST_BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins: distinct marks at even ranks and the least value (``rows`` has x). One aggregate.

    Missing values are apart. The largest value is no edge: what is above the last edge is the last bin. The sketch is exact for a few thousand
    values and within 1 / 10,000 of the rank beyond.
    """
    marks = F.array(*[F.lit(i / most) for i in range(1, most)])
    values = [F.nanvl(F.col("x")[j], F.lit(None).cast("double")) for j in range(n_features)]
    row = rows.agg(*[F.percentile_approx(v, marks, F.lit(10_000)).alias(f"m{j}") for j, v in enumerate(values)],
                   *[F.min(v).alias(f"b{j}") for j, v in enumerate(values)], *[F.max(v).alias(f"t{j}") for j, v in enumerate(values)]).first()
    return [np.array(sorted({v for v in (*row[f"m{j}"], row[f"b{j}"]) if v < row[f"t{j}"]} if row[f"m{j}"] else ()), float) for j in range(n_features)]


def binned(x: np.ndarray, edges: list[np.ndarray], missing: int) -> np.ndarray:
    """Bins of raw values: the number of edges below the value; ``missing`` for NaN."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), missing, np.searchsorted(e, x[:, j], side="left"))
    return out


@dataclass
class Layout:
    """How bins are laid into bytes: each byte holds one feature, or several of few bins as digits of a mixed base.

    A feature's digit is its bin (0 to the number of edges), or the last one for a missing value.
    """

    widths: list[int]
    groups: list[list[int]]

    @staticmethod
    def of(edges: list[np.ndarray]) -> "Layout":
        widths, groups = [len(e) + 2 for e in edges], []
        for j in sorted(range(len(widths)), key=lambda j: (-widths[j], j)):
            for g in groups:
                if math.prod(widths[i] for i in g) * widths[j] <= 256:
                    g.append(j)
                    break
            else:
                groups.append([j])
        return Layout(widths, groups)

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """For each feature its byte and the worth of its digit there."""
        at, worth = np.zeros(len(self.widths), np.int64), np.ones(len(self.widths), np.int64)
        for i, g in enumerate(self.groups):
            for n, j in enumerate(g):
                at[j], worth[j] = i, math.prod(self.widths[k] for k in g[n + 1:])
        return at, worth

    def codes(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """Bytes (rows, groups) of bins (rows, features)."""
        out = np.zeros((len(bins), len(self.groups)), np.int64)
        for i, g in enumerate(self.groups):
            for j in g:
                out[:, i] = out[:, i] * self.widths[j] + np.where(bins[:, j] == missing, self.widths[j] - 1, bins[:, j])
        return out.astype(np.uint8)

    def steps(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """For each node the byte that it reads, and, flat by (node, byte), the node that comes next (a leaf stays)."""
        at, worth = self.place()
        n = len(tree.feature)
        inner = np.flatnonzero(tree.feature >= 0)
        f = tree.feature[inner]
        reads, to = np.zeros(n, np.int64), np.repeat(np.arange(n), 256).reshape(n, 256)
        last = np.array(self.widths, np.int64)[f] - 1
        digit = np.arange(256) // worth[f][:, None] % (last + 1)[:, None]
        left = np.where(digit == last[:, None], tree.missing_left[inner][:, None], digit <= tree.bin[inner][:, None])
        reads[inner], to[inner] = at[f], 2 * inner[:, None] + np.where(left, 1, 2)
        return reads, to.ravel()


def walked(steps: tuple[np.ndarray, np.ndarray], codes: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row of a block (groups, rows) after ``levels`` levels of a tree (its ``Layout.steps``), or its leaf above."""
    n = codes.shape[1]
    reads, to = steps[0] * n, steps[1]
    flat, rows, at = codes.ravel(), np.arange(n), np.zeros(n, np.int64)
    for _ in range(levels):
        cell = reads[at]
        cell += rows
        at <<= 8
        at += flat[cell]
        at = to[at]
    return at


def below_53_bits(values: np.ndarray) -> bool:
    """Whether all sums of some of these whole numbers are exact as floats."""
    return np.abs(values).sum(dtype=float) < 2.0**52


def summed(cell: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    """Whole sums of whole numbers by cell, exact: as floats where they stay below 2^53."""
    if below_53_bits(values):
        return np.bincount(cell, values, cells).astype(np.int64)
    out = np.zeros(cells, np.int64)
    np.add.at(out, cell, values.astype(np.int64))
    return out


def moved(margin: np.ndarray, trees: list[tuple], codes: np.ndarray, depth: int) -> np.ndarray:
    """A block's margins with some trees (values and ``Layout.steps``) added, in turn."""
    for value, steps in trees:
        margin = margin + value[walked(steps, codes, depth)]
    return margin


def block_of(row, groups: int) -> tuple[np.ndarray, ...]:
    """The arrays of a written block: bytes (groups, rows), y, w, key and margin by row."""
    y, w, margin = (np.frombuffer(row[c], float) for c in ("y", "w", "margin"))
    return np.frombuffer(row["codes"], np.uint8).reshape(groups, len(y)), y, w, np.frombuffer(row["key"], np.int64), margin


class Booster:
    """The rounds of one fit over a written table of blocks (codes, y, w, key, margin)."""

    def __init__(self, table: DataFrame, edges: list[np.ndarray], weight: float, *, depth: int, rate: float, rows: float,
                 columns: float, penalty: float, least: float, seed: int):
        self.table, self.edges, self.depth, self.rate, self.rows = table, edges, depth, rate, rows
        self.penalty, self.least, self.seed = penalty, least, seed
        self.d = len(edges)
        self.layout = Layout.of(edges)
        self.missing = max((len(e) for e in edges), default=0) + 1  # bins are 0 to the number of edges
        self.n_columns = max(1, int(columns * self.d))
        #: Whole steps of one unit of weight: sums stay below 2^62.
        self.scale = 2.0 ** min(30, 61 - math.ceil(math.log2(weight + 2)))
        self.recent: list[Tree] = []
        self.kept = None  # the blocks on the executors, with the margins of all trees but the recent ones
        self.file = None  # the last checkpoint of them
        self.trees: list[Tree] = []
        self.losses: list[float] = []

    def _kept(self):
        groups = len(self.layout.groups)
        if self.kept is None:
            def laid(row) -> tuple:
                codes, y, *rest = block_of(row, groups)
                return codes, y > 0, *rest

            self.kept = self.table.rdd.map(laid).persist(StorageLevel.MEMORY_AND_DISK)
        return self.kept

    def _open(self, number: int):
        """The blocks of a round, kept on the executors: codes, g and h of the drawn rows, and the loss of all rows so far."""
        recent, layout, scale, share, seed, depth = self.recent, self.layout, self.scale, self.rows, self.seed, self.depth

        def opened(blocks):
            trees = [(t.value, layout.steps(t)) for t in recent]
            for codes, y, w, key, margin in blocks:
                margin = moved(margin, trees, codes, depth)
                loss = int(np.rint(w * np.logaddexp(0.0, np.where(y, -margin, margin)) * scale).astype(np.int64).sum())
                use = np.flatnonzero(_uniform(key, seed + number) < share)
                p, y, w = sigmoid(margin[use]), y[use], w[use]
                g, h = (np.rint(v * scale) for v in (w * (p - y), w * p * (1.0 - p)))
                yield np.take(codes, use, 1), g, h, loss

        return self._kept().mapPartitions(opened).persist(StorageLevel.MEMORY_AND_DISK)

    def _level(self, blocks, tree: Tree, level: int, columns: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, int]:
        """Whole sums of g and h, (2, counted nodes, columns, bins), over a round's rows; the loss of all rows.

        ``counted``: nodes of the level, by their place in it. The last bin has the missing values.
        """
        layout, missing, first = self.layout, self.missing, 2**level - 1
        nodes, width, wanted = len(counted), missing + 1, set(columns.tolist())
        place = np.full(2**level, -1, np.int64)
        place[counted] = np.arange(nodes)
        used = [(i, g) for i, g in enumerate(layout.groups) if wanted & set(g)]

        def sums(parts):
            held = [np.zeros((2, nodes * math.prod(layout.widths[j] for j in g)), np.int64) for _, g in used]
            loss, steps = 0, layout.steps(tree)
            for codes, g, h, lost in parts:
                loss += lost
                if level:
                    at = walked(steps, codes, level) - first
                    node = np.where(at >= 0, place[np.maximum(at, 0)], -1)
                    use = np.flatnonzero(node >= 0)
                    node, g, h = node[use], g[use], h[use]
                else:
                    use, node = slice(None), 0
                exact = [below_53_bits(v) for v in (g, h)]
                for total, (i, features) in zip(held, used):
                    cell = node * math.prod(layout.widths[j] for j in features) + codes[i][use]
                    for total_of, values, safe in zip(total, (g, h), exact):
                        total_of += np.bincount(cell, values, len(total_of)).astype(np.int64) if safe else summed(cell, values, len(total_of))
            out = np.zeros((2, nodes, len(columns), width), np.int64)
            for total, (_, features) in zip(held, used):
                whole = total.reshape(2, nodes, *[layout.widths[j] for j in features])
                for n, j in enumerate(features):
                    if j in wanted:
                        one = whole.sum(tuple(2 + m for m in range(len(features)) if m != n))
                        to = out[:, :, np.searchsorted(columns, j)]
                        to[:, :, :one.shape[2] - 1], to[:, :, -1] = one[:, :, :-1], one[:, :, -1]
            yield out, loss

        return added_up(blocks.mapPartitions(sums), lambda a, b: (a[0] + b[0], a[1] + b[1]))

    def _shares(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return whole[0] / self.scale, whole[1] / self.scale

    def root_gains(self) -> list[np.ndarray]:
        """For each feature the gain of a cut at each of its edges, at the root of the next tree (missing values right)."""
        blocks = self._open(len(self.trees))
        whole, _ = self._level(blocks, Tree.empty(self.depth), 0, np.arange(self.d), np.arange(1))
        blocks.unpersist()
        gains = split_gains(*self._shares(whole), self.least, self.penalty)[0][0, :, :, 0]
        return [gains[j, :len(e)] for j, e in enumerate(self.edges)]

    def round(self) -> Tree:
        """Grow the next tree, level by level."""
        number = len(self.trees)
        columns = np.sort(np.random.default_rng([self.seed, number]).choice(self.d, self.n_columns, replace=False))
        tree = Tree.empty(self.depth)
        weigh = lambda g, h: -self.rate * g / (h + self.penalty) if h + self.penalty > 0 else 0.0
        blocks = self._open(number)
        for level in range(self.depth):
            first = 2**level - 1
            if level == 0:
                whole, loss = self._level(blocks, tree, 0, columns, np.arange(1))
            else:
                parents = np.flatnonzero(tree.feature[first // 2:first] >= 0)
                lighter = 2 * parents + (tree.cover[first + 2 * parents] > tree.cover[first + 2 * parents + 1])
                before, whole = whole, np.zeros((2, 2**level, *whole.shape[2:]), np.int64)
                whole[:, lighter], _ = self._level(blocks, tree, level, columns, lighter)
                whole[:, lighter ^ 1] = before[:, parents] - whole[:, lighter]
            g, h = self._shares(whole)
            if level == 0:
                self.losses.append(loss / self.scale)
                tree.value[0], tree.cover[0] = weigh(g[0, 0].sum(), h[0, 0].sum()), h[0, 0].sum()
            f, b, left, gain, lg, lh = best_splits(g, h, self.least, self.penalty)
            grown = False
            for n in range(2**level):
                at = 2**level - 1 + n
                if (level and tree.feature[(at - 1) // 2] < 0) or not gain[n] > 1e-12:
                    continue
                grown = True
                j = int(columns[f[n]])
                edges = self.edges[j]
                tree.feature[at], tree.bin[at], tree.missing_left[at], tree.gain[at] = j, b[n], left[n], gain[n]
                tree.threshold[at] = edges[b[n]] if b[n] < len(edges) else math.inf
                sides = ((lg[n], lh[n]), (g[n, 0].sum() - lg[n], h[n, 0].sum() - lh[n]))
                for child, (cg, ch) in zip((2 * at + 1, 2 * at + 2), sides):
                    tree.value[child], tree.cover[child] = weigh(cg, ch), ch
            if not grown:
                break
        blocks.unpersist()
        self.trees.append(tree)
        self.recent.append(tree)
        if len(self.recent) >= KEEP_ROUNDS:
            self._settle()
        return tree

    def _settle(self) -> None:
        """Keep the margins of all rows with the recent trees added."""
        recent, layout, depth, before = self.recent, self.layout, self.depth, self._kept()

        def add(blocks):
            trees = [(t.value, layout.steps(t)) for t in recent]
            for codes, y, w, key, margin in blocks:
                yield codes, y, w, key, moved(margin, trees, codes, depth)

        self.kept = before.mapPartitions(add).persist(StorageLevel.MEMORY_AND_DISK)
        self.recent = []
        if len(self.trees) % CHECKPOINT_ROUNDS < KEEP_ROUNDS:
            ensure_checkpoint_dir(self.table.sparkSession)
            self.kept.checkpoint()
        self.kept.count()
        before.unpersist()
        if at := self.kept.getCheckpointFile():
            self._remove_file()
            self.file = at

    def _remove_file(self) -> None:
        if self.file:
            remove(self.table.sparkSession, self.file)
            self.file = None

    def close(self) -> None:
        """Give up the blocks, their checkpoint and the written table."""
        if self.kept is not None:
            self.kept.unpersist()
            self.kept = None
        self._remove_file()
        forget(self.table)

    def final_loss(self) -> float:
        """Summed loss of all rows under all trees."""
        return self._open(len(self.trees)).map(lambda b: b[3]).fold(0, operator.add) / self.scale if self.d else 0.0


class _BoostingParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features; NaN is missing", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0 or 1", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight of a row", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "vector (of class 0, of class 1)", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "the likelier class", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a leaf's weight that is added", TypeConverters.toFloat)
    rows = Param(Params._dummy(), "rows", "share of rows a tree draws", TypeConverters.toFloat)
    columns = Param(Params._dummy(), "columns", "share of columns a tree draws", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "L2 penalty of leaf weights (lambda)", TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "least Hessian sum of a child", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a feature, 254 at most", TypeConverters.toInt)

    def __init__(self, **given):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", weightCol="", probabilityCol="probability",
                         predictionCol="prediction", rounds=S.BOOST_ITERS, depth=S.BOOST_DEPTH, rate=S.BOOST_RATE,
                         rows=S.BOOST_SUBSAMPLE, columns=S.BOOST_SUBSAMPLE, penalty=S.BOOST_PENALTY,
                         least=S.BOOST_LEAST_CHILD, seed=S.RANDOM_STATE, bins=MOST_BINS)


class BoostedTrees(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``BoostedTreesModel``. Rows without a label raise; a weight column is optional; no rows give the even odds."""

    @keyword_only
    def __init__(self, **given):
        super().__init__()
        self._set(**self._input_kwargs)

    def _table(self, dataset: DataFrame) -> tuple[DataFrame, list[np.ndarray], float]:
        """The written table of binned rows, the edges, and the total weight."""
        weight = F.col(self.getOrDefault("weightCol")).cast("double") if self.getOrDefault("weightCol") else F.lit(1.0)
        label = F.col(self.getOrDefault("labelCol")).cast("double")
        plain = [F.col(f"`{f.name}`") for f in dataset.schema.fields if not isinstance(f.dataType, (UserDefinedType, MapType, VariantType))]
        x = vector_to_array(self.getOrDefault("featuresCol"))
        rows = dataset.select(x.alias("x"), label.alias("y"), weight.alias("w"), F.xxhash64(x, *plain).alias("key"))
        row = rows.agg(F.max(F.size("x")).alias("d"), F.sum("w").alias("w"), F.count("*").alias("n"),
                       F.count_if(F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0)).alias("bad")).first()
        if row["bad"]:
            raise ValueError(f"{row['bad']} rows have a label that is not 0 or 1")
        d = row["d"] or 0
        edges = bin_edges(rows, d, self.getOrDefault("bins")) if d else []
        missing = max((len(e) for e in edges), default=0) + 1

        layout = Layout.of(edges)
        groups = len(layout.groups)

        def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)
                codes = layout.codes(binned(values, edges, missing), missing)
                ends = np.arange(len(codes) + 1, dtype=np.int32) * groups
                laid = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([laid, *batch.columns[1:]], names=["codes", "y", "w", "key"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def block(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
                codes, *rest = (np.concatenate(column) for column in zip(*parts))
                arrays = [np.ascontiguousarray(codes.T), *rest, np.zeros(len(codes))]
                return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["codes", "y", "w", "key", "margin"])

            parts: list[list[np.ndarray]] = []
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    if parts and sum(len(p[0]) for p in parts) + part.num_rows > BLOCK_ROWS:
                        yield block(parts)
                        parts = []
                    codes = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, groups)
                    parts.append([codes, *(c.to_numpy(zero_copy_only=False) for c in part.columns[1:])])
            if parts:
                yield block(parts)

        cores, n = dataset.sparkSession.sparkContext.defaultParallelism, row["n"]
        parts = max(1, math.ceil(n / MOST_ROWS_A_TASK), min(cores, math.ceil(n / LEAST_ROWS_A_TASK)))
        table = rows.mapInArrow(lay, "codes binary, y double, w double, key bigint").repartition(parts, "key")
        return written(table.mapInArrow(gather, "codes binary, y binary, w binary, key binary, margin binary"), "boosting"), edges, row["w"] or 0.0

    def booster(self, dataset: DataFrame) -> Booster:
        table, edges, weight = self._table(dataset)
        get = self.getOrDefault
        return Booster(table, edges, weight, **{n: get(n) for n in ("depth", "rate", "rows", "columns", "penalty", "least", "seed")})

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        run = self.booster(dataset)
        for _ in range(self.getOrDefault("rounds") if run.d else 0):
            run.round()
        losses = [*run.losses, run.final_loss()] if run.d else []
        run.close()
        model = BoostedTreesModel(trees=pack(run.trees), nFeatures=run.d, losses=json.dumps(losses))
        return model._set(**{p.name: self.getOrDefault(p.name) for p in _BoostingParams().params})


def pack(trees: list[Tree]) -> str:
    """Trees as text: per tree the nodes that exist, as [node, feature, bin, threshold, missing_left, value, cover, gain]."""
    out = []
    for t in trees:
        nodes = [0]
        for i in nodes:
            if t.feature[i] >= 0:
                nodes += [2 * i + 1, 2 * i + 2]
        out.append({"depth": t.depth, "nodes": [
            [int(i), int(t.feature[i]), int(t.bin[i]), None if math.isinf(t.threshold[i]) else float(t.threshold[i]), bool(t.missing_left[i]),
             float(t.value[i]), float(t.cover[i]), float(t.gain[i])] for i in nodes]})
    return json.dumps(out)


def unpack(text: str) -> list[Tree]:
    trees = []
    for given in json.loads(text):
        t = Tree.empty(given["depth"])
        for i, f, b, threshold, left, value, cover, gain in given["nodes"]:
            t.feature[i], t.bin[i], t.threshold[i], t.missing_left[i] = f, b, math.inf if threshold is None else threshold, left
            t.value[i], t.cover[i], t.gain[i] = value, cover, gain
        trees.append(t)
    return trees


def flat(trees: list[Tree]) -> dict[str, np.ndarray]:
    """The nodes of all trees as arrays, one tree after the other from ``roots``; ``left`` and ``right`` are -1 at leaves."""
    sizes = np.array([len(t.feature) for t in trees], int)
    roots = np.cumsum(sizes) - sizes
    out = {n: np.concatenate([np.zeros(0, k), *[getattr(t, n) for t in trees]]) for n, k in (
        ("feature", np.int32), ("threshold", float), ("missing_left", bool), ("value", float), ("cover", float))}
    own, first = np.arange(sizes.sum()), np.repeat(roots, sizes)
    left = np.where(out["feature"] >= 0, 2 * own - first + 1, -1)
    return {**out, "left": left, "right": np.where(left >= 0, left + 1, -1), "roots": roots}


class BoostedTreesModel(Model, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Sums of trees as the log-odds of class 1. Saved and loaded with the ML writer (the trees are a parameter)."""

    trees = Param(Params._dummy(), "trees", "the trees as text", TypeConverters.toString)
    nFeatures = Param(Params._dummy(), "nFeatures", "width of the feature vector", TypeConverters.toInt)
    losses = Param(Params._dummy(), "losses", "summed training loss before each round and after the last", TypeConverters.toString)

    @keyword_only
    def __init__(self, **given):
        super().__init__()
        self._setDefault(trees="[]", nFeatures=0, losses="[]")
        self._set(**self._input_kwargs)

    @property
    def forest(self) -> list[Tree]:
        return unpack(self.getOrDefault("trees"))

    @property
    def training_loss(self) -> list[float]:
        return json.loads(self.getOrDefault("losses"))

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of a feature's splits, as a share of the sum over features."""
        d = self.getOrDefault("nFeatures")
        gain, count = np.zeros(d), np.zeros(d)
        for t in self.forest:
            inner = t.feature >= 0
            np.add.at(gain, t.feature[inner], t.gain[inner])
            np.add.at(count, t.feature[inner], 1)
        mean = gain / np.maximum(count, 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)

    def margin(self, features: Column) -> Column:
        """Log-odds of class 1, by Arrow batch."""
        a = flat(self.forest)
        walker = Walker(*(a[n] for n in ("feature", "threshold", "left", "right", "missing_left")), a["roots"])
        shared = SparkSession.active().sparkContext.broadcast((walker, a["value"]))

        @F.pandas_udf("double")
        def of(x: pd.Series) -> pd.Series:
            walker, value = shared.value
            return pd.Series(walker.summed(value, feature_rows(x)))

        return of(vector_to_array(features))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(F.col(self.getOrDefault("featuresCol")))))
        out = dataset.withColumn("_p", p)
        return (out.withColumn(self.getOrDefault("probabilityCol"), array_to_vector(F.array(F.lit(1.0) - F.col("_p"), F.col("_p"))))
                .withColumn(self.getOrDefault("predictionCol"), (F.col("_p") > 0.5).cast("double")).drop("_p"))
