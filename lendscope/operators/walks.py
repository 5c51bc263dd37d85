"""Walks of rows through fitted trees, many rows at a time.

A value's place among its feature's thresholds is found once a row; each step of a walk then compares two small whole
numbers. Leaves lead to themselves, so all rows of a tree take the same number of steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Rows that walk together.
WALKED_ROWS = 8_192
#: The place of a missing value that goes right, and the cut of a leaf, above it.
MISSING, LEAF = 2**16 - 2, 2**16 - 1


def feature_rows(x: pd.Series) -> np.ndarray:
    """A matrix (rows, features) of a column of arrays; NULL is missing (NaN)."""
    return np.concatenate(x.to_list()).astype(float).reshape(len(x), -1) if len(x) else np.zeros((0, 0))


class Walker:
    """Trees as node arrays (``left`` negative at leaves), one after the other from ``roots``, made ready for walks.

    A value at most the threshold goes left; a missing one (NaN) where ``missing_left`` says so, else right.
    """

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, missing_left: np.ndarray, roots: np.ndarray):
        inner = left >= 0
        self.d = int(feature[inner].max(initial=-1)) + 1
        self.cuts = [np.unique(threshold[inner & (feature == j)]) for j in range(self.d)]
        if any(len(c) >= MISSING for c in self.cuts):
            raise ValueError("a feature has too many thresholds")
        cut, own = np.full(len(feature), LEAF, np.uint16), np.arange(len(feature))
        for j, cuts in enumerate(self.cuts):
            here = inner & (feature == j)
            cut[here] = np.searchsorted(cuts, threshold[here])
        self.feature = np.where(inner, feature, 0).astype(np.int64)
        column = self.feature + self.d * (missing_left & inner)
        child = np.stack([np.where(inner, left, own), np.where(inner, right, own)], 1).astype(np.int64)
        self.trees = []  # of each: first node, node after the last, columns, cuts, children, steps
        for first, stop in zip(roots, [*roots[1:], len(feature)]):
            steps, open_ = 0, np.array([first])
            while len(open_ := open_[inner[open_]]):
                steps, open_ = steps + 1, child[open_].ravel()
            self.trees.append((int(first), int(stop), column[first:stop], cut[first:stop], (child[first:stop] - first).ravel(), steps))

    def places(self, x: np.ndarray) -> np.ndarray:
        """Places of values among their feature's cuts (twice the features, rows): missing ones right, then missing ones left."""
        out = np.empty((2 * self.d, len(x)), np.uint16)
        for j, cuts in enumerate(self.cuts):
            missing = np.isnan(x[:, j])
            out[j] = np.searchsorted(cuts, x[:, j], side="left")
            out[self.d + j] = np.where(missing, 0, out[j])
            out[j][missing] = MISSING
        return out

    def walk(self, tree: int, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nodes that rows leave and reach, step by step (counted from the tree's first)."""
        _, _, column, cut, child, steps = self.trees[tree]
        n = places.shape[1]
        flat, begin, rows, at = places.ravel(), column * n, np.arange(n), np.zeros(n, np.int64)
        for _ in range(steps):
            cell = np.take(begin, at, mode="clip")
            cell += rows
            right = np.take(flat, cell, mode="clip") > np.take(cut, at, mode="clip")
            step = 2 * at
            step += right
            to = np.take(child, step, mode="clip")
            yield at, to
            at = to

    def summed(self, value: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The sum over the trees, in turn, of ``value`` at each row's leaf."""
        out = np.zeros(len(x))
        for first in range(0, len(x), WALKED_ROWS):
            part = x[first:first + WALKED_ROWS]
            places, total = self.places(part), out[first:first + WALKED_ROWS]
            for i, (start, stop, *_) in enumerate(self.trees):
                at = np.zeros(len(part), np.int64)
                for _, at in self.walk(i, places):
                    pass
                total += np.take(value[start:stop], at)
        return out

    def differences(self, value: np.ndarray, x: np.ndarray, d: int) -> np.ndarray:
        """(rows, ``d``): for each feature the sum of what ``value`` changes by at the steps of a row's paths that read it."""
        out = np.zeros((len(x), d))
        for first in range(0, len(x), WALKED_ROWS):
            part = x[first:first + WALKED_ROWS]
            places, flat = self.places(part), out[first:first + WALKED_ROWS].reshape(-1)
            rows = np.arange(len(part)) * d
            for i, (start, stop, *_) in enumerate(self.trees):
                own, feature = value[start:stop], self.feature[start:stop]
                for at, to in self.walk(i, places):
                    flat[rows + np.take(feature, at)] += np.take(own, to) - np.take(own, at)  # a row stands here once
        return out
