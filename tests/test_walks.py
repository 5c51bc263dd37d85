"""Walks of many rows through fitted trees against one row at a time."""

import numpy as np
import pandas as pd
import pytest

from lendscope.operators import boosting as B
from lendscope.operators import forest as R
from lendscope.operators import walks as W


def trees(rng, d, number=7, depth=4):
    """Trees of random cuts, some of them leaves early, some cuts above all values."""
    out = []
    for _ in range(number):
        t = B.Tree.empty(depth)
        for i in range(2**depth - 1):
            if (i == 0 or t.feature[(i - 1) // 2] >= 0) and rng.random() < 0.8:
                t.feature[i], t.threshold[i], t.missing_left[i] = rng.integers(d), rng.choice([-1.0, 0.0, 0.5, np.inf]), rng.random() < 0.5
        t.value[:] = rng.normal(size=len(t.value))
        out.append(t)
    return out


def one_row(t, row, d):
    at, told = 0, np.zeros(d)
    while t.feature[at] >= 0:
        j, v = t.feature[at], row[t.feature[at]]
        left = t.missing_left[at] if np.isnan(v) else v <= t.threshold[at]
        to = 2 * at + (1 if left else 2)
        told[j] += t.value[to] - t.value[at]
        at = to
    return t.value[at], told


@pytest.mark.parametrize("walked", [5, 8_192])
def test_walks_equal_single_rows(monkeypatch, walked):
    monkeypatch.setattr(W, "WALKED_ROWS", walked)
    rng = np.random.default_rng(4)
    x = rng.choice([-2.0, -1.0, 0.0, 0.25, 0.5, 3.0, np.inf, np.nan], (60, 5))
    made = trees(rng, 4)
    a = B.flat(made)
    walker = W.Walker(*(a[n] for n in ("feature", "threshold", "left", "right", "missing_left")), a["roots"])
    want = [[one_row(t, row, 5) for t in made] for row in x]
    assert walker.summed(a["value"], x).tolist() == [sum(v for v, _ in of) for of in want]  # in turn: bit by bit
    assert walker.summed(a["value"], x).tolist() == sum((t.margins(x) for t in made), np.zeros(60)).tolist()
    assert np.allclose(walker.differences(a["value"], x, 5), [sum(told for _, told in of) for of in want], atol=1e-12)
    assert walker.summed(a["value"], np.zeros((0, 0))).tolist() == []


def test_forest_probabilities_are_means_of_leaves():
    rng = np.random.default_rng(5)
    made, parts, first = trees(rng, 3), [], 0
    for t in made:
        t.missing_left[:] = False
    for t in made:  # renumbered as a saved forest has them: both children side by side
        order = [0]
        for i in order:
            if t.feature[i] >= 0:
                order += [2 * i + 1, 2 * i + 2]
        place = {i: first + n for n, i in enumerate(order)}
        parts += [(t.feature[i], t.threshold[i], place.get(2 * i + 1, 0) if t.feature[i] >= 0 else 0, t.value[i]) for i in order]
        first += len(order)
    feature, threshold, left, value = (np.array(c) for c in zip(*parts))
    sizes = [sum(1 for _ in nodes) for nodes in ([i for i in range(len(t.feature)) if i == 0 or t.feature[(i - 1) // 2] >= 0] for t in made)]
    a = {"feature": feature, "threshold": threshold, "left": left, "value": value, "roots": np.cumsum([0, *sizes[:-1]])}
    x = rng.choice([-2.0, 0.0, 0.25, 3.0, np.nan], (40, 3))
    assert np.allclose(R.probabilities(R.walker(a), value, x), np.mean([t.margins(x) for t in made], 0), atol=1e-12)


def test_rows_of_arrays():
    assert W.feature_rows(pd.Series([], dtype=object)).shape == (0, 0)
    got = W.feature_rows(pd.Series([np.array([1.0, 2.0]), np.array([None, 3.0], object)]))
    assert got.shape == (2, 2) and np.isnan(got[1, 0]) and got[1, 1] == 3.0
