"""Feature preparation (D1-D9): impute, scale, one-hot, stratified split, class weights.

Fitting computes a handful of statistics with one aggregate each (exact medians
via ``functions.quantiles``); the fitted transform is a set of column
expressions, so applying it is a narrow projection. The same expressions are
wrapped in an ``SQLTransformer`` so the fitted preprocessing persists with the
ML writer as part of a ``PipelineModel``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope import settings as S
from lendscope.functions.quantiles import exact_median
from lendscope.session import written


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ------------------------------------------------------------------ fitted preprocessing

@dataclass
class FittedFeatures:
    """Statistics learned on the training side."""
    num_features: list[str]
    cat_features: list[str]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    levels: dict[str, list[str]]

    @property
    def feature_names(self) -> list[str]:
        """Output names: numeric columns, then ``col_level`` for every category (sorted)."""
        return list(self.num_features) + [f"{c}_{lv}" for c in self.cat_features for lv in self.levels[c]]

    # expressions ---------------------------------------------------------
    def imputed(self, c: str) -> Column:
        med = self.medians.get(c)
        x = F.nanvl(F.col(_q(c)).cast("double"), F.lit(None).cast("double"))
        return F.coalesce(x, F.lit(med)) if med is not None else x

    def scaled(self, c: str) -> Column:
        return (self.imputed(c) - F.lit(self.means[c])) / F.lit(self.scales[c])

    def category(self, c: str) -> Column:
        return F.coalesce(F.col(_q(c)).cast("string"), F.lit(S.MISSING_CATEGORY))

    def columns(self) -> list[Column]:
        """All transformed feature columns, named as ``feature_names``."""
        out = [self.scaled(c).alias(c) for c in self.num_features]
        for c in self.cat_features:
            cat = self.category(c)
            out += [F.when(cat == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{lv}")
                    for lv in self.levels[c]]
        return out

    def array(self) -> Column:
        """The transformed row as ``array<double>`` in feature order."""
        return F.array(*[c for c in self.columns()])

    def sql_statement(self) -> str:
        """The transform as an ``SQLTransformer`` statement: ``__f0 .. __fN`` appended."""
        def lit(v: float) -> str:
            return repr(float(v)) + "D"

        exprs = []
        for c in self.num_features:
            x = f"nanvl(cast({_q(c)} as double), cast(null as double))"
            if c in self.medians and self.medians[c] is not None:
                x = f"coalesce({x}, {lit(self.medians[c])})"
            exprs.append(f"(({x}) - {lit(self.means[c])}) / {lit(self.scales[c])}")
        for c in self.cat_features:
            cat = f"coalesce(cast({_q(c)} as string), '{S.MISSING_CATEGORY}')"
            for lv in self.levels[c]:
                lv_sql = lv.replace("\\", "\\\\").replace("'", "\\'")
                exprs.append(f"CASE WHEN {cat} = '{lv_sql}' THEN 1.0D ELSE 0.0D END")
        cols = ", ".join(f"{e} AS __f{i}" for i, e in enumerate(exprs))
        return f"SELECT *, {cols} FROM __THIS__"

    def vector_columns(self) -> list[str]:
        return [f"__f{i}" for i in range(len(self.feature_names))]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "FittedFeatures":
        return FittedFeatures(**json.loads(text))


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """D1 fit: exact median of every column (NULL/NaN ignored); one small row per column."""
    if not cols:
        return {}
    rows = exact_median(df, list(cols)).select("feature", "median").collect()  # <= len(cols) rows
    return {r["feature"]: r["median"] for r in rows}


def fit_scaling(df: DataFrame, cols: Sequence[str], medians: dict[str, float]) -> tuple[dict, dict]:
    """D2 fit on imputed values: mean and population std (zero std -> 1)."""
    if not cols:
        return {}, {}
    tmp = FittedFeatures(list(cols), [], medians, {}, {}, {})
    aggs = []
    for i, c in enumerate(cols):
        x = tmp.imputed(c)
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    means = {c: float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(cols)}
    scales = {}
    for i, c in enumerate(cols):
        s = row[f"s{i}"]
        scales[c] = 1.0 if s is None or s == 0.0 else float(s)
    return means, scales


def fit_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """D3 + D4 fit: sorted distinct values (after ``missing`` imputation) of each categorical column."""
    if not cols:
        return {}
    long = df.select(*[F.coalesce(F.col(_q(c)).cast("string"), F.lit(S.MISSING_CATEGORY)).alias(c)
                       for c in cols]).unpivot([], list(cols), "feature", "value")
    most = S.MOST_LEVELS  # bounds the one-hot block; a column over it is an error, never cut
    wide = long.groupBy("feature").agg(F.approx_count_distinct("value", 0.02).alias("n")).where(F.col("n") > 2 * most).collect()
    rows = [] if wide else long.distinct().limit(most * len(cols) + 1).collect()
    levels: dict[str, list[str]] = {c: [] for c in cols}
    if wide or len(rows) > most * len(cols):
        raise ValueError(f"too many categories for one-hot columns: {sorted(r['feature'] for r in wide) or list(cols)}")
    for r in rows:
        levels[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in levels.items()}


def fit_features(train: DataFrame, num_features: Sequence[str], cat_features: Sequence[str]) -> FittedFeatures:
    """D9 fit: every statistic from the training side only."""
    medians = fit_medians(train, num_features)
    num_features = [c for c in num_features if medians.get(c) is not None]  # a column without any value is no feature
    means, scales = fit_scaling(train, num_features, medians)
    levels = fit_levels(train, cat_features)
    return FittedFeatures(list(num_features), list(cat_features), medians, means, scales, levels)


def transform(df: DataFrame, fitted: FittedFeatures, keep: Sequence[str] = ()) -> DataFrame:
    """Apply the fitted transform: kept columns + one column per feature name."""
    return df.select(*[F.col(_q(c)) for c in keep], *fitted.columns())


def matrix_long(df: DataFrame, fitted: FittedFeatures, key: str, extra: Sequence[str] = ()) -> DataFrame:
    """D5 relational view: one row per (key, position, feature, value); ``extra`` columns kept."""
    names = fitted.feature_names
    return (
        df.select(F.col(_q(key)), *[F.col(_q(c)) for c in extra],
                  F.posexplode(fitted.array()).alias("position", "value"))
        .withColumn("feature", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1))
    )


# ------------------------------------------------------------------ split and weights

def _hash_key(key: Column) -> Column:
    """Multiplicative hash of a key in [0, 2^32), negative keys too: fits in bigint arithmetic, no overflow."""
    return (F.pmod(key, F.lit(2147483648)) * F.lit(2654435761)) % F.lit(4294967296)


def _cuts(rows: DataFrame, wanted: dict, bucket_bits: int) -> dict:
    """For each class the place of its last train row, as the values of h, k and t down to the first that decides it.

    ``rows`` has c (class) and the order's columns h (hash), k (key), t (row hash). The place is narrowed by counts of
    buckets: of the hash's upper bits, of the hash, then, only for classes where rows share that hash, of the key, and,
    only where rows share the key, of the row hash, 16 bits a step. A step holds 2^16 counts a class
    (of the hash, 2^``bucket_bits``), but for the keys that share one hash value (a share of 2^-32 of them).
    """
    shift = 32 - bucket_bits
    levels = [("h", F.shiftright(F.col("h"), shift)), ("h", F.col("h")), ("k", F.col("k")),
              *[("t", F.shiftright(F.col("t"), x)) for x in (47, 31, 15)], ("t", F.col("t"))]
    at: dict = {c: (F.lit(True), 0) for c in wanted}  # class -> (rows still in question, rows before them)
    found: dict = {c: {} for c in wanted}
    for name, bucket in levels:
        if not at:
            break
        inside, goal = F.lit(False), F.lit(None).cast("long")
        for c, (where, before) in at.items():
            own = F.col("c").eqNullSafe(F.lit(c))
            inside = inside | (own & where)
            goal = F.when(own, F.lit(wanted[c] - before)).otherwise(goal)
        counts = rows.where(inside).groupBy("c", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(name).alias("most"))
        through = F.sum("n").over(Window.partitionBy("c").orderBy("b"))
        hit = counts.withColumn("to", through).where((F.col("to") >= goal) & (F.col("to") - F.col("n") < goal)).collect()
        for r in hit:
            c, (where, before) = r["c"], at.pop(r["c"])
            found[c][name] = r["most"]
            if before + r["to"] > wanted[c]:  # the bucket goes on beyond the last train row
                at[c] = (where & (bucket == r["b"]), before + r["to"] - r["n"])
    return found


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = S.TEST_SIZE,
                     bucket_bits: int = S.SPLIT_BUCKET_BITS) -> DataFrame:
    """Exact stratified split; adds ``is_train``.

    Within each class rows are ordered by (hash(key), key, hash of the row); the first ``n_c - rint(test_size * n_c)`` are
    train. Any whole numbers are keys, negative and repeated ones too: rows that share a key are told apart by their other
    columns, a NULL key by the row's hash. Only rows equal in every column stay together (on the train side, if the cut
    falls among them). The last train row of each class is found from bucket counts over a narrow written table, and the
    split itself is a projection against these literals: no join, no window over a class. A missing label raises.
    Where a class has fewer than two rows, or there are more classes than test rows, all rows are split as one class.
    """
    row_hash = F.shiftrightunsigned(F.xxhash64(*[F.col(_q(c)) for c in df.columns]), 1)
    order = {"k": F.coalesce(F.col(_q(key)).cast("long"), row_hash), "t": row_hash}
    order = {"h": _hash_key(order["k"]), **order}
    rows = written(df.select(F.col(_q(label)).alias("c"), *[x.alias(n) for n, x in order.items()]), "split-keys")
    classes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    found = classes.limit(S.SPLIT_MOST_CLASSES + 1).collect()
    if len(found) > S.SPLIT_MOST_CLASSES:
        raise ValueError(f"label column {label!r} has more than {S.SPLIT_MOST_CLASSES} classes")
    sizes = {r["c"]: r["n"] for r in found}
    if None in sizes:
        raise ValueError(f"label column {label!r} has {sizes[None]} missing values")
    total = sum(sizes.values())
    own = F.col(_q(label))
    if sizes and (min(sizes.values()) < 2 or len(sizes) > np.rint(test_size * total)):
        rows, own, sizes = rows.withColumn("c", F.lit(0)), F.lit(0), {0: total}
    wanted = {c: n - int(np.rint(test_size * n)) for c, n in sizes.items()}
    last = _cuts(rows, {c: n for c, n in wanted.items() if n}, bucket_bits)
    train = F.lit(False)
    for c, place in last.items():
        within = F.lit(True)
        for name in reversed([n for n in ("h", "k", "t") if n in place]):
            here = F.lit(place[name])
            within = (order[name] < here) | ((order[name] == here) & within)
        train = F.when(own == F.lit(c), within).otherwise(train)
    return df.withColumn("is_train", train)


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (n_classes * n_c)`` per class (a row per class)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # over the class rows only
    w = F.sum("n").over(whole).cast("double") / (F.count(F.lit(1)).over(whole) * F.col("n")).cast("double")
    return counts.withColumn("weight", w)


def scale_pos_weight(train: DataFrame, label: str) -> Column:
    """D8 as an aggregate expression: ``n0 / max(1, n1)``."""
    n0 = F.count_if(F.col(label) == 0)
    n1 = F.count_if(F.col(label) == 1)
    return n0.cast("double") / F.greatest(F.lit(1), n1).cast("double")


def with_class_weight(df: DataFrame, label: str, weights: dict, out: str = "weight") -> DataFrame:
    """Attach fitted class weights (a 2-entry literal map, no join)."""
    from itertools import chain

    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in weights.items()))
    return df.withColumn(out, m[F.col(label)])
