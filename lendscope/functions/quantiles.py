"""Exact, interpolated quantiles by repeated narrowing; no raw row is ever shuffled.

Every pass is one aggregate with map-side combine over the data:

1. A narrowing pass counts, for each group, column and wanted rank, the values below a window and takes quantile
   marks (a bounded sketch) of the values inside it. The first window is everything. The marks around the wanted
   rank are the next window, which holds a few marks' share of the last one. Passes repeat until every window is
   expected to hold ``FEW`` values at most.
2. The last pass counts the values below each window and collapses those inside to (value, count) pairs, whose
   running counts give the exact order statistics, interpolated linearly (``pos = q * (n - 1)``): what pandas, NumPy
   and SQL ``quantile_cont`` return. A rank outside its window raises.

Windows are one row per group, column and probability. They are held by the driver and broadcast; more than
``MOST_WINDOWS`` raise.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from lendscope import settings as S
from lendscope.session import written

MARKS = S.QUANTILE_MARKS
#: Rank error of the sketch is 1 / ACCURACY of the window, a tenth of the distance between marks.
ACCURACY = 10 * MARKS
FEW = S.QUANTILE_FEW
MOST_WINDOWS = S.QUANTILE_MOST_WINDOWS


def _long(df: DataFrame, group_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Unpivot to (groups..., feature, value) as doubles, NULL/NaN dropped."""
    ids = list(group_cols)
    vals = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in value_cols]
    wide = written(df.select(*ids, *vals), "quantile-input")  # read by every pass, narrow
    return wide.unpivot(ids, list(value_cols), "feature", "value").where(F.col("value").isNotNull())


def _narrowed(marks: list[float], below: int, inside: int, ranks: tuple[int, int]) -> tuple[float, float, int]:
    """The window around both ranks: its ends, and how many values it is expected to hold."""
    each = max(inside - 1, 1) / MARKS
    first = max(floor((ranks[0] - below) / each) - 1, 0)
    last = min(ceil((ranks[1] - below) / each) + 1, MARKS)
    return marks[first], marks[last], 0 if marks[first] == marks[last] else ceil((last - first) * each)


def exact_quantiles(df: DataFrame, value_cols: Sequence[str], probs: Sequence[float],
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows (groups..., feature, n, q0, q1, ...) with exact interpolated quantiles per ``probs``.

    Groups or columns with no non-null value are absent from the result. Runs its passes at once; the result is a
    small local table.
    """
    spark, ids = df.sparkSession, list(group_cols)
    keys = [*ids, "feature"]
    long = _long(df, ids, value_cols)
    grid = [i / MARKS for i in range(MARKS + 1)]
    key_fields = [*[df.select(c).schema[0] for c in ids], StructField("feature", StringType())]

    first = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", grid, ACCURACY).alias("marks")).collect()
    if len(first) * len(probs) > MOST_WINDOWS:
        raise ValueError(f"{len(first)} groups and columns with {len(probs)} quantiles need more than {MOST_WINDOWS} windows")
    counts = {tuple(r[k] for k in keys): r["n"] for r in first}

    def ranks(key: tuple, i: int) -> tuple[int, int]:
        pos = probs[i] * (counts[key] - 1)
        return floor(pos), ceil(pos)

    windows = {(key, i): _narrowed(r["marks"], 0, r["n"], ranks(key, i))
               for r in first for key in [tuple(r[k] for k in keys)] for i in range(len(probs))}

    def at_windows() -> DataFrame:
        """Each value beside the windows of its group and column that do not end below it."""
        schema = StructType([*[StructField(f"_w{k}", f.dataType) for k, f in enumerate(key_fields)], StructField("i", LongType()),
                             StructField("lo", DoubleType()), StructField("hi", DoubleType())])
        bounds = spark.createDataFrame([(*key, i, w[0], w[1]) for (key, i), w in windows.items()], schema)
        same: Column = F.col("value") <= F.col("hi")
        for k, name in enumerate(keys):
            same = same & F.col(name).eqNullSafe(F.col(f"_w{k}"))
        return long.join(F.broadcast(bounds), same)  # MOST_WINDOWS rows at most

    while any(w[2] > FEW for w in windows.values()):
        inside = F.when(F.col("value") >= F.col("lo"), F.col("value"))
        looked = at_windows().groupBy(*keys, "i").agg(
            F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count(inside).alias("inside"),
            F.percentile_approx(inside, grid, ACCURACY).alias("marks")).collect()
        for r in looked:
            key = tuple(r[k] for k in keys)
            wanted = ranks(key, r["i"])
            if not r["below"] <= wanted[0] <= wanted[1] < r["below"] + r["inside"]:
                raise RuntimeError(f"rank {wanted} of {key} is outside its window")
            was = windows[key, r["i"]]
            now = _narrowed(r["marks"], r["below"], r["inside"], wanted)
            windows[key, r["i"]] = now if now[2] < was[2] else (*now[:2], FEW)

    held = F.when(F.col("value") >= F.col("lo"), F.col("value"))  # NULL stands for all values below the window
    pairs = at_windows().groupBy(*keys, "i", held.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = spark.createDataFrame([(*key, i, n, *ranks(key, i)) for key, n in counts.items() for i in range(len(probs))], StructType(
        [*[StructField(f"_w{k}", f.dataType) for k, f in enumerate(key_fields)], *[StructField(c, LongType()) for c in ("j", "n", "r0", "r1")]]))
    same = F.col("i") == F.col("j")
    for k, name in enumerate(keys):
        same = same & F.col(name).eqNullSafe(F.col(f"_w{k}"))
    found = (pairs.withColumn("through", F.sum("c").over(running)).join(F.broadcast(small), same).groupBy(*keys, "i").agg(
        F.first(F.col("r0")).alias("r0"),
        F.max(F.when(F.col("v").isNull(), F.col("through"))).alias("below"),
        F.min(F.when(F.col("v").isNotNull() & (F.col("through") > F.col("r0")), F.col("v"))).alias("a"),
        F.min(F.when(F.col("v").isNotNull() & (F.col("through") > F.col("r1")), F.col("v"))).alias("b")).collect())
    values: dict[tuple, list] = {key: [None] * len(probs) for key in counts}
    for r in found:
        key = tuple(r[k] for k in keys)
        if r["a"] is None or r["b"] is None or (r["below"] or 0) > r["r0"]:
            raise RuntimeError(f"rank {ranks(key, r['i'])} of {key} is outside its window")
        pos = probs[r["i"]] * (counts[key] - 1)
        values[key][r["i"]] = r["a"] + (r["b"] - r["a"]) * (pos - floor(pos))
    return spark.createDataFrame(
        [(*key, n, *values[key]) for key, n in counts.items()],
        StructType([*key_fields, StructField("n", LongType()), *[StructField(f"q{i}", DoubleType()) for i in range(len(probs))]]))


def exact_median(df: DataFrame, value_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows (groups..., feature, n, median)."""
    return exact_quantiles(df, value_cols, [0.5], group_cols).withColumnRenamed("q0", "median")
