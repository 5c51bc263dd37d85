"""Profiling and validation.

Column roles (id / target / numeric / categorical) are schema decisions made on
the driver from one-row aggregates; every statistic is a Spark aggregate with
map-side combine. Nothing row-level reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, NumericType, StringType

from lendscope import settings as S
from lendscope.functions.columns import r2, r3, r4
from lendscope.functions.quantiles import exact_quantiles
from lendscope.functions.running import running_totals
from lendscope.session import written

# dtypes the reference's id / target heuristics accept (int64, int32, float64).
_ID_TYPES = (LongType, IntegerType, DoubleType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """B7."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """String columns (booleans and dates are neither numeric nor categorical)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def _is_null(c: str, dtype) -> Column:
    col = F.col(f"`{c}`")
    if isinstance(dtype, (DoubleType, FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


# ------------------------------------------------------------------ B1-B3

def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row: n_rows, duplicate_rows (rows after the first occurrence, NULLs equal), total_missing.

    Rows are counted by a 128-bit hash of all columns (partial counts, 16 bytes a row shuffled). Whole rows are
    compared only where a hash occurs more than once: they are grouped by all columns, again with partial counts.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    nulls_in_row = sum((F.when(_is_null(f.name, f.dataType), 1).otherwise(0) for f in df.schema.fields), F.lit(0))
    # a NULL is told from its neighbours by its place in the row
    marks = [F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in cols])]
    hashed = df.select("*", F.xxhash64(*marks, *cols).alias("_h1"), F.xxhash64(F.lit(7), *cols, *marks).alias("_h2"))
    counted = hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_c"), F.sum(nulls_in_row).alias("_m"))
    twice = counted.where("_c > 1").select("_h1", "_h2")
    exact = hashed.join(twice, ["_h1", "_h2"], "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    again = exact.agg(F.coalesce(F.sum(F.col("_c") - F.lit(1)), F.lit(0)).cast("bigint").alias("duplicate_rows"))
    whole = counted.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n_rows"),
                        F.coalesce(F.sum("_m"), F.lit(0)).cast("bigint").alias("total_missing"))
    return whole.join(F.broadcast(again)).select("n_rows", "duplicate_rows", "total_missing")  # one row each


def dataset_overview(df: DataFrame) -> DataFrame:
    """B1: rows, columns, missing cells, duplicate rows."""
    return duplicate_stats(df).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), "total_missing", "duplicate_rows")


def duplicate_count(df: DataFrame) -> DataFrame:
    """B3."""
    return duplicate_stats(df).select("duplicate_rows")


def missing_report(df: DataFrame) -> DataFrame:
    """B2: missing count and percentage (2 dp) for columns with any missing value; one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count_if(_is_null(f.name, f.dataType)).alias(f.name) for f in df.schema.fields])
    long = counts.unpivot(["_n"], df.columns, "column_name", "missing")
    return long.where(F.col("missing") > 0).select(
        "column_name", "missing",
        r2(F.col("missing").cast("double") / F.col("_n").cast("double") * F.lit(100.0)).alias("missing_pct"),
    )


# ------------------------------------------------------------------ B5-B6

def unique_columns(df: DataFrame, cands: Sequence[str]) -> list[str]:
    """Those of ``cands`` (numbers) in which no value is missing and none repeats.

    One pass refutes for certain: a missing value, or whole numbers in a range narrower than the rows. A repeated
    value among some first rows refutes as well. What is left is counted exactly.
    """
    fields = {f.name: f for f in df.schema.fields}
    if not cands:
        return []
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[x for i, c in enumerate(cands) for x in (
        F.count_if(_is_null(c, fields[c].dataType)).alias(f"null{i}"),
        (F.max(F.col(f"`{c}`")) - F.min(F.col(f"`{c}`"))).cast("double").alias(f"span{i}"))]).first()
    n = row["_n"]
    left = [c for i, c in enumerate(cands) if n and not row[f"null{i}"]
            and (isinstance(fields[c].dataType, DoubleType) or row[f"span{i}"] >= n - 1)]
    for rows in (df.select(*[F.col(f"`{c}`") for c in left]).limit(10_000), df):
        if left:
            exact = rows.agg(F.count(F.lit(1)).alias("_n"), *[
                F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(left)]).first()
            left = [c for i, c in enumerate(left) if exact[f"d{i}"] == exact["_n"]]
    return left


def detect_id_columns(df: DataFrame) -> list[str]:
    """Name contains an id pattern, else an int/long/double column with all values present and distinct."""
    by_name = [c for c in df.columns if any(p in c.lower() for p in S.ID_COLUMN_PATTERNS)]
    unique = unique_columns(df, [f.name for f in df.schema.fields if f.name not in by_name and isinstance(f.dataType, _ID_TYPES)])
    return [c for c in df.columns if c in by_name or c in unique]


def detect_target_column(df: DataFrame, configured: str | None = None) -> tuple[str | None, str | None]:
    """(column, how): configured name, then the candidate list (its order), then the first
    numeric 0/1 column whose share of ones lies strictly inside (0.01, 0.90)."""
    if configured and configured in df.columns:
        return configured, "configured"
    named = [c for want in S.TARGET_COLUMN_CANDIDATES for c in reversed(df.columns) if c.lower() == want.lower()]
    if named:
        return named[0], "name"
    nums = [f for f in df.schema.fields if isinstance(f.dataType, (LongType, IntegerType, DoubleType))]
    if not nums:
        return None, None
    present = [F.when(~_is_null(f.name, f.dataType), F.col(f"`{f.name}`").cast("double")) for f in nums]  # NaN is missing
    row = df.agg(*[F.count_if(~x.isin(0.0, 1.0)).alias(f"bad_{i}") for i, x in enumerate(present)],
                 *[F.avg(x).alias(f"avg_{i}") for i, x in enumerate(present)]).first()
    lo, hi = S.TARGET_RATE_BOUNDS
    for i, f in enumerate(nums):
        rate = row[f"avg_{i}"]
        if row[f"bad_{i}"] == 0 and rate is not None and lo < rate < hi:
            return f.name, "binary"
    return None, None


def target_detection(df: DataFrame, configured: str | None = None) -> DataFrame:
    """B6 as a table: target_column, detected_by, positive_rate (4 dp); one row or none."""
    col, how = detect_target_column(df, configured)
    if col is None:
        return df.sparkSession.createDataFrame([], "target_column string, detected_by string, positive_rate double")
    return df.agg(r4(F.avg(F.col(f"`{col}`").cast("double"))).alias("positive_rate")).select(
        F.lit(col).alias("target_column"), F.lit(how).alias("detected_by"), "positive_rate")


def id_detection(df: DataFrame) -> DataFrame:
    """B5 as a table: column_name, position, detected_by."""
    ids = detect_id_columns(df)
    rows = [(c, df.columns.index(c),
             "name" if any(p in c.lower() for p in S.ID_COLUMN_PATTERNS) else "unique") for c in ids]
    return df.sparkSession.createDataFrame(rows, "column_name string, position int, detected_by string")


# ------------------------------------------------------------------ B9-B12

def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Share of each non-null class, default rate and the imbalance flag (min share < 0.15)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy()  # over the per-class rows only (a handful)
    share = F.col("count").cast("double") / F.sum("count").over(whole).cast("double")
    rate = (F.sum(F.col(target) * F.col("count")).over(whole).cast("double")
            / F.sum("count").over(whole).cast("double"))
    out = counts.withColumns({"share": share, "default_rate": rate})
    return out.select(
        target, "count", r4("share").alias("share"), r4("default_rate").alias("default_rate"),
        (F.min("share").over(whole) < F.lit(S.CLASS_IMBALANCE_SHARE)).alias("class_imbalanced"),
    )


def numeric_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column min, max, mean, median, sample std; default = median; 4 dp."""
    long = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c)
                       for c in columns]).unpivot([], list(columns), "feature", "value")
    stats = long.groupBy("feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    med = exact_quantiles(df, columns, [0.5]).select("feature", F.col("q0").alias("median"))
    out = stats.join(med, "feature", "left")
    return out.select(
        "feature", r4("min").alias("min"), r4("max").alias("max"), r4("mean").alias("mean"),
        r4("median").alias("median"), r4("std").alias("std"), r4("median").alias("default_value"))


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, count) for non-null values of string columns; one partial aggregate."""
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value")
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("count"))


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per feature, the smallest on ties, with aggregates only (no window)."""
    top = counts.groupBy("feature").agg(F.max("count").alias("_top"))
    return (counts.join(top, "feature").where(F.col("count") == F.col("_top"))
            .groupBy("feature").agg(F.min("value").alias("mode"), F.first("_top").alias("mode_count")))


def categorical_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B11 exploded: one row per (feature, category) in sorted order (``position`` from 1), the default (mode) flagged."""
    counts = value_counts_long(df, columns)
    placed = running_totals(counts.withColumn("one", F.lit(1)), ["feature", "value"], {"place": "one"}, "categories")
    return placed.join(placed.groupBy("feature").agg(F.min("place").alias("first")), "feature").join(modes(counts), "feature").select(
        "feature", F.col("value").alias("category"), (F.col("value") == F.col("mode")).alias("is_default"),
        (F.col("place") - F.col("first") + 1).cast("int").alias("position"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B12 numbers: count, mean, std, min, 25/50/75 % (interpolated), max; 3 dp."""
    long = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c)
                       for c in columns]).unpivot([], list(columns), "feature", "value")
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "feature", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    out = stats.join(qs, "feature", "left")
    return out.select("feature", "count", *[r3(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def describe_categorical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B12 strings: count, unique, top (smallest on ties), freq."""
    counts = value_counts_long(df, columns)
    per = counts.groupBy("feature").agg(F.sum("count").cast("bigint").alias("count"),
                                        F.count(F.lit(1)).alias("unique"))
    return per.join(modes(counts), "feature").select(
        "feature", "count", "unique", F.col("mode").alias("top"), F.col("mode_count").alias("freq"))


# ------------------------------------------------------------------ B13

def validation_report(df: DataFrame) -> DataFrame:
    """The report as (section, name, value_num, value_text) rows; never raises.

    The input is written once; detection, counts, missing values and classes then read the written columns.
    """
    spark = df.sparkSession
    df = written(df, "report-input")
    ids = detect_id_columns(df)
    target, _ = detect_target_column(df)
    exclude = ids + ([target] if target else [])
    nums = numeric_columns(df, exclude)
    cats = categorical_columns(df, exclude)

    schema = "section string, name string, value_num double, value_text string"
    meta = [("shape", "n_cols", float(len(df.columns)), None)]
    meta += [("columns", c, float(i), str(f.dataType.simpleString())) for i, (c, f) in
             enumerate(zip(df.columns, df.schema.fields))]
    meta += [("id_columns", c, float(i), None) for i, c in enumerate(ids)]
    meta += [("target_column", target, None, None)] if target else []
    meta += [("numerical_columns", c, float(i), None) for i, c in enumerate(nums)]
    meta += [("categorical_columns", c, float(i), None) for i, c in enumerate(cats)]
    parts = [spark.createDataFrame(meta, schema)]

    def item(section: str, name: str, num: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"),
                        num.cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_text"))

    dup = duplicate_stats(df)
    parts.append(dup.select(F.inline(F.array(
        item("shape", "n_rows", F.col("n_rows")),
        item("duplicates", "duplicate_rows", F.col("duplicate_rows")),
        item("missing", "total_missing", F.col("total_missing")),
    ))))
    parts.append(missing_report(df).select(F.explode(F.array(
        F.struct(F.lit("missing_values").alias("section"), F.col("column_name").alias("name"), F.col("missing").cast("double").alias("value_num"),
                 F.lit(None).cast("string").alias("value_text")),
        F.struct(F.lit("missing_pct").alias("section"), F.col("column_name").alias("name"), F.col("missing_pct").alias("value_num"),
                 F.lit(None).cast("string").alias("value_text")))).alias("x")).select("x.*"))
    if target:
        # the class rows, and on the first of them the two values of the whole
        first = F.col(target) == F.min(F.col(target)).over(Window.partitionBy())  # one row for each class
        none = F.lit(None).cast("string").alias("value_text")
        rows = F.array(
            F.struct(F.lit("target_distribution").alias("section"), F.col(target).cast("string").alias("name"), F.col("share").alias("value_num"), none),
            F.when(F.col("_first"), item("target", "default_rate", F.col("default_rate"))),
            F.when(F.col("_first"), item("target", "class_imbalanced", F.col("class_imbalanced"))))
        parts.append(target_distribution(df, target).withColumn("_first", first)
                     .select(F.explode(F.filter(rows, lambda e: e.isNotNull())).alias("x")).select("x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
