"""Column-expression helpers (all JVM built-ins, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lendscope import settings as S


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that clashes with none of ``columns`` (compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def round_half_even(c: str | Column, digits: int) -> Column:
    """NumPy-style rounding: ``rint(x * 10^d) / 10^d`` (half to even on the scaled value).

    ``+ 0.0`` turns a negative zero into zero so equal results print and hash alike.
    """
    scale = float(10 ** digits)
    return F.rint(col_(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def r4(c: str | Column) -> Column:
    return round_half_even(c, 4)


def r2(c: str | Column) -> Column:
    return round_half_even(c, 2)


def r3(c: str | Column) -> Column:
    return round_half_even(c, 3)


def nan_to_null(c: str | Column) -> Column:
    """Spark keeps NaN apart from NULL; the reference knows one "missing"."""
    return F.nanvl(col_(c), F.lit(None).cast("double"))


def sigmoid(z: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_(z)))


def safe_div(num: Column, den: Column) -> Column:
    """Ratio with zero (or NULL) denominators giving 0, like zero_division=0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def classify_risk(prob: str | Column) -> Column:
    """LOW below 0.30, MEDIUM up to and including 0.60, HIGH above; NULL stays NULL."""
    p = col_(prob)
    return (
        F.when(p < F.lit(S.LOW_THRESHOLD), F.lit("LOW"))
        .when(p <= F.lit(S.HIGH_THRESHOLD), F.lit("MEDIUM"))
        .when(p > F.lit(S.HIGH_THRESHOLD), F.lit("HIGH"))
    )


def income_tier(income: str | Column) -> Column:
    x = col_(income)
    return (
        F.when(x.isNull(), F.lit("unknown"))
        .when(x > F.lit(S.INCOME_TIER_HIGH), F.lit("high"))
        .when(x > F.lit(S.INCOME_TIER_MEDIUM), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def pct_one_decimal(prob: str | Column) -> Column:
    """``f"{p*100:.1f}"`` built from integers so every engine prints the same digits."""
    tenths = F.rint(col_(prob) * F.lit(1000.0)).cast("bigint")
    return F.concat(
        F.floor(tenths / F.lit(10)).cast("string"),
        F.lit("."),
        (tenths % F.lit(10)).cast("string"),
    )


def prettify_feature(name: str | Column) -> Column:
    """``num__loan_int_rate`` -> ``Loan Int Rate``: strip prefixes, ``_`` -> space, title case."""
    c = col_(name)
    c = F.regexp_replace(F.regexp_replace(c, "num__", ""), "cat__", "")
    c = F.regexp_replace(F.regexp_replace(c, "_", " "), "  ", " ")
    return F.initcap(c)
