"""Batch scoring columns (H1, H2): probability to level and 0-100 score, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.functions.columns import classify_risk, col_, r4


def risk_columns(prob: str | Column) -> dict[str, Column]:
    """default_prob (4 dp), risk_level on the unrounded probability, risk_score (percent, 1 dp)."""
    p = col_(prob)
    return {
        "default_prob": r4(p),
        "risk_level": classify_risk(p),
        "risk_score": F.rint(p * F.lit(100.0) * F.lit(10.0)) / F.lit(10.0),
    }


def with_risk(df: DataFrame, prob: str | Column) -> DataFrame:
    """H2: the input rows with the three scoring columns appended."""
    cols = risk_columns(prob)
    return df.select("*", *[c.alias(n) for n, c in cols.items()])
