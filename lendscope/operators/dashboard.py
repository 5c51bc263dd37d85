"""Dashboard and explorer aggregates.

Each returns a small DataFrame computed from the whole input in one plan: a
single partial/final aggregate (map-side combine, one small shuffle) or a
bounded ``TakeOrderedAndProject`` for samples and previews.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lendscope import settings as S
from lendscope.functions.running import running_totals
from lendscope.functions.columns import r2, r4


def _count_if(cond) -> F.Column:
    return F.count_if(cond)


def portfolio_kpis(df: DataFrame, target: str = "loan_status", risk_col: str = "risk_level",
                   prob_col: str = "default_prob") -> DataFrame:
    """L1: customers, default rate, risk counts, mean probability, cross-sell opportunities.

    Without prediction columns the label-only fallback applies: high = sum of
    labels, low = the rest, medium = 0, mean probability = default rate.
    """
    n = F.count(F.lit(1))
    if target in df.columns:
        default_rate = F.avg(F.col(target).cast("double"))
    else:
        default_rate = F.lit(0.0)
    if risk_col in df.columns and prob_col in df.columns:
        row = df.agg(
            n.alias("total_customers"),
            r4(default_rate).alias("default_rate"),
            _count_if(F.col(risk_col) == "HIGH").alias("high_risk"),
            _count_if(F.col(risk_col) == "MEDIUM").alias("medium_risk"),
            _count_if(F.col(risk_col) == "LOW").alias("low_risk"),
            r4(F.avg(prob_col)).alias("avg_default_prob"),
        )
    else:
        high = F.sum(F.col(target)).cast("bigint") if target in df.columns else F.lit(0).cast("bigint")
        row = df.agg(
            n.alias("total_customers"),
            r4(default_rate).alias("default_rate"),
            high.alias("high_risk"),
            F.lit(0).cast("bigint").alias("medium_risk"),
            (n - high).alias("low_risk"),
            r4(default_rate).alias("avg_default_prob"),
        )
    return row.withColumn("cross_sell_opportunities", F.col("medium_risk") + F.col("low_risk"))


def default_distribution(df: DataFrame, target: str = "loan_status") -> DataFrame:
    """L2: count per label, 0/1 shown as text (other values map to NULL, as a dict map would)."""
    return df.groupBy(F.col(target).alias("label")).count().select(
        status_of("label").alias("status"), F.col("count"))


def status_of(c: str) -> F.Column:
    return F.when(F.col(c) == 0, F.lit("No Default")).when(F.col(c) == 1, F.lit("Default"))


def risk_distribution(df: DataFrame, risk_col: str = "risk_level") -> DataFrame:
    """L3: customers per predicted risk level."""
    return df.groupBy(risk_col).count()


def scatter_sample(df: DataFrame, key: str, columns: Sequence[str],
                   n: int = S.SCATTER_SAMPLE_ROWS) -> DataFrame:
    """L4: exactly min(n, rows) rows without replacement, repeatable.

    Rows are ordered by a multiplicative hash of the key (ties on the key), so
    the plan is a bounded TakeOrderedAndProject: each task keeps n rows, the
    final merge sees n x tasks rows, never the whole table.
    """
    h = ((F.col(key) % F.lit(2147483648)) * F.lit(2654435761)) % F.lit(4294967296)
    return df.select(key, *columns).orderBy(h, F.col(key)).limit(n)


def explorer_preview(df: DataFrame, key: str, filter_col: str | None = None,
                     values: Sequence[str] | None = None, n: int = S.PREVIEW_ROWS) -> DataFrame:
    """Filter a string column by a value set (no values = no filter), first ``n`` by key."""
    out = df
    if filter_col and values:
        out = out.filter(F.col(filter_col).isin(list(values)))
    return out.orderBy(key).limit(n)


def filter_values(df: DataFrame, c: str) -> DataFrame:
    """Distinct non-null values of a column, their sorted ``position`` from 1."""
    found = df.select(c).where(F.col(c).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return running_totals(found, [c], {"position": "_one"}, "filter-values").select(c, F.col("position").cast("int").alias("position"))


def target_counts(df: DataFrame, target: str = "loan_status") -> DataFrame:
    """Count per target value and the default rate as a percentage with 2 dp."""
    counts = df.groupBy(target).count()
    # The grouped result has one row per class, so an unpartitioned window over it is tiny.
    whole = Window.partitionBy()
    rate = (F.sum(F.col(target) * F.col("count")).over(whole).cast("double")
            / F.sum("count").over(whole).cast("double"))
    return counts.withColumn("default_rate_pct", r2(rate * F.lit(100.0)))
