"""Running sums over a total order of all rows, with no key and no table held by one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.session import written


def running_totals(df: DataFrame, order: Sequence[str], measures: dict[str, str], name: str,
                   peers: bool = False) -> DataFrame:
    """Add, for each ``measures`` item (new column: measured column), the sum over all rows up to and with this one.

    The order is ``order`` over the whole table. Rows are dealt by ranges of it into many parts; a window sums each
    part, and what earlier parts hold is added from one row a part. A group with a third of all rows is spread over
    many parts. With ``peers`` rows equal in all of ``order`` share the sum that includes them all.
    """
    part = "_part"
    laid = written(df.repartitionByRange(*[F.col(c) for c in order]).withColumn(part, F.spark_partition_id()), name)
    totals = laid.groupBy(part).agg(*[F.sum(c).alias(f"_t_{new}") for new, c in measures.items()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = totals.select(
        F.col(part), *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).cast("long").alias(f"_o_{new}") for new in measures])
    inside = Window.partitionBy(part).orderBy(*order)
    inside = (inside.rangeBetween if peers else inside.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    summed = laid.select("*", *[F.sum(c).over(inside).alias(f"_s_{new}") for new, c in measures.items()])
    out = (summed.join(offsets, part)
           .select(*df.columns, *[(F.col(f"_s_{new}") + F.col(f"_o_{new}")).cast("long").alias(new) for new in measures]))
    out._written_at = laid._written_at  # ``forget`` deletes the dealt rows once the sums are written elsewhere
    return out
