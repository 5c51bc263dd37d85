"""CSV source and sink (A1, A2) with the missing-value tokens of the pandas reader.

``spark.read.csv`` takes one ``nullValue``; here a list of tokens is missing, and
column types follow from what is left (one aggregate pass decides). Options are
explicit, so a file means the same whatever the session's defaults are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default missing-value tokens of the pandas CSV reader.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


# What the pandas reader takes as a number or a truth value.
NUMBER = r"^[ \t]*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|infinity|Inf|Infinity)[ \t]*$"
WHOLE = r"^[ \t]*[+-]?\d{1,18}[ \t]*$"
TRUTH = ["True", "TRUE", "true", "False", "FALSE", "false"]


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Header row, quoted fields with doubled quotes, NA tokens (taken exactly) -> NULL, types from what is left.

    A column becomes ``bigint``, ``double`` or ``boolean`` when all its values are; everything else, dates included,
    stays a string. Missing values are NULL, never NaN. ``path`` may be a file, folder or glob. Files are split among
    tasks; with ``multiline`` fields may hold line breaks, and a file is then read by one task.
    """
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
           .option("multiLine", multiline).csv(path))
    cleaned = raw.select(*[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    # One pass: what is every column, once the tokens are gone?
    checks = []
    for i, c in enumerate(raw.columns):
        v = F.col(f"`{c}`")
        checks += [F.count(v).alias(f"n{i}"), F.count_if(v.rlike(NUMBER)).alias(f"number{i}"),
                   F.count_if(v.rlike(WHOLE)).alias(f"whole{i}"), F.count_if(v.isin(TRUTH)).alias(f"truth{i}")]
    row = cleaned.agg(*checks).first() if checks else {}
    casts = {}
    for i, c in enumerate(raw.columns):
        n, v = row[f"n{i}"], F.trim(F.col(f"`{c}`"))
        if n and row[f"whole{i}"] == n:
            casts[c] = v.cast("bigint")
        elif n and row[f"number{i}"] == n:
            casts[c] = v.cast("double")
        elif n and row[f"truth{i}"] == n:
            casts[c] = v.cast("boolean")
    return cleaned.withColumns(casts) if casts else cleaned


def write_csv(df: DataFrame, path: str) -> None:
    """A2: header row, no index column, quotes doubled inside quoted fields; one file per partition under ``path``."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
