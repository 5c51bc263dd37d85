"""The training-data pipeline over ``documents``: rules, exact copies, near copies, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and works on all that its predecessor
kept. Between stages the rows are written as Parquet and read again. All stages but the last return the columns they
were given; the last adds the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscope.llm import piece_codec
from lendscope.llm.common import fresh, stage
from lendscope.llm.exact_dedup import drop_exact
from lendscope.llm.mixing import mixed_rows
from lendscope.llm.near_dedup import drop_near
from lendscope.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_exact(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a similarity of 0.8 the document with the smallest id stays."""
    return drop_near(docs, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; a document taken twice is there twice."""
    return mixed_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as pieces (``pieces``), their number, and whether they decode to the text.

    Rows that repeat a document (its epochs) are numbered, so that each has a segmentation of its own.
    """
    pieces = piece_codec.load()
    epoch = fresh(docs.columns, "_epoch")
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    docs_numbered = docs.withColumn(epoch, F.row_number().over(same))
    coded = piece_codec.encode(docs_numbered, pieces, F.xxhash64("doc_id", epoch), out="pieces")
    checked = piece_codec.decode(coded, pieces, "pieces", "decoded_text")
    return checked.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "pieces"], "pieces",
                          F.size("pieces").cast("long").alias("n_pieces"), F.col("decoded_text").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("encoding", encoding),
]

#: SQL can express neither near-duplicate classes nor the pieces; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs, f"pipeline-{number}-{name.replace(' ', '-')}")
    return docs
