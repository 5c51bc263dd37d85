"""Queries of the training-data operators: ``QUERIES`` (key -> (spark, sf_dir) -> DataFrame) and their DuckDB ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.llm import chat_format, language_id, license_scan, piece_codec, quality_model
from lendscope.llm.collocation import collocations
from lendscope.llm.exact_dedup import exact_dedup
from lendscope.llm.filter_audit import audit
from lendscope.llm.html_extract import extract_pages
from lendscope.llm.mixing import mix
from lendscope.llm.near_dedup import near_classes
from lendscope.llm.quality_rules import quality_rules
from lendscope.llm.sharding import shard
from lendscope.llm.sql import SQL  # noqa: F401

SHARDS = 16
THRESHOLD = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(col: Column) -> Column:
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _crc(F.col("doc_id")) % 3 == 1
    model = language_id.fit(docs.where(~held_out), F.col("doc_id"))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents"), percent=85)


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = piece_codec.load()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.decode(piece_codec.encode(docs, pieces, F.xxhash64("doc_id")), pieces)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "n_lines", "n_bangs", "n_upper", "n_stop_words")
    return judged.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = _crc(F.col("doc_id")) % 5 == 0
    model = quality_model.fit(docs, labels.where(~held_out), label="quality")
    return quality_model.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = _crc(F.col("id")) % 5 != 0
    return chat_format.parse_transcripts(_table(spark, sf_dir, "conversations"), learned)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = license_scan.scan(docs, license_scan.fit(docs))
    found = F.col("licences")
    return scanned.select("doc_id", found.n_words.alias("n_words"), found.n_base.alias("n_base"), found.first_word.alias("first_word"),
                          found.last_word.alias("last_word"), F.concat_ws(",", found.base_labels).alias("base_labels"),
                          F.concat_ws(",", found["labels"]).alias("labels"), found.score.alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_near_dedup, op3_piece_codec, op4_quality_rules, op5_html_extract,
                            op6_exact_dedup, op7_sharding, op8_quality_model, op9_mixing, op10_chat_format, op11_license_scan,
                            op12_collocations, op13_filter_audit)
}
