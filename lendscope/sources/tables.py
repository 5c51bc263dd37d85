"""Table sources: the driver's parquet tables and the ``credit_book`` applicant view.

``credit_book`` reads ``orders``, ``customer`` and ``lineitem`` and presents one row
per order as a loan application with the applicant schema the analytics expect
(ten feature columns + ``loan_status``). Its SQL twin lives in
``lendscope.plans.oracle`` and is kept value-identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.columns import r4, sigmoid
from lendscope.operators.scorecard import scorecard_logit
from lendscope.plans.fitted import memo

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

FEATURE_COLUMNS = [
    "person_age", "person_income", "person_emp_length", "loan_intent", "loan_grade",
    "loan_amnt", "loan_int_rate", "loan_percent_income", "cb_person_default_on_file",
    "cb_person_cred_hist_length",
]
TARGET = "loan_status"
KEY = "loan_id"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def credit_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loan application per order (see module doc).

    The DataFrame (a lazy plan, no data) is built once per session and input, so
    the queries that start from it skip re-analysing the same plan.
    """
    return memo(spark, sf_dir, "credit_book", lambda: _build_credit_book(spark, sf_dir))


def _build_credit_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")

    # Map-side partial aggregate, one shuffle on l_orderkey.
    lines = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.floor(F.col("l_discount") * F.lit(100.0) + F.lit(0.5)).cast("bigint")).alias("disc_cents"),
        F.max(F.when(F.col("l_tax") >= F.lit(0.075), F.lit(1)).otherwise(F.lit(0))).alias("top_tax"),
    )
    cust = customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    ords = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")

    base = (
        ords.join(cust, F.col("c_custkey") == F.col("o_custkey"), "inner")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    )
    grade_letter = F.substring("o_orderpriority", 1, 1)
    book = base.select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("customer_id"),
        (F.lit(18) + F.col("c_custkey") % F.lit(57)).alias("person_age"),
        F.floor(F.least(F.lit(500000.0), F.greatest(
            F.lit(12000.0), F.lit(12000.0) + (F.col("c_acctbal") + F.lit(1000.0)) * F.lit(12.0)))
        ).cast("bigint").alias("person_income"),
        F.when(F.col("o_orderkey") % F.lit(37) == 0, F.lit(None).cast("double"))
        .otherwise((F.col("o_orderkey") % F.lit(13)).cast("double")).alias("person_emp_length"),
        F.when(F.col("o_orderkey") % F.lit(41) == 0, F.lit(None).cast("string"))
        .otherwise(F.col("c_mktsegment")).alias("loan_intent"),
        F.when(grade_letter == "1", "A").when(grade_letter == "2", "B").when(grade_letter == "3", "C")
        .when(grade_letter == "4", "D").otherwise("E").alias("loan_grade"),
        F.floor(F.least(F.lit(50000.0), F.greatest(F.lit(500.0), F.col("o_totalprice") / F.lit(10.0))))
        .cast("bigint").alias("loan_amnt"),
        (F.lit(5.0) + F.lit(2.0) * F.col("disc_cents").cast("double") / F.col("n_lines").cast("double"))
        .alias("loan_int_rate"),
        F.when(F.col("top_tax") == 1, "Y").otherwise("N").alias("cb_person_default_on_file"),
        (F.lit(1) + F.col("c_custkey") % F.lit(45)).alias("cb_person_cred_hist_length"),
    )
    book = book.withColumn(
        "loan_percent_income",
        r4(F.col("loan_amnt").cast("double") / F.col("person_income").cast("double")),  # a ratio of 4 decimals
    )
    book = book.select(
        "loan_id", "customer_id", "person_age", "person_income", "person_emp_length", "loan_intent",
        "loan_grade", "loan_amnt", "loan_int_rate", "cb_person_default_on_file",
        "cb_person_cred_hist_length", "loan_percent_income",
    )
    book = book.withColumn("scorecard_logit", scorecard_logit())
    # Deterministic stand-in for the generator's noise term.
    noise = ((F.col("loan_id") * F.lit(7919)) % F.lit(1000)).cast("double") / F.lit(1000.0) - F.lit(0.5)
    return book.withColumn(
        "loan_status",
        F.when(F.col("scorecard_logit") + noise * F.lit(2.77) > F.lit(0.0), F.lit(1)).otherwise(F.lit(0)),
    )


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applicant table as the reference sees it: ten features + target, keyed by loan_id."""
    return credit_book(spark, sf_dir).select(KEY, *FEATURE_COLUMNS, TARGET)


def scored_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``credit_book`` + scorecard probability (4 dp), risk level and 0-100 risk score."""
    from lendscope.operators.scoring import with_risk

    return with_risk(credit_book(spark, sf_dir), sigmoid("scorecard_logit"))


def credit_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``credit_book`` plus a 70 %-empty column (exercises the sparse-column rule)."""
    book = applicants(spark, sf_dir)
    return book.withColumn(
        "mostly_null",
        F.when(F.col("loan_id") % F.lit(10) < F.lit(7), F.lit(None).cast("double"))
        .otherwise(F.col("loan_amnt").cast("double")),
    )


def events_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").drop("event_id")


def lineitem_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")


def lineitem_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows and columns of ``lineitem``, and the rows of every tenth order a second time: real duplicates.

    The time of shipping is text, which is the same in every session's time zone.
    """
    lines = read_table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
    return lines.unionAll(lines.where(F.col("l_orderkey") % F.lit(10) == 0))


def rule_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``credit_book`` with a rule-based segment id (grade order A..E -> 0..4)."""
    book = applicants(spark, sf_dir)
    seg = F.ascii(F.col("loan_grade")) - F.lit(65)
    return book.withColumn("segment", seg.cast("int"))
