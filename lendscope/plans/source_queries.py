"""Queries: CSV round trips (A1, A2) through the shared scratch folder."""

from __future__ import annotations

from lendscope.plans.registry import query
from lendscope.session import scratch_path, slug
from lendscope.sources import csv as CSV
from lendscope.sources import tables as T


@query("csv_scan", "select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey from nation")
def q_csv_scan(spark, sf):
    path = scratch_path(spark, f"csv/{slug(sf)}/nation")
    CSV.write_csv(T.read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return CSV.read_csv(spark, path)


@query("csv_scan_orders", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar) as o_orderdate, o_orderpriority
from orders""")
def q_csv_scan_orders(spark, sf):
    """Every column of a table that grows; no field holds a line break, so files are split."""
    path = scratch_path(spark, f"csv/{slug(sf)}/orders")
    orders = T.read_table(spark, sf, "orders")
    CSV.write_csv(orders.withColumn("o_orderdate", orders["o_orderdate"].cast("string")), path)
    return CSV.read_csv(spark, path)


@query("csv_roundtrip_applicants", """
select loan_id, person_age,
       person_income, person_emp_length, loan_intent, loan_grade,
       loan_amnt, loan_int_rate, loan_percent_income, cb_person_default_on_file,
       cb_person_cred_hist_length, cast(loan_status as bigint) as loan_status
from applicants""", ("applicants",))
def q_csv_roundtrip_applicants(spark, sf):
    """Applicants with NULLs written as CSV and read back: NULLs and doubles survive, types re-inferred."""
    path = scratch_path(spark, f"csv/{slug(sf)}/applicants")
    CSV.write_csv(T.applicants(spark, sf), path)
    return CSV.read_csv(spark, path)
