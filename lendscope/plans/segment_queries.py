"""Queries: segmentation on rule clusters.

``rule_clusters`` puts every applicant in the segment of its loan grade (A..E ->
0..4), so profiles, labels and the label join can be checked by SQL without a
fitted model; the K-Means path (J2-J5) is in ``model_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendscope.operators import segments as J
from lendscope.plans import oracle
from lendscope.plans.oracle import r2 as sql_r2
from lendscope.plans.registry import query
from lendscope.sources import tables as T

TARGET = "loan_status"
ID_COLS = ["loan_id"]
# Segmentation features of the applicant table (J1 applied to its schema).
SEG_FEATURES = ["person_income", "loan_amnt", "loan_int_rate", "loan_percent_income",
                "person_age", "person_emp_length", "cb_person_cred_hist_length"]


def rule_segments(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], DataFrame]:
    """(rows with ``segment``, features, labelled profiles) for the grade clusters."""
    df = T.rule_clusters(spark, sf)
    feats = J.select_segmentation_features(T.applicants(spark, sf), TARGET, ID_COLS)
    prof = J.segment_profiles(df, "segment", feats, TARGET)
    return df, feats, J.segment_labels(prof)


# ------------------------------------------------------------- oracle CTEs

def _profile_sql(src: str, feats: list[str]) -> str:
    parts = []
    for f in feats:
        x = f"cast({f} as double)"
        parts += [f"{sql_r2(f'avg({x})')} as {f}_mean",
                  f"{sql_r2(f'median({x})')} as {f}_median",
                  f"{sql_r2(f'stddev_samp({x})')} as {f}_std"]
    parts.append(f"{sql_r2('avg(cast(loan_status as double))')} as default_rate")
    parts.append("count(*) as cluster_size")
    return f"select segment, {', '.join(parts)} from {src} group by segment"


def _label_sql(src: str) -> str:
    def rank(c):
        return (f"case when {c} is null then null else (rank() over (order by {c}) "
                f"+ (count(*) over (partition by {c}) - 1) / 2.0E0) / count(*) over () end")
    return f"""
    select * exclude (ir, dr), case
        when coalesce(dr >= 0.75E0, false) then 'High-Risk Customer'
        when coalesce(ir >= 0.75E0 and dr < 0.50E0, false) then 'Premium Customer'
        when coalesce(ir < 0.35E0 and dr >= 0.50E0, false) then 'Emerging Customer'
        else 'Stable Customer' end as segment_label
    from (select *, {rank('person_income_mean')} as ir, {rank('default_rate')} as dr from {src})"""


oracle._cte("rule_profiles", ["rule_clusters"], _profile_sql("rule_clusters", SEG_FEATURES))
oracle._cte("rule_labels", ["rule_profiles"], _label_sql("rule_profiles"))


# ------------------------------------------------------------- queries

PROFILE_COLS = ["segment"] + [f"{f}_{s}" for f in SEG_FEATURES for s in ("mean", "median", "std")] + \
    ["default_rate", "cluster_size"]


@query("segment_profiles", "select * from rule_profiles", ("rule_profiles",))
def q_segment_profiles(spark, sf):
    df = T.rule_clusters(spark, sf)
    feats = J.select_segmentation_features(T.applicants(spark, sf), TARGET, ID_COLS)
    return J.segment_profiles(df, "segment", feats, TARGET)


@query("segment_labels", "select segment, cluster_size, default_rate, person_income_mean, segment_label from rule_labels",
       ("rule_labels",))
def q_segment_labels(spark, sf):
    _, _, labelled = rule_segments(spark, sf)
    return labelled.select("segment", "cluster_size", "default_rate", "person_income_mean", "segment_label")


@query("segment_means_long", " union all ".join(
    f"select segment, segment_label, '{f}_mean' as feature, {f}_mean as mean_value from rule_labels"
    for f in SEG_FEATURES), ("rule_labels",))
def q_segment_means_long(spark, sf):
    _, _, labelled = rule_segments(spark, sf)
    return J.means_long(labelled)


@query("segment_label_lookup", """
select r.loan_id, r.segment, coalesce(l.segment_label, 'Segment ' || cast(r.segment as varchar)) as segment_label
from rule_clusters r left join rule_labels l on l.segment = r.segment""", ("rule_clusters", "rule_labels"))
def q_segment_label_lookup(spark, sf):
    df, _, labelled = rule_segments(spark, sf)
    return J.label_lookup(df.select("loan_id", "segment"), labelled)


@query("segment_profile_view", """
select segment, segment_label, cluster_size, person_income_mean, person_income_median, loan_amnt_mean,
       loan_amnt_median, loan_int_rate_mean, loan_int_rate_median, loan_percent_income_mean,
       loan_percent_income_median
from rule_labels""", ("rule_labels",))
def q_segment_profile_view(spark, sf):
    _, _, labelled = rule_segments(spark, sf)
    return J.profile_view(labelled)


@query("segment_default_rates", """
select segment, segment_label, cluster_size, default_rate,
       round_even(cast(cluster_size as double) / cast(sum(cluster_size) over () as double) * 10000.0E0, 0)
         / 10000.0E0 as size_share
from rule_labels""", ("rule_labels",))
def q_segment_default_rates(spark, sf):
    _, _, labelled = rule_segments(spark, sf)
    return J.default_rates(labelled)

