"""Queries: cross-sell rules (K1-K9, L7) on the scorecard path.

Applicants carry the scorecard probability / risk level (``scored``) and the
label of their grade segment (``rule_labels``), the inputs the rules need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope import settings as S
from lendscope.functions.columns import r2
from lendscope.operators import products as K
from lendscope.operators import segments as J
from lendscope.plans import oracle
from lendscope.plans.fitted import memo
from lendscope.plans.registry import query
from lendscope.plans.segment_queries import rule_segments
from lendscope.sources import tables as T


def rule_label_map(spark: SparkSession, sf: str) -> dict:
    """Labels of the grade segments, computed once per input (the fitted segment artefact)."""
    return memo(spark, sf, "rule_labels", lambda: J.label_map(rule_segments(spark, sf)[2]))


def scored_labeled(spark: SparkSession, sf: str) -> DataFrame:
    """Scored applicants with the label of their grade segment (literal map lookup)."""
    scored = T.scored_book(spark, sf).withColumn("segment", (F.ascii("loan_grade") - F.lit(65)).cast("int"))
    return J.attach_labels(scored, rule_label_map(spark, sf))


# ------------------------------------------------------------- oracle text


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(names) -> str:
    return "(" + ", ".join(_sq(n) for n in sorted(names)) + ")"


_CATALOGUE_VALUES = ",\n    ".join(
    f"({i}, {_sq(p)}, {base}, {str('LOW' in lv).lower()}, {str('MEDIUM' in lv).lower()}, "
    f"{str('HIGH' in lv).lower()}, {_sq(desc)})"
    for i, (p, lv, desc, base) in enumerate(S.PRODUCT_CATALOGUE))


def rules_sql(src: str, keys: str, prob: str, income: str, lti: str) -> str:
    """Rule scores for every (row of ``src``, product) as independent SQL.

    ``keys``: comma-separated column names of ``src`` carried to the output.
    """
    tier = (f"case when {income} is null then 'unknown' when {income} > 120000 then 'high' "
            f"when {income} > 50000 then 'medium' else 'low' end")
    tenths = f"cast(round_even({prob} * 1000.0E0, 0) as bigint)"
    pct = f"cast({tenths} // 10 as varchar) || '.' || cast({tenths} % 10 as varchar)"
    return f"""
    with cat(ordinal, product, base_score, allow_low, allow_medium, allow_high, description) as (values
    {_CATALOGUE_VALUES}),
    x as (
      select src.*, {lti} as lti_v, {tier} as tier,
             c.ordinal, c.product, c.base_score, c.description,
             coalesce(case risk_level when 'LOW' then allow_low when 'MEDIUM' then allow_medium
                                      when 'HIGH' then allow_high end, false) as allowed
      from {src} src cross join cat c),
    s1 as (
      select *, base_score + case risk_level when 'LOW' then 10 when 'MEDIUM' then -5 else 0 end
        + case when tier = 'high' and product in {_in(K.HIGH_INCOME_BOOST)} then 12
               when tier = 'high' and product in {_in(K.HIGH_INCOME_SMALL_BOOST)} then 8 else 0 end as sc1,
        case risk_level when 'LOW' then 'Low default risk (' || {pct} || '%) makes this a strong fit.'
                        when 'MEDIUM' then 'Moderate risk (' || {pct} || '%). Standard eligibility criteria apply.'
                        else description end
        || case when tier = 'high' and product in {_in(K.HIGH_INCOME_BOOST)} then {_sq(S.REASON_HIGH_INCOME)} else '' end
        || case when tier = 'low' and product in {_in(K.LOW_INCOME_CUT)} then {_sq(S.REASON_LOW_INCOME)} else '' end
        || case when lti_v > 0.40E0 and product in {_in(K.HIGH_LTI_CUT)} then {_sq(S.REASON_HIGH_LTI)}
                when lti_v < 0.15E0 and product in {_in(K.LOW_LTI_BOOST)} then {_sq(S.REASON_LOW_LTI)} else '' end
        || case when coalesce(segment_label like '%High-Risk%', false) and product in {_in(K.SAFETY)}
                then {_sq(S.REASON_SAFETY)} else '' end as reason1
      from x),
    s2 as (
      select *, case when tier = 'low' and product in {_in(K.LOW_INCOME_CUT)} then greatest(sc1 - 20, 10) else sc1 end
        + case when lti_v > 0.40E0 and product in {_in(K.HIGH_LTI_CUT)} then -15
               when lti_v < 0.15E0 and product in {_in(K.LOW_LTI_BOOST)} then 8 else 0 end
        + case when coalesce(segment_label like '%Premium%', false) and product = 'Premium Banking Account' then 15 else 0 end
        + case when coalesce(segment_label like '%High-Risk%', false) and product in {_in(K.SAFETY)} then 10
               when coalesce(segment_label like '%High-Risk%', false) and product in {_in(K.CREDIT)} then -20 else 0 end
        + case when coalesce(segment_label like '%Emerging%', false) and product = 'Savings Account' then 8 else 0 end
        as sc2
      from s1),
    s3 as (
      select *, case when allowed then least(100, greatest(0, sc2)) else 0 end as score,
                case when allowed then reason1 else {_sq(S.REASON_NOT_ALLOWED)} end as reason
      from s2)
    select {keys}, ordinal, product, cast(score as integer) as score, reason,
      case when risk_level = 'LOW' and score >= 80 then {_sq(S.NOTE_STRONG)}
           when score >= 70 then {_sq(S.NOTE_GOOD)} else {_sq(S.NOTE_CONDITIONAL)} end as eligibility_note
    from s3"""


oracle._cte("scored_labeled", ["scored", "rule_labels"], """
  select s.*, l.segment_label from scored s
  left join rule_labels l on l.segment = cast(ascii(s.loan_grade) - 65 as integer)""")
oracle._cte("product_rules", ["scored_labeled"],
            rules_sql("scored_labeled", "loan_id", "default_prob", "person_income", "loan_percent_income"))


# ------------------------------------------------------------- queries


@query("income_tier", """
select loan_id, person_income, case when person_income is null then 'unknown' when person_income > 120000 then 'high'
  when person_income > 50000 then 'medium' else 'low' end as income_tier from applicants""", ("applicants",))
def q_income_tier(spark, sf):
    return K.income_tiers(T.applicants(spark, sf)).select("loan_id", "person_income", "income_tier")


@query("product_scores", "select loan_id, ordinal, product, score from product_rules", ("product_rules",))
def q_product_scores(spark, sf):
    return K.product_scores(scored_labeled(spark, sf), ["loan_id"]).select("loan_id", "ordinal", "product", "score")


@query("recommendation_reasons", "select loan_id, product, reason from product_rules", ("product_rules",))
def q_recommendation_reasons(spark, sf):
    return K.product_scores(scored_labeled(spark, sf), ["loan_id"]).select("loan_id", "product", "reason")


@query("eligibility_notes", "select loan_id, product, score, eligibility_note from product_rules where score > 0",
       ("product_rules",))
def q_eligibility_notes(spark, sf):
    return (K.product_scores(scored_labeled(spark, sf), ["loan_id"])
            .where(F.col("score") > 0).select("loan_id", "product", "score", "eligibility_note"))


TOP_N_SQL = """
select loan_id, cast(rank as integer) as rank, product, score, reason, eligibility_note from (
  select *, row_number() over (partition by loan_id order by score desc, ordinal) as rank
  from product_rules where score > 0) where rank <= 5"""


@query("recommend_top_n", TOP_N_SQL, ("product_rules",))
def q_recommend_top_n(spark, sf):
    return K.recommend_top_n(scored_labeled(spark, sf), ["loan_id"], top_n=S.DEFAULT_TOP_N)


OPPS_SQL = """
select c.ordinal, c.product, cast(count(s.loan_id) as bigint) as suitable_customers
from (values {values}) c(ordinal, product, levels)
left join scored s on list_contains(c.levels, s.risk_level)
group by c.ordinal, c.product"""
_OPP_VALUES = ", ".join(
    f"({i}, {_sq(p)}, [{', '.join(_sq(x) for x in lv)}])" for i, (p, lv, _, _) in enumerate(S.PRODUCT_CATALOGUE))


@query("portfolio_opportunities", OPPS_SQL.format(values=_OPP_VALUES), ("scored",))
def q_portfolio_opportunities(spark, sf):
    return K.portfolio_opportunities(T.scored_book(spark, sf))


@query("portfolio_opportunities_unscored", f"""
select c.ordinal, c.product, (select count(*) from applicants) as suitable_customers
from (values {", ".join(f"({i}, {_sq(p)})" for i, (p, *_) in enumerate(S.PRODUCT_CATALOGUE))}) c(ordinal, product)""",
       ("applicants",))
def q_portfolio_opportunities_unscored(spark, sf):
    return K.portfolio_opportunities(T.applicants(spark, sf), risk_col=None)


@query("opportunity_ranking", f"""
select *, cast(row_number() over (order by suitable_customers, ordinal) as integer) as rank
from ({OPPS_SQL.format(values=_OPP_VALUES)})""", ("scored",))
def q_opportunity_ranking(spark, sf):
    return K.opportunity_ranking(K.portfolio_opportunities(T.scored_book(spark, sf)))


# K9: the recommendation page's profile grid, re-aimed over the portfolio's own profiles.
_PROFILE_PROB = ("case risk_level when 'LOW' then 0.15E0 when 'MEDIUM' then 0.45E0 "
                 "when 'HIGH' then 0.75E0 end")
oracle._cte("profile_groups", ["scored_labeled"], f"""
  select risk_level, segment_label, count(*) as customers, avg(cast(person_income as double)) as mean_income,
         {_PROFILE_PROB} as page_prob
  from scored_labeled group by risk_level, segment_label""")
oracle._cte("profile_rules", ["profile_groups"],
            rules_sql("profile_groups", "risk_level, segment_label, customers, mean_income",
                      "page_prob", "mean_income", "cast(null as double)"))


@query("recommend_by_profile", f"""
select risk_level, segment_label, customers, {oracle.r2('mean_income')} as mean_income,
       cast(rank as integer) as rank, product, score, reason, eligibility_note from (
  select *, row_number() over (partition by risk_level, segment_label order by score desc, ordinal) as rank
  from profile_rules where score > 0) where rank <= 9""", ("profile_rules",))
def q_recommend_by_profile(spark, sf):
    groups = scored_labeled(spark, sf).groupBy("risk_level", "segment_label").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col("person_income").cast("double")).alias("mean_income"),
    )
    probs = S.RECOMMENDATION_PAGE_PROBS
    groups = groups.withColumn(
        "page_prob",
        F.when(F.col("risk_level") == "LOW", F.lit(probs["LOW"]))
        .when(F.col("risk_level") == "MEDIUM", F.lit(probs["MEDIUM"]))
        .when(F.col("risk_level") == "HIGH", F.lit(probs["HIGH"])),
    )
    recs = K.recommend_top_n(groups, ["risk_level", "segment_label", "customers", "mean_income"],
                             top_n=len(K.PRODUCTS), prob="page_prob", income="mean_income", lti=None)
    return recs.withColumn("mean_income", r2("mean_income"))
