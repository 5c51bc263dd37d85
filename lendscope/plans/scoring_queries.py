"""Queries: scorecard (E), risk classification (H1) and dashboard aggregates."""

from __future__ import annotations

from lendscope.functions.columns import r4
from lendscope.operators import dashboard as L
from lendscope.operators import scorecard as E
from lendscope.plans.oracle import r4 as sql_r4
from lendscope.plans.registry import query
from lendscope.sources import tables as T

# ---------------------------------------------------------------- scorecard


@query("loan_to_income", f"""
select loan_id, {sql_r4('cast(loan_amnt as double) / cast(person_income as double)')} as loan_to_income
from applicants""", ("applicants",))
def q_loan_to_income(spark, sf):
    return E.loan_to_income(T.applicants(spark, sf)).select("loan_id", "loan_to_income")


@query("clip_bounds", """
select loan_id,
  case when person_income is not null then greatest(12000, least(500000, person_income)) end as person_income,
  case when person_emp_length is not null then greatest(0, least(40, person_emp_length)) end as person_emp_length,
  case when loan_amnt is not null then greatest(500, least(50000, loan_amnt)) end as loan_amnt,
  case when cb_person_cred_hist_length is not null then greatest(1, least(45, cb_person_cred_hist_length)) end as cb_person_cred_hist_length
from applicants""", ("applicants",))
def q_clip_bounds(spark, sf):
    return E.clip_bounds(T.applicants(spark, sf)).select(
        "loan_id", "person_income", "person_emp_length", "loan_amnt", "cb_person_cred_hist_length")


@query("grade_lookup", """
select loan_id, loan_grade,
  case loan_grade when 'A' then 0.0E0 when 'B' then 0.1E0 when 'C' then 0.2E0 when 'D' then 0.35E0
                  when 'E' then 0.5E0 when 'F' then 0.65E0 end as grade_risk,
  case loan_grade when 'A' then 5.0E0 when 'B' then 8.5E0 when 'C' then 11.5E0 when 'D' then 14.5E0
                  when 'E' then 17.5E0 when 'F' then 21.0E0 end as rate_band_low,
  case loan_grade when 'A' then 8.5E0 when 'B' then 11.5E0 when 'C' then 14.5E0 when 'D' then 17.5E0
                  when 'E' then 21.0E0 when 'F' then 25.0E0 end as rate_band_high
from applicants""", ("applicants",))
def q_grade_lookup(spark, sf):
    return E.grade_lookup(T.applicants(spark, sf)).select(
        "loan_id", "loan_grade", "grade_risk", "rate_band_low", "rate_band_high")


@query("scorecard", f"""
select loan_id, {sql_r4('scorecard_logit')} as scorecard_logit,
  {sql_r4('1.0E0 / (1.0E0 + exp(-scorecard_logit))')} as scorecard_prob,
  case when scorecard_logit > 0.0E0 then 1 else 0 end as scorecard_label
from credit_book""", ("credit_book",))
def q_scorecard(spark, sf):
    out = E.scorecard(T.applicants(spark, sf))
    return out.select("loan_id", r4("scorecard_logit").alias("scorecard_logit"),
                      "scorecard_prob", "scorecard_label")


# ---------------------------------------------------------------- risk level


@query("classify_risk", "select loan_id, default_prob, risk_level, risk_score from scored", ("scored",))
def q_classify_risk(spark, sf):
    return T.scored_book(spark, sf).select("loan_id", "default_prob", "risk_level", "risk_score")


@query("batch_score", """
select loan_id, person_age, person_income, person_emp_length, loan_intent, loan_grade, loan_amnt, loan_int_rate,
       loan_percent_income, cb_person_default_on_file, cb_person_cred_hist_length, loan_status,
       default_prob, risk_level, risk_score
from scored""", ("scored",))
def q_batch_score(spark, sf):
    """H2 on the scorecard probability: every applicant row plus its three scoring columns."""
    from lendscope.functions.columns import sigmoid
    from lendscope.operators.scorecard import scorecard_logit
    from lendscope.operators.scoring import with_risk

    return with_risk(T.applicants(spark, sf), sigmoid(scorecard_logit()))


# ---------------------------------------------------------------- dashboard


@query("risk_distribution", 'select risk_level, count(*) as "count" from scored group by risk_level',
       ("scored",))
def q_risk_distribution(spark, sf):
    return L.risk_distribution(T.scored_book(spark, sf))


@query("default_distribution", """
select case loan_status when 0 then 'No Default' when 1 then 'Default' end as status, count(*) as "count"
from applicants group by loan_status""", ("applicants",))
def q_default_distribution(spark, sf):
    return L.default_distribution(T.applicants(spark, sf))


@query("portfolio_kpis", f"""
select count(*) as total_customers,
  {sql_r4('avg(cast(loan_status as double))')} as default_rate,
  count(*) filter (where risk_level = 'HIGH') as high_risk,
  count(*) filter (where risk_level = 'MEDIUM') as medium_risk,
  count(*) filter (where risk_level = 'LOW') as low_risk,
  {sql_r4('avg(default_prob)')} as avg_default_prob,
  count(*) filter (where risk_level = 'MEDIUM') + count(*) filter (where risk_level = 'LOW') as cross_sell_opportunities
from scored""", ("scored",))
def q_portfolio_kpis(spark, sf):
    return L.portfolio_kpis(T.scored_book(spark, sf))


@query("portfolio_kpis_unscored", f"""
select count(*) as total_customers,
  {sql_r4('avg(cast(loan_status as double))')} as default_rate,
  cast(sum(loan_status) as bigint) as high_risk,
  cast(0 as bigint) as medium_risk,
  count(*) - cast(sum(loan_status) as bigint) as low_risk,
  {sql_r4('avg(cast(loan_status as double))')} as avg_default_prob,
  count(*) - cast(sum(loan_status) as bigint) as cross_sell_opportunities
from applicants""", ("applicants",))
def q_portfolio_kpis_unscored(spark, sf):
    return L.portfolio_kpis(T.applicants(spark, sf))


@query("scatter_sample", """
select loan_id, person_income, loan_amnt, loan_status from applicants
order by ((loan_id % 2147483648) * 2654435761) % 4294967296, loan_id
limit 2000""", ("applicants",))
def q_scatter_sample(spark, sf):
    return L.scatter_sample(T.applicants(spark, sf), "loan_id", ["person_income", "loan_amnt", "loan_status"])


PREVIEW_VALUES = ["AUTOMOBILE", "MACHINERY"]


@query("explorer_preview", """
select * from applicants where loan_intent in ('AUTOMOBILE', 'MACHINERY') order by loan_id limit 500""",
       ("applicants",))
def q_explorer_preview(spark, sf):
    return L.explorer_preview(T.applicants(spark, sf), "loan_id", "loan_intent", PREVIEW_VALUES)


@query("filter_values", "select loan_intent, cast(row_number() over (order by loan_intent) as integer) as position "
       "from (select distinct loan_intent from applicants where loan_intent is not null)",
       ("applicants",))
def q_filter_values(spark, sf):
    return L.filter_values(T.applicants(spark, sf), "loan_intent")


@query("target_counts", f"""
select loan_status, count(*) as "count",
  {'round_even((cast(sum(loan_status * count(*)) over () as double) / cast(sum(count(*)) over () as double)) * 100.0E0 * 100.0E0, 0) / 100.0E0'} as default_rate_pct
from applicants group by loan_status""", ("applicants",))
def q_target_counts(spark, sf):
    return L.target_counts(T.applicants(spark, sf))

