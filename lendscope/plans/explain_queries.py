"""Queries: explanations (I1-I5) with signed train-side correlations as linear weights."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lendscope.functions.columns import r4
from lendscope.operators import explain as I
from lendscope.plans import oracle
from lendscope.plans.feature_queries import KEY, LABEL, fitted_on_train
from lendscope.plans.oracle import r4 as sql_r4
from lendscope.plans.fitted import memo
from lendscope.plans.registry import query

def explained(spark: SparkSession, sf: str):
    """(split, fitted features, weights, train means) for one input folder."""
    def fit():
        split, fitted = fitted_on_train(spark, sf)
        train = split.where("is_train")
        return split, fitted, I.signed_correlations(train, fitted, LABEL), I.feature_means(train, fitted)

    return memo(spark, sf, "explained", fit)


oracle._cte("feat_weights", ["matrix_long", "split"], """
  select m.feature, cast(dense_rank() over (order by m.pos0) - 1 as integer) as position,
         coalesce(corr(m.value, cast(s.loan_status as double)), 0.0E0) as w, avg(m.value) as mu
  from matrix_long m join split s on s.loan_id = m.loan_id
  where m.is_train group by m.feature, m.pos0""")
oracle._cte("contrib", ["matrix_long", "feat_weights"], """
  select m.loan_id, w.position, m.feature as raw_feature, m.value * w.w as contribution,
         w.w * (m.value - w.mu) as attribution
  from matrix_long m join feat_weights w on w.feature = m.feature""")

PRETTY_SQL = ("array_to_string(list_transform(string_split(replace(replace(replace(replace({c}, 'num__', ''), "
           "'cat__', ''), '_', ' '), '  ', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')")


@query("contributions", f"""
select loan_id, position, raw_feature, {sql_r4('contribution')} as contribution from contrib""", ("contrib",))
def q_contributions(spark, sf):
    split, fitted, w, _ = explained(spark, sf)
    out = I.contributions(split, fitted, w, [KEY])
    return out.select(KEY, "position", "raw_feature", r4("contribution").alias("contribution"))


@query("top_risk_factors", f"""
select loan_id, direction, cast(rank as integer) as rank, {PRETTY_SQL.format(c='raw_feature')} as feature, raw_feature,
       {sql_r4('contribution')} as contribution,
       case when direction = 'risk' then 'Contributing factor toward higher predicted risk.'
            else 'Contributing factor toward lower predicted risk.' end as description
from (select *, row_number() over (partition by loan_id, direction order by abs(contribution) desc, position) as rank
      from (select *, case when contribution > 0 then 'risk' else 'positive' end as direction from contrib))
where rank <= 5""", ("contrib",))
def q_top_risk_factors(spark, sf):
    split, fitted, w, _ = explained(spark, sf)
    return I.top_factors(split, fitted, w, [KEY])


@query("linear_attribution", f"""
select loan_id, {sql_r4('sum(attribution)')} as attribution from contrib group by loan_id""", ("contrib",))
def q_linear_attribution(spark, sf):
    from pyspark.sql import functions as F

    split, fitted, w, mu = explained(spark, sf)
    each = I.contribution_array(fitted, w, center=mu)
    total = F.aggregate(F.transform(each, lambda e: e["contribution"]), F.lit(0.0), lambda s, c: s + c)
    return split.select(KEY, r4(total).alias("attribution"))  # in the row: nothing to exchange


@query("top_features", f"""
select {PRETTY_SQL.format(c='feature')} as feature, feature as raw_feature, position, {sql_r4('abs(w)')} as importance,
       cast(rank as integer) as rank
from (select *, row_number() over (order by round_even(abs(w) * 1e11, 0) desc, position) as rank
      from feat_weights) where rank <= 15""",
       ("feat_weights",))
def q_top_features(spark, sf):
    _, fitted, w, _ = explained(spark, sf)
    return I.top_features(spark, fitted.feature_names, [round(abs(v), 11) for v in w])  # equal up to summation order: the two levels of a binary column
