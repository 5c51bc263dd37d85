"""Queries: features and split (D1-D9). Statistics are fitted on the train side of D6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.columns import r4
from lendscope.operators import features as D
from lendscope.operators import training as TR
from lendscope.plans import oracle
from lendscope.plans.oracle import r4 as sql_r4
from lendscope.plans.profile_queries import CAT_FEATURES, NUM_FEATURES
from lendscope.plans.fitted import memo
from lendscope.plans.registry import query
from lendscope.session import materialize
from lendscope.sources import tables as T

LABEL, KEY = "loan_status", "loan_id"


def split_applicants(spark: SparkSession, sf: str) -> DataFrame:
    return D.stratified_split(T.applicants(spark, sf), LABEL, KEY)


def fitted_on_train(spark: SparkSession, sf: str) -> tuple[DataFrame, D.FittedFeatures]:
    """The split, written once to the checkpoint folder, and preprocessing fitted on its train side
    (once per session and input)."""
    def fit():
        split = materialize(split_applicants(spark, sf))
        return split, D.fit_features(split.where("is_train"), NUM_FEATURES, CAT_FEATURES)

    return memo(spark, sf, "train_features", fit)


def prepared(spark: SparkSession, sf: str) -> TR.Prepared:
    """The applicant table, prepared end to end from detected roles (once per session and input)."""
    return memo(spark, sf, "prepared", lambda: TR.prepare(T.applicants(spark, sf)))


# ------------------------------------------------------------------ oracle CTEs

oracle._cte("split", ["applicants"], """
  select * exclude (h, n_c, rn), rn <= n_c - cast(round_even(0.2E0 * n_c, 0) as bigint) as is_train from (
    select *, count(*) over (partition by loan_status) as n_c,
           row_number() over (partition by loan_status order by h, loan_id) as rn
    from (select *, (((loan_id % 2147483648 + 2147483648) % 2147483648) * 2654435761) % 4294967296 as h from applicants))""")
oracle._cte("train_medians", ["split"], "select " + ", ".join(
    f"median(cast({c} as double)) as {c}" for c in NUM_FEATURES) + " from split where is_train")
oracle._cte("imputed", ["split", "train_medians"], "select s.loan_id, s.loan_status, s.is_train, " + ", ".join(
    f"coalesce(cast(s.{c} as double), m.{c}) as {c}" for c in NUM_FEATURES) + ", " + ", ".join(
    f"coalesce(s.{c}, 'missing') as {c}" for c in CAT_FEATURES) + " from split s, train_medians m")
oracle._cte("train_moments", ["imputed"], "select " + ", ".join(
    f"avg({c}) as {c}_m, case when coalesce(stddev_pop({c}), 0) = 0 then 1.0E0 else stddev_pop({c}) end as {c}_s"
    for c in NUM_FEATURES) + " from imputed where is_train")
oracle._cte("scaled", ["imputed", "train_moments"], "select i.loan_id, i.is_train, " + ", ".join(
    f"(i.{c} - t.{c}_m) / t.{c}_s as {c}" for c in NUM_FEATURES) + ", " + ", ".join(
    f"i.{c}" for c in CAT_FEATURES) + " from imputed i, train_moments t")
# Levels of each categorical column on the train side, sorted: the one-hot layout.
oracle._cte("levels", ["imputed"], " union all ".join(
    f"select distinct '{c}' as feature, {c} as level from imputed where is_train" for c in CAT_FEATURES))
oracle._cte("matrix_long", ["scaled", "levels"], " union all ".join(
    [f"select loan_id, is_train, {i} as pos0, '{c}' as feature, {c} as value from scaled"
     for i, c in enumerate(NUM_FEATURES)]
    + [f"""select s.loan_id, s.is_train, {len(NUM_FEATURES)} + {j} * 1000 + l.rk as pos0,
              '{c}_' || l.level as feature, case when s.{c} = l.level then 1.0E0 else 0.0E0 end as value
           from scaled s, (select level, row_number() over (order by level) as rk from levels
                           where feature = '{c}') l""" for j, c in enumerate(CAT_FEATURES)]))

# Roles as the data show them: numbers without a missing or repeated value are ids, no features.
oracle._cte("found_ids", ["applicants"], "select name from (" + " union all ".join(
    f"select '{c}' as name, count(distinct {c}) = count(*) and count(*) > 0 as is_id from applicants" for c in NUM_FEATURES) + ") where is_id")


# ------------------------------------------------------------------ queries

@query("train_test_split", """
select loan_status, is_train, count(*) as n, cast(sum(loan_id) as bigint) as id_sum,
       cast(sum(person_income) as bigint) as income_sum
from split group by loan_status, is_train""", ("split",))
def q_train_test_split(spark, sf):
    return split_applicants(spark, sf).groupBy(LABEL, "is_train").agg(
        F.count(F.lit(1)).alias("n"), F.sum(KEY).cast("bigint").alias("id_sum"),
        F.sum("person_income").cast("bigint").alias("income_sum"))


@query("median_impute", "select loan_id, " + ", ".join(f"{sql_r4(c)} as {c}" for c in NUM_FEATURES) + " from imputed", ("imputed",))
def q_median_impute(spark, sf):
    split, fitted = fitted_on_train(spark, sf)
    return split.select(KEY, *[r4(fitted.imputed(c)).alias(c) for c in NUM_FEATURES])


@query("standard_scale", "select loan_id, " + ", ".join(f"{sql_r4(c)} as {c}" for c in NUM_FEATURES)
       + " from scaled", ("scaled",))
def q_standard_scale(spark, sf):
    split, fitted = fitted_on_train(spark, sf)
    return split.select(KEY, *[r4(fitted.scaled(c)).alias(c) for c in NUM_FEATURES])


@query("constant_impute", "select loan_id, " + ", ".join(CAT_FEATURES) + " from imputed", ("imputed",))
def q_constant_impute(spark, sf):
    split = split_applicants(spark, sf)
    return split.select(KEY, *[F.coalesce(F.col(c), F.lit("missing")).alias(c) for c in CAT_FEATURES])


@query("one_hot", """
select loan_id, feature, value from matrix_long where pos0 >= 7""", ("matrix_long",))
def q_one_hot(spark, sf):
    split, fitted = fitted_on_train(spark, sf)
    long = D.matrix_long(split, fitted, KEY)
    return long.where(F.col("position") >= len(NUM_FEATURES)).select(KEY, "feature", "value")


@query("feature_matrix_long", f"""
select loan_id, cast(row_number() over (partition by loan_id order by pos0) - 1 as integer) as position,
       feature, {sql_r4('value')} as value
from matrix_long""", ("matrix_long",))
def q_feature_matrix_long(spark, sf):
    split, fitted = fitted_on_train(spark, sf)
    return D.matrix_long(split, fitted, KEY).select(KEY, "position", "feature", r4("value").alias("value"))


@query("class_weights", f"""
select loan_status, count(*) as n,
  {sql_r4('cast(sum(count(*)) over () as double) / cast(count(*) over () * count(*) as double)')} as weight
from split where is_train group by loan_status""", ("split",))
def q_class_weights(spark, sf):
    w = D.class_weights(split_applicants(spark, sf).where("is_train"), LABEL)
    return w.withColumn("weight", r4("weight"))


@query("scale_pos_weight", f"""
select {sql_r4('cast(count(*) filter (where loan_status = 0) as double) / cast(greatest(1, count(*) filter (where loan_status = 1)) as double)')}
  as scale_pos_weight from split where is_train""", ("split",))
def q_scale_pos_weight(spark, sf):
    train = split_applicants(spark, sf).where("is_train")
    return train.agg(r4(D.scale_pos_weight(train, LABEL)).alias("scale_pos_weight"))


@query("prepare_features", f"""
select case when is_train then 'train' else 'test' end as side, feature, count(*) as n,
       {sql_r4('avg(value)')} as mean, {sql_r4('stddev_pop(value)')} as std
from matrix_long where feature not in (select name from found_ids) group by is_train, feature""", ("matrix_long", "found_ids"))
def q_prepare_features(spark, sf):
    """D9 on the raw applicant table: target, id and roles are found, not given."""
    ready = prepared(spark, sf)
    long = D.matrix_long(ready.split, ready.fitted, ready.key, ["is_train"])
    return long.groupBy(F.when(F.col("is_train"), "train").otherwise("test").alias("side"), "feature").agg(
        F.count(F.lit(1)).alias("n"), r4(F.avg("value")).alias("mean"), r4(F.stddev_pop("value")).alias("std"))
