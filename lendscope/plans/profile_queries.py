"""Queries: profiling (B1-B13) and cleaning."""

from __future__ import annotations

from lendscope.operators import clean as C
from lendscope.operators import profile as B
from lendscope.plans import oracle
from lendscope.plans.oracle import r2 as sql_r2
from lendscope.plans.oracle import r3 as sql_r3
from lendscope.plans.oracle import r4 as sql_r4
from lendscope.plans.registry import query
from lendscope.sources import tables as T

# Applicant columns (the applicants view) and their roles, as the detectors find them.
APPLICANT_COLS = ["loan_id", "person_age", "person_income", "person_emp_length", "loan_intent", "loan_grade",
                  "loan_amnt", "loan_int_rate", "loan_percent_income", "cb_person_default_on_file",
                  "cb_person_cred_hist_length", "loan_status"]
DOUBLE_COLS = {"person_emp_length", "loan_int_rate", "loan_percent_income"}
NUM_FEATURES = ["person_age", "person_income", "person_emp_length", "loan_amnt", "loan_int_rate",
                "loan_percent_income", "cb_person_cred_hist_length"]
CAT_FEATURES = ["loan_intent", "loan_grade", "cb_person_default_on_file"]
ALL_NUMERIC = ["loan_id"] + NUM_FEATURES + ["loan_status"]


def _null_sql(c: str) -> str:
    return f"({c} is null or isnan({c}))" if c in DOUBLE_COLS or c == "mostly_null" else f"({c} is null)"


def _app(spark, sf):
    return T.applicants(spark, sf)


# ------------------------------------------------------------------ B1-B3

@query("dataset_overview", f"""
select count(*) as n_rows, {len(APPLICANT_COLS)} as n_cols,
  cast(sum({' + '.join(f'cast({_null_sql(c)} as bigint)' for c in APPLICANT_COLS)}) as bigint) as total_missing,
  count(*) - (select count(*) from (select distinct * from applicants)) as duplicate_rows
from applicants""", ("applicants",))
def q_dataset_overview(spark, sf):
    return B.dataset_overview(_app(spark, sf))


WIDE_COLS = APPLICANT_COLS + ["mostly_null"]


@query("missing_report", " union all ".join(
    f"select * from (select '{c}' as column_name, count(*) filter (where {_null_sql(c)}) as missing, "
    f"{sql_r2(f'cast(count(*) filter (where {_null_sql(c)}) as double) / cast(count(*) as double) * 100.0E0')} "
    f"as missing_pct from credit_wide) where missing > 0" for c in WIDE_COLS), ("credit_wide",))
def q_missing_report(spark, sf):
    return B.missing_report(T.credit_wide(spark, sf))


@query("duplicate_count", """
select count(*) - (select count(*) from (select distinct * from lineitem_flags)) as duplicate_rows
from lineitem_flags""", ("lineitem_flags",))
def q_duplicate_count(spark, sf):
    return B.duplicate_count(T.lineitem_flags(spark, sf))


@query("duplicate_count_lines", """
select count(*) - (select count(*) from (select distinct * from lineitem_repeated)) as duplicate_rows
from lineitem_repeated""", ("lineitem_repeated",))
def q_duplicate_count_lines(spark, sf):
    """Whole rows of lineitem."""
    return B.duplicate_count(T.lineitem_repeated(spark, sf))


@query("duplicate_count_events", """
select count(*) - (select count(*) from (select distinct * from events_plain)) as duplicate_rows
from events_plain""", ("events_plain",))
def q_duplicate_count_events(spark, sf):
    return B.duplicate_count(T.events_plain(spark, sf))


# ------------------------------------------------------------------ B5-B6

_CUSTOMER_ID_CANDIDATES = [("c_custkey", 0), ("c_nationkey", 2), ("c_acctbal", 3)]


@query("detect_id_columns", "select column_name, position, detected_by from (" + " union all ".join(
    f"select '{c}' as column_name, {i} as position, 'unique' as detected_by, "
    f"count(distinct {c}) = count(*) as ok from customer" for c, i in _CUSTOMER_ID_CANDIDATES) + ") where ok")
def q_detect_id_columns(spark, sf):
    return B.id_detection(T.read_table(spark, sf, "customer"))


_LABEL_NUMS = ["doc_id", "quality", "toxic"]


@query("detect_target_column", f"""
with s as (select {', '.join(
    f"count(*) filter (where {c} not in (0, 1)) as b{i}, avg(cast({c} as double)) as a{i}"
    for i, c in enumerate(_LABEL_NUMS))} from labels),
hit as (select {', '.join(f"b{i} = 0 and a{i} > 0.01E0 and a{i} < 0.90E0 as h{i}" for i in range(3))}, * from s)
select case {' '.join(f"when h{i} then '{c}'" for i, c in enumerate(_LABEL_NUMS))} end as target_column,
       'binary' as detected_by,
       {sql_r4('case ' + ' '.join(f'when h{i} then a{i}' for i in range(3)) + ' end')} as positive_rate
from hit where h0 or h1 or h2""")
def q_detect_target_column(spark, sf):
    return B.target_detection(T.read_table(spark, sf, "labels"))


# ------------------------------------------------------------------ B9-B12

TARGET_DIST_SQL = f"""
select loan_status, "count", share, default_rate, min(share_raw) over () < 0.15E0 as class_imbalanced from (
  select loan_status, count(*) as "count",
    {sql_r4('cast(count(*) as double) / cast(sum(count(*)) over () as double)')} as share,
    cast(count(*) as double) / cast(sum(count(*)) over () as double) as share_raw,
    {sql_r4('cast(sum(loan_status * count(*)) over () as double) / cast(sum(count(*)) over () as double)')} as default_rate
  from applicants where loan_status is not null group by loan_status)"""


@query("target_distribution", TARGET_DIST_SQL, ("applicants",))
def q_target_distribution(spark, sf):
    return B.target_distribution(_app(spark, sf), "loan_status")


@query("feature_schema_numeric", " union all ".join(
    f"select '{c}' as feature, {sql_r4(f'min(cast({c} as double))')} as min, "
    f"{sql_r4(f'max(cast({c} as double))')} as max, {sql_r4(f'avg(cast({c} as double))')} as mean, "
    f"{sql_r4(f'median(cast({c} as double))')} as median, {sql_r4(f'stddev_samp(cast({c} as double))')} as std, "
    f"{sql_r4(f'median(cast({c} as double))')} as default_value from applicants" for c in NUM_FEATURES),
    ("applicants",))
def q_feature_schema_numeric(spark, sf):
    return B.numeric_schema(_app(spark, sf), NUM_FEATURES)


_CAT_COUNTS = " union all ".join(
    f"select '{c}' as feature, {c} as value, count(*) as c from applicants where {c} is not null group by {c}"
    for c in CAT_FEATURES)


@query("feature_schema_categorical", f"""
select feature, value as category, rn = 1 as is_default,
  cast(row_number() over (partition by feature order by value) as integer) as position from (
  select *, row_number() over (partition by feature order by c desc, value) as rn from ({_CAT_COUNTS}))""",
       ("applicants",))
def q_feature_schema_categorical(spark, sf):
    return B.categorical_schema(_app(spark, sf), CAT_FEATURES)


@query("describe_numeric", " union all ".join(
    f"select '{c}' as feature, count({c}) as \"count\", "
    + ", ".join(f"{sql_r3(e)} as {n}" for n, e in [
        ("mean", f"avg(cast({c} as double))"), ("std", f"stddev_samp(cast({c} as double))"),
        ("min", f"min(cast({c} as double))"), ("p25", f"quantile_cont(cast({c} as double), 0.25)"),
        ("p50", f"quantile_cont(cast({c} as double), 0.5)"), ("p75", f"quantile_cont(cast({c} as double), 0.75)"),
        ("max", f"max(cast({c} as double))")])
    + " from applicants" for c in ALL_NUMERIC), ("applicants",))
def q_describe_numeric(spark, sf):
    return B.describe_numeric(_app(spark, sf), ALL_NUMERIC)


@query("describe_categorical", f"""
select feature, cast(sum(c) as bigint) as "count", count(*) as "unique",
       min(value) filter (where rn = 1) as top, max(c) as freq from (
  select *, row_number() over (partition by feature order by c desc, value) as rn from ({_CAT_COUNTS}))
group by feature""", ("applicants",))
def q_describe_categorical(spark, sf):
    return B.describe_categorical(_app(spark, sf), CAT_FEATURES)


# ------------------------------------------------------------------ B13

def _validation_sql() -> str:
    type_of = ("case typeof({c}) when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' "
               "when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' end")
    parts = [f"select 'shape' as section, 'n_cols' as name, {float(len(APPLICANT_COLS))} as value_num, "
             f"cast(null as varchar) as value_text"]
    parts += [f"select 'columns', '{c}', {float(i)}, (select {type_of.format(c=c)} from applicants limit 1)"
              for i, c in enumerate(APPLICANT_COLS)]
    # Roles from the data: ids by name or (numeric) all-distinct; the target by name.
    flags = " union all ".join(
        f"select '{c}' as name, {i} as ord, {str(c not in CAT_FEATURES).lower()} as is_num, "
        f"{str('id' in c.lower() or 'index' in c.lower() or 'uuid' in c.lower()).lower()} as by_name, "
        + (f"(select count(distinct {c}) = count(*) from applicants)" if c not in CAT_FEATURES else "false")
        + " as uniq" for i, c in enumerate(APPLICANT_COLS))
    roles = (f"(select *, by_name or uniq as is_id, name = 'loan_status' as is_target from ({flags}))")
    parts += [f"select 'id_columns', name, cast(row_number() over (order by ord) - 1 as double), null "
              f"from {roles} where is_id",
              "select 'target_column', 'loan_status', null, null",
              f"select 'numerical_columns', name, cast(row_number() over (order by ord) - 1 as double), null "
              f"from {roles} where is_num and not is_id and not is_target",
              f"select 'categorical_columns', name, cast(row_number() over (order by ord) - 1 as double), null "
              f"from {roles} where not is_num and not is_id and not is_target"]
    parts += ["select 'shape', 'n_rows', cast(count(*) as double), null from applicants",
              "select 'duplicates', 'duplicate_rows', cast(count(*) - (select count(*) from "
              "(select distinct * from applicants)) as double), null from applicants",
              "select 'missing', 'total_missing', cast(sum("
              + " + ".join(f"cast({_null_sql(c)} as bigint)" for c in APPLICANT_COLS) + ") as double), null from applicants"]
    for c in APPLICANT_COLS:
        miss = f"count(*) filter (where {_null_sql(c)})"
        parts.append(f"select * from (select 'missing_values', '{c}', cast({miss} as double) as v, null from applicants) "
                     f"where v > 0")
        parts.append(f"select * from (select 'missing_pct', '{c}', "
                     f"{sql_r2(f'cast({miss} as double) / cast(count(*) as double) * 100.0E0')} as v, null "
                     f"from applicants) where v > 0")
    parts.append("select 'target_distribution', cast(loan_status as varchar), share, null from target_dist")
    parts.append("select distinct 'target', 'default_rate', default_rate, null from target_dist")
    parts.append("select distinct 'target', 'class_imbalanced', cast(class_imbalanced as double), null from target_dist")
    return "\nunion all ".join(parts)


oracle._cte("target_dist", ["applicants"], TARGET_DIST_SQL)


@query("validation_report", _validation_sql(), ("applicants", "target_dist"))
def q_validation_report(spark, sf):
    return B.validation_report(_app(spark, sf))


# ------------------------------------------------------------------ C1-C6

@query("drop_duplicates", "select distinct * from lineitem_flags", ("lineitem_flags",))
def q_drop_duplicates(spark, sf):
    return C.drop_duplicates(T.lineitem_flags(spark, sf))


@query("drop_duplicates_lines", "select distinct * from lineitem_repeated", ("lineitem_repeated",))
def q_drop_duplicates_lines(spark, sf):
    """Whole rows of lineitem."""
    return C.drop_duplicates(T.lineitem_repeated(spark, sf))


@query("drop_sparse_columns", "select distinct * exclude (mostly_null) from credit_wide", ("credit_wide",))
def q_drop_sparse_columns(spark, sf):
    return C.clean(T.credit_wide(spark, sf))


@query("feature_projection", f"""
select {', '.join(c for c in APPLICANT_COLS if c not in ('loan_id', 'loan_status'))},
       cast(loan_status as integer) as y from applicants""", ("applicants",))
def q_feature_projection(spark, sf):
    return C.feature_projection(_app(spark, sf), "loan_status", ["loan_id"])


TRAINED = NUM_FEATURES + CAT_FEATURES
TRAINED_TYPES = {c: ("double" if c in DOUBLE_COLS else "bigint") for c in NUM_FEATURES} | \
    {c: "string" for c in CAT_FEATURES}


@query("align_columns", "select " + ", ".join(
    (f"cast(null as {'double' if TRAINED_TYPES[c] == 'double' else 'varchar'}) as {c}"
     if c in ("person_emp_length", "loan_intent") else c) for c in TRAINED) + " from credit_book", ("credit_book",))
def q_align_columns(spark, sf):
    partial = T.credit_book(spark, sf).drop("person_emp_length", "loan_intent")
    return C.align_columns(partial, TRAINED, TRAINED_TYPES)


@query("validate_input", "select loan_id, coalesce(case " + " ".join(
    f"when {c} is null then 'Field ''{c}'' must be numeric, got: None'" for c in NUM_FEATURES)
    + " end, '') as error_message, coalesce(case " + " ".join(f"when {c} is null then false" for c in NUM_FEATURES)
    + " end, true) as is_valid from applicants", ("applicants",))
def q_validate_input(spark, sf):
    return C.validate_rows(_app(spark, sf), NUM_FEATURES, CAT_FEATURES).select(
        "loan_id", "error_message", "is_valid")

