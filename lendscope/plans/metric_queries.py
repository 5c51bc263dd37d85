"""Queries: evaluation (G1-G7) on the scorecard probability and two other rule scores.

The rule scores stand in for trained candidates so that every metric and the
model choice can be checked by SQL; fitted models reuse the same operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.functions.columns import sigmoid
from lendscope.operators import metrics as G
from lendscope.operators.scorecard import grade_risk
from lendscope.plans import oracle
from lendscope.plans.oracle import r4 as sql_r4
from lendscope.plans.registry import query
from lendscope.sources import tables as T


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """(model, ordinal, y, p) for three rule scores over every scored applicant."""
    scored = T.scored_book(spark, sf)
    return G.long_scores(scored, "loan_status", [
        ("Scorecard", sigmoid("scorecard_logit")),
        ("Grade rule", F.lit(0.1) + grade_risk("loan_grade")),
        ("Prior default", F.when(F.col("cb_person_default_on_file") == "Y", F.lit(0.8)).otherwise(F.lit(0.2))),
    ])


def scorecard_eval(spark: SparkSession, sf: str) -> DataFrame:
    return T.scored_book(spark, sf).select(F.col("loan_status").alias("y"), sigmoid("scorecard_logit").alias("p"))


# ------------------------------------------------------------------ oracle CTEs

_PROB = "1.0E0 / (1.0E0 + exp(-scorecard_logit))"  # unrounded
oracle._cte("eval_one", ["scored"], f"select loan_status as y, {_PROB} as p from scored")
oracle._cte("eval_long", ["scored"], f"""
  select 'Scorecard' as model, 0 as ordinal, loan_status as y, {_PROB} as p from scored
  union all select 'Grade rule', 1, loan_status, 0.1E0 + case loan_grade when 'A' then 0.0E0 when 'B' then 0.1E0 when 'C' then 0.2E0 when 'D' then 0.35E0 when 'E' then 0.5E0 when 'F' then 0.65E0 end from scored
  union all select 'Prior default', 2, loan_status, case when cb_person_default_on_file = 'Y' then 0.8E0 else 0.2E0 end from scored""")


def _counts_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (f"select {g}count(*) filter (where y = 1 and p > 0.5E0) as tp, count(*) filter (where y <> 1 and p > 0.5E0) as fp, "
            f"count(*) filter (where y <> 1 and not p > 0.5E0) as tn, count(*) filter (where y = 1 and not p > 0.5E0) as fn "
            f"from {src}" + (f" group by {group}" if group else ""))


def _div(a: str, b: str) -> str:
    return f"coalesce(cast({a} as double) / nullif(cast({b} as double), 0), 0.0E0)"


_METRICS = {
    "accuracy": _div("tp + tn", "tp + fp + tn + fn"),
    "precision": _div("tp", "tp + fp"),
    "recall": _div("tp", "tp + fn"),
    "f1": _div("2 * tp", "2 * tp + fp + fn"),
}


def _auc_sql(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    pg = f"partition by {group}" if group else ""
    pgp = f"partition by {group + ', ' if group else ''}p"
    return f"""
    select {g}{sql_r4("(sum(ar) filter (where y = 1) - max(np) * (max(np) + 1) / 2.0E0) / (max(np) * max(nn))")} as roc_auc
    from (
      select {g}y, rank() over ({pg} order by p) + (count(*) over ({pgp}) - 1) / 2.0E0 as ar,
             cast(count(*) filter (where y = 1) over ({pg}) as double) as np,
             cast(count(*) filter (where y <> 1) over ({pg}) as double) as nn
      from {src})""" + (f" group by {group}" if group else "")


oracle._cte("eval_summary", ["eval_long"], f"""
  select c.model, c.ordinal, {', '.join(f"{sql_r4(e)} as {k}" for k, e in _METRICS.items())}, a.roc_auc
  from ({_counts_sql('eval_long', 'model, ordinal')}) c join ({_auc_sql('eval_long', 'model')}) a on a.model = c.model""")
oracle._cte("eval_selected", ["eval_summary"], f"""
  select *, {sql_r4('0.5E0 * roc_auc + 0.3E0 * recall + 0.2E0 * f1')} as selection_score,
         row_number() over (order by 0.5E0 * roc_auc + 0.3E0 * recall + 0.2E0 * f1 desc, ordinal) = 1 as is_best
  from eval_summary""")


# ------------------------------------------------------------------ queries

@query("confusion_matrix", f"""
select actual, predicted, "count" from ({_counts_sql('eval_one')}) c,
lateral (select * from (values (0, 0, c.tn), (0, 1, c.fp), (1, 0, c.fn), (1, 1, c.tp)) v(actual, predicted, "count"))""",
       ("eval_one",))
def q_confusion_matrix(spark, sf):
    return G.confusion_matrix(scorecard_eval(spark, sf))


@query("classification_metrics", "select " + ", ".join(f"{sql_r4(e)} as {k}" for k, e in _METRICS.items())
       + f" from ({_counts_sql('eval_one')})", ("eval_one",))
def q_classification_metrics(spark, sf):
    return G.classification_metrics(scorecard_eval(spark, sf))


@query("roc_auc", _auc_sql("eval_one"), ("eval_one",))
def q_roc_auc(spark, sf):
    return G.roc_auc(scorecard_eval(spark, sf))


oracle._cte("roc_sc", ["eval_one"], """
  select p as score, count(*) filter (where y = 1) as pos, count(*) filter (where y <> 1) as neg
  from eval_one group by p""")
oracle._cte("roc_run", ["roc_sc"], """
  select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as tps,
         sum(neg) over (order by score desc rows between unbounded preceding and current row) as fps,
         sum(pos) over () as np, sum(neg) over () as nn,
         row_number() over (order by score desc) as i, count(*) over () as n_pts from roc_sc""")
oracle._cte("roc_lg", ["roc_run"], """
  select *, lag(fps) over (order by score desc) as fp_prev, lead(fps) over (order by score desc) as fp_next,
         lag(tps) over (order by score desc) as tp_prev, lead(tps) over (order by score desc) as tp_next
  from roc_run""")


@query("roc_curve", f"""
select {sql_r4("score")} as threshold, {sql_r4(_div('fps', 'nn'))} as fpr, {sql_r4(_div('tps', 'np'))} as tpr from roc_lg
where i = 1 or i = n_pts or fp_next - 2 * fps + fp_prev <> 0 or tp_next - 2 * tps + tp_prev <> 0
union all select cast(null as double), 0.0E0, 0.0E0""", ("roc_lg",))
def q_roc_curve(spark, sf):
    return G.roc_curve(scorecard_eval(spark, sf))


def _report_sql() -> str:
    c1 = {k: _div(*a) for k, a in {"p": ("tp", "tp + fp"), "r": ("tp", "tp + fn"), "f": ("2 * tp", "2 * tp + fp + fn")}.items()}
    c0 = {k: _div(*a) for k, a in {"p": ("tn", "tn + fn"), "r": ("tn", "tn + fp"), "f": ("2 * tn", "2 * tn + fn + fp")}.items()}
    w0, w1 = _div("tn + fp", "tp + fp + tn + fn"), _div("tp + fn", "tp + fp + tn + fn")
    rows = [
        ("'0'", c0["p"], c0["r"], c0["f"], "tn + fp"),
        ("'1'", c1["p"], c1["r"], c1["f"], "tp + fn"),
        ("'macro avg'", f"({c0['p']} + {c1['p']}) / 2.0E0", f"({c0['r']} + {c1['r']}) / 2.0E0",
         f"({c0['f']} + {c1['f']}) / 2.0E0", "tp + fp + tn + fn"),
        ("'weighted avg'", f"{c0['p']} * {w0} + {c1['p']} * {w1}", f"{c0['r']} * {w0} + {c1['r']} * {w1}",
         f"{c0['f']} * {w0} + {c1['f']} * {w1}", "tp + fp + tn + fn"),
    ]
    sels = [f"select {n} as class, {sql_r4(p)} as precision, {sql_r4(r)} as recall, {sql_r4(f)} as f1_score, "
            f"cast({s} as bigint) as support from report_counts" for n, p, r, f, s in rows]
    return "\nunion all ".join(sels)


oracle._cte("report_counts", ["eval_one"], _counts_sql("eval_one"))


@query("classification_report", _report_sql(), ("report_counts",))
def q_classification_report(spark, sf):
    return G.classification_report(scorecard_eval(spark, sf))


@query("select_best_model", """
select model, ordinal, accuracy, precision, recall, f1, roc_auc, selection_score, is_best from eval_selected""",
       ("eval_selected",))
def q_select_best_model(spark, sf):
    long = candidates(spark, sf)
    summary = G.model_summary(long, group="model").join(long.select("model", "ordinal").distinct(), "model")
    return G.select_best(summary).select("model", "ordinal", "accuracy", "precision", "recall", "f1", "roc_auc",
                                         "selection_score", "is_best")


@query("model_comparison", """
select case when is_best then '⭐ ' || model else model end as model, accuracy, precision, recall,
       f1 as f1_score, roc_auc from eval_selected""", ("eval_selected",))
def q_model_comparison(spark, sf):
    long = candidates(spark, sf)
    summary = G.model_summary(long, group="model").join(long.select("model", "ordinal").distinct(), "model")
    return G.comparison_table(G.select_best(summary))
