"""Evaluation on (label, score) tables (G1-G7), grouped by an optional model column.

Scores are taken unrounded; only results are rounded. Counts come from one
conditional aggregate. ROC and AUC collapse rows to distinct scores per model and
sum them in ranges of (model, score), so no model is held by one task. AUC is
exact integer arithmetic: sum over scores of ``neg_s * (2 * pos_above + pos_s)``
divided by ``2 * P * N`` (ties count half).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope import settings as S
from lendscope.functions.columns import r4, safe_div
from lendscope.functions.running import running_totals
from lendscope.session import written


def _keys(group: str | None) -> list[str]:
    return [group] if group else []


def confusion_counts(df: DataFrame, label: str = "y", score: str = "p", group: str | None = None,
                     threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn (bigint) per group; predicted positive is ``score > threshold``."""
    pred = F.col(score) > F.lit(threshold)
    y = F.col(label) == 1
    return df.groupBy(*_keys(group)).agg(
        F.count_if(y & pred).alias("tp"), F.count_if(~y & pred).alias("fp"),
        F.count_if(~y & ~pred).alias("tn"), F.count_if(y & ~pred).alias("fn"))


def confusion_matrix(df: DataFrame, label: str = "y", score: str = "p", group: str | None = None) -> DataFrame:
    """G1: all four cells, rows = actual class."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("count"))
        for a, p, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return confusion_counts(df, label, score, group).select(*_keys(group), F.inline(cells))


def _ratios(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {
        "accuracy": safe_div(tp + tn, tp + fp + tn + fn),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(F.lit(2) * tp, F.lit(2) * tp + fp + fn),
    }


def classification_metrics(df: DataFrame, label: str = "y", score: str = "p", group: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0), 4 dp."""
    cc = confusion_counts(df, label, score, group)
    rat = _ratios(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return cc.select(*_keys(group), *[r4(v).alias(k) for k, v in rat.items()])


def score_counts(df: DataFrame, label: str = "y", score: str = "p", group: str | None = None) -> DataFrame:
    """Distinct scores per group with positive / negative counts."""
    return df.groupBy(*_keys(group), F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def _running(sc: DataFrame, group: str | None) -> DataFrame:
    """Each distinct score, from the highest: rows up to it within its group (tps, fps), the group's P and N, and its
    place ``i`` among the ``n_pts`` points of the group.

    Scores are unrounded, so there may be as many as rows: the sums run over ranges of (group, score).
    """
    counted = sc.select(F.col(group).alias("g") if group else F.lit("").alias("g"), "score", (-F.col("score")).alias("down"),
                        "pos", "neg", F.lit(1).cast("long").alias("one"))
    run = written(running_totals(counted, ["g", "down"], {"tp_all": "pos", "fp_all": "neg", "i_all": "one"}, "roc"), "roc-run")
    earlier = Window.orderBy(F.col("g").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # one row per model
    whole = run.groupBy("g").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("n_pts"))
    whole = whole.select(F.col("g").alias("gw"), "P", "N", "n_pts", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("P", "N", "n_pts")])
    return run.join(whole, F.col("g").eqNullSafe(F.col("gw"))).select(
        *([F.col("g").alias(group)] if group else []), "score", "pos", "neg", "P", "N", "n_pts", F.col("i_all").alias("place"),
        (F.col("tp_all") - F.col("P_before")).alias("tps"), (F.col("fp_all") - F.col("N_before")).alias("fps"),
        (F.col("i_all") - F.col("n_pts_before")).alias("i"))


def roc_auc(df: DataFrame, label: str = "y", score: str = "p", group: str | None = None) -> DataFrame:
    """ROC AUC per group (4 dp) of the unrounded scores; NULL when a class is absent."""
    run = _running(score_counts(df, label, score, group), group)
    # products of counts pass 64 bits with some 2e9 rows a class
    long_ = lambda c: c.cast("decimal(18,0)")
    num = F.sum((long_(F.col("neg")) * long_(F.lit(2) * (F.col("tps") - F.col("pos")) + F.col("pos"))).cast("decimal(38,0)"))
    den = F.lit(2.0) * F.first("P") * F.first("N")
    return run.groupBy(*_keys(group)).agg(r4(F.try_divide(num.cast("double"), den)).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str = "y", score: str = "p", group: str | None = None) -> DataFrame:
    """ROC points (fpr, tpr, threshold; 4 dp) by descending distinct score with a leading (0, 0)
    point; interior points collinear with both neighbours are dropped."""
    run = _running(score_counts(df, label, score, group), group)
    beside = lambda step, name: run.select(
        (F.col("place") + step).alias("place"), F.col("fps").alias(f"fp_{name}"), F.col("tps").alias(f"tp_{name}"))
    idx = run.join(beside(1, "prev"), "place", "left").join(beside(-1, "next"), "place", "left")
    keep = (
        (F.col("i") == 1) | (F.col("i") == F.col("n_pts"))
        | (F.col("fp_next") - F.lit(2) * F.col("fps") + F.col("fp_prev") != 0)
        | (F.col("tp_next") - F.lit(2) * F.col("tps") + F.col("tp_prev") != 0)
    )
    pts = idx.where(keep).select(
        *_keys(group), r4("score").alias("threshold"),
        r4(safe_div(F.col("fps"), F.col("N"))).alias("fpr"), r4(safe_div(F.col("tps"), F.col("P"))).alias("tpr"))
    origin = run.groupBy(*_keys(group)).agg(F.lit(None).cast("double").alias("threshold")).select(
        *_keys(group), "threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def classification_report(df: DataFrame, label: str = "y", score: str = "p", group: str | None = None) -> DataFrame:
    """Per class, macro and weighted averages of precision, recall, F1, with support."""
    cc = confusion_counts(df, label, score, group)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    # Class 1 as positive uses (tp, fp, fn); class 0 as positive uses (tn, fn, fp).
    c1 = _ratios(tp, fp, tn, fn)
    c0 = _ratios(tn, fn, tp, fp)
    s1, s0 = tp + fn, tn + fp
    tot = s1 + s0

    def row(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), r4(p).alias("precision"), r4(r).alias("recall"),
                        r4(f).alias("f1_score"), support.cast("bigint").alias("support"))

    w0, w1 = safe_div(s0, tot), safe_div(s1, tot)
    rows = F.array(
        row("0", c0["precision"], c0["recall"], c0["f1"], s0),
        row("1", c1["precision"], c1["recall"], c1["f1"], s1),
        row("macro avg", (c0["precision"] + c1["precision"]) / F.lit(2.0), (c0["recall"] + c1["recall"]) / F.lit(2.0),
            (c0["f1"] + c1["f1"]) / F.lit(2.0), tot),
        row("weighted avg", c0["precision"] * w0 + c1["precision"] * w1, c0["recall"] * w0 + c1["recall"] * w1,
            c0["f1"] * w0 + c1["f1"] * w1, tot),
    )
    return cc.select(*_keys(group), F.inline(rows))


def model_summary(df: DataFrame, label: str = "y", score: str = "p", group: str = "model") -> DataFrame:
    """G2 + G4 per model, 4 dp (the metric dictionary of each trained model)."""
    return classification_metrics(df, label, score, group).join(roc_auc(df, label, score, group), group)


def selection_score(auc: Column, recall: Column, f1: Column) -> Column:
    w = S.SELECTION_WEIGHTS
    return F.lit(w["roc_auc"]) * auc + F.lit(w["recall"]) * recall + F.lit(w["f1"]) * f1


def select_best(summary: DataFrame, group: str = "model", order: str = "ordinal") -> DataFrame:
    """Selection score per model and the first model (by ``order``) with the highest score.

    ``summary`` holds one row per candidate (a handful), so the unpartitioned window is bounded.
    """
    whole = Window.partitionBy()
    scored = summary.withColumn("selection_score", selection_score(F.col("roc_auc"), F.col("recall"), F.col("f1")))
    best = F.max_by(F.col(group), F.struct(F.col("selection_score"), -F.col(order))).over(whole)
    return scored.withColumns({"is_best": F.col(group) == best, "selection_score": r4("selection_score")})


def comparison_table(selected: DataFrame, group: str = "model") -> DataFrame:
    """One row per model, the chosen one starred."""
    name = F.when(F.col("is_best"), F.concat(F.lit("⭐ "), F.col(group))).otherwise(F.col(group))
    return selected.select(name.alias("model"), "accuracy", "precision", "recall", F.col("f1").alias("f1_score"),
                           "roc_auc")


def long_scores(df: DataFrame, label: str, models: Sequence[tuple[str, Column]]) -> DataFrame:
    """(model, ordinal, y, p) rows for several score columns of one table (no join)."""
    arr = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("ordinal"), c.cast("double").alias("p"))
                    for i, (n, c) in enumerate(models)])
    return df.select(F.col(label).alias("y"), F.inline(arr))
