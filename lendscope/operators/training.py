"""Preparation and training of any applicant table, end to end.

``prepare`` cleans, finds the target, the ids and the column roles, splits and fits the features; ``train`` fits and
compares the candidates, saves the chosen pipeline and writes its tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope import artefacts
from lendscope.functions.columns import fresh, r4
from lendscope.operators import clean as C
from lendscope.operators import features as D
from lendscope.operators import metrics as G
from lendscope.operators import models as M
from lendscope.operators import profile as B
from lendscope.session import materialize, written

TABLES = ("model_metrics", "roc_points", "feature_importance", "run_info")


@dataclass
class Prepared:
    split: DataFrame
    target: str
    key: str
    num_features: list[str]
    cat_features: list[str]
    fitted: D.FittedFeatures


def prepare(df: DataFrame, target: str | None = None) -> Prepared:
    """Clean (C1, C2), detect target and ids (B5, B6), assign roles (B7, B8), split (D6) and fit on the train side.

    Rows are told apart in the split by the first id column of whole numbers that is unique, or by a hash of the row
    without one. The cleaned rows are written once; detection, split and fits read that.
    """
    rows = materialize(C.drop_duplicates(df))
    rows = rows.drop(*C.sparse_columns(rows))
    target, _ = B.detect_target_column(rows, target)
    if target is None:
        raise ValueError("no target column was found")
    ids = [c for c in B.detect_id_columns(rows) if c != target]
    kinds = dict(rows.dtypes)
    key = next((c for c in ids if kinds[c] in ("int", "bigint") and B.unique_columns(rows, [c])), None)
    if key is None:
        key = fresh(rows.columns, "_row")
        rows = rows.withColumn(key, F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), 1))
    skip = {*ids, target, key}
    split = materialize(D.stratified_split(rows, target, key))
    nums, cats = B.numeric_columns(rows, skip), B.categorical_columns(rows, skip)
    if not nums and not cats:
        raise ValueError("No usable features found after removing target and IDs.")
    return Prepared(split, target, key, nums, cats, D.fit_features(split.where("is_train"), nums, cats))


def train(prepared: Prepared, path: str, candidates: M.TrainedModels | None = None) -> str:
    """Fit the candidates (unless given) and publish the chosen pipeline (``model``) and the four tables as a version of ``path``.

    ``artefacts.current`` gives its folder; all five appear together. Returns the chosen name. model_metrics has the
    metrics, selection score and choice of every candidate; roc_points their curves; feature_importance the chosen model's
    features; run_info the sizes, rate, feature counts and name.
    """
    p, spark = prepared, prepared.split.sparkSession
    tm = candidates or M.train_candidates(p.split, p.target, p.num_features, p.cat_features, fitted=p.fitted)
    scores = M.test_scores(tm, p.split, p.target)
    metrics = written(M.evaluate_scores(scores), "train-metrics")
    best = metrics.where("is_best").first()["model"]
    info = p.split.agg(
        F.count_if(F.col("is_train")).alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"),
        r4(F.avg(F.when(F.col("is_train"), F.col(p.target).cast("double")))).alias("default_rate")).select(
        "*", F.lit(len(p.num_features)).alias("n_numeric"), F.lit(len(p.cat_features)).alias("n_categorical"),
        F.lit(len(p.fitted.feature_names)).alias("n_features"), F.lit(p.target).alias("target"), F.lit(best).alias("best_model"),
        F.array(*[F.lit(n) for n in p.fitted.feature_names]).alias("feature_names"))
    tables = (metrics, G.roc_curve(scores, group="model"), M.feature_importance(spark, tm, best), info)

    def write(folder: str) -> None:
        M.save_pipeline(tm.models[best], f"{folder}/model")
        for name, table in zip(TABLES, tables, strict=True):
            table.write.parquet(f"{folder}/{name}")

    artefacts.publish(spark, path, write)
    return best
