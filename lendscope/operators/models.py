"""Default-risk classifiers (F1-F6), scoring with a fitted model (H2) and persistence (A3, A4).

Every candidate is a ``PipelineModel``: the fitted preprocessing as an
``SQLTransformer`` (exact train medians / moments / levels as literals), a
``VectorAssembler`` and the classifier. Training reads a persisted train side
(iterative learners scan it many times); scoring is a narrow projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope import settings as S
from lendscope.operators import features as D
from lendscope.operators import metrics as G
from lendscope.operators.boosting import BoostedTrees
from lendscope.operators.forest import RandomForest
from lendscope.session import written

MODEL_ORDER = ["Logistic Regression", "Random Forest", "Gradient Boosting"]


@dataclass
class TrainedModels:
    fitted: D.FittedFeatures
    models: dict[str, PipelineModel]
    n_train: int
    n_test: int
    default_rate: float
    weights: dict = field(default_factory=dict)
    pos_weight: float = 1.0


def _preprocess_stages(fitted: D.FittedFeatures) -> list:
    return [SQLTransformer(statement=fitted.sql_statement()),
            VectorAssembler(inputCols=fitted.vector_columns(), outputCol="features", handleInvalid="keep")]


def logistic(n_train: int) -> LogisticRegression:
    """L2, C = 1 on balanced weights, at most 1000 iterations, Spark's tolerance.

    sklearn's C * sum(w * loss) + |b|^2 / 2 divided by sum(w) = n is Spark's
    objective with regParam = 1 / n.
    """
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                              maxIter=S.LOGREG_MAX_ITER, tol=S.LOGREG_TOL, regParam=1.0 / max(1, n_train),
                              elasticNetParam=0.0, standardization=False)


def random_forest() -> RandomForest:
    """200 trees, depth 12, leaves of at least 5, balanced weights, sqrt features per split."""
    return RandomForest(featuresCol="features", labelCol="label", weightCol="weight")


def boosted_trees() -> BoostedTrees:
    """300 rounds, depth 6, rate 0.05, rows and columns of a tree 0.8, positive-class weight, lambda 1."""
    return BoostedTrees(featuresCol="features", labelCol="label", weightCol="weight")


def train_candidates(split: DataFrame, label: str, num_features, cat_features,
                     which: list[str] | None = None, fitted: D.FittedFeatures | None = None) -> TrainedModels:
    """fit preprocessing on the train side (unless given), then each candidate on the persisted
    train side."""
    train = split.where("is_train")
    fitted = fitted or D.fit_features(train, num_features, cat_features)
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}  # one row per class
    n_train = sum(counts.values())
    n_test = split.where(~F.col("is_train")).count()
    balanced = {k: n_train / (len(counts) * v) for k, v in counts.items()}
    pos_weight = counts.get(0, 0) / max(1, counts.get(1, 0))

    # The learners keep their own copy of the vectors; a cache shared by fits in several threads would be dropped by
    # the first that ends.
    base = train.withColumn("label", F.col(label).cast("double"))
    models: dict[str, PipelineModel] = {}
    for name in which or MODEL_ORDER:
        if name == "Gradient Boosting":
            data = base.withColumn("weight", F.when(F.col("label") == 1.0, F.lit(pos_weight)).otherwise(F.lit(1.0)))
            est = boosted_trees()
        else:
            data = D.with_class_weight(base, label, balanced)
            est = logistic(n_train) if name == "Logistic Regression" else random_forest()
        models[name] = Pipeline(stages=_preprocess_stages(fitted) + [est]).fit(data)
    return TrainedModels(fitted, models, n_train, n_test, counts.get(1, 0) / max(1, n_train), balanced, pos_weight)


def positive_probability(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of ``keep`` + ``prob`` (unrounded probability of class 1)."""
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias("prob"))


def batch_score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """H2: default_prob (4 dp), risk_level on the unrounded probability, risk_score (1 dp)."""
    from lendscope.operators.scoring import with_risk

    return with_risk(positive_probability(model, df, keep), "prob").drop("prob")


def test_scores(trained: TrainedModels, split: DataFrame, label: str) -> DataFrame:
    """(model, y, p): every candidate's unrounded test-side scores, computed once (written table)."""
    test = split.where(~F.col("is_train"))
    parts = None
    for name in MODEL_ORDER:
        if name in trained.models:
            p = positive_probability(trained.models[name], test, [label]).select(
                F.lit(name).alias("model"), F.col(label).alias("y"), F.col("prob").alias("p"))
            parts = p if parts is None else parts.unionByName(p)
    return written(parts, "test-scores")


def evaluate_scores(scores: DataFrame) -> DataFrame:
    """Metrics of every candidate, selection score and best flag."""
    place = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(MODEL_ORDER) for x in (n, i)]), F.col("model"))
    return G.select_best(G.model_summary(scores, group="model").withColumn("ordinal", place))


def evaluate(trained: TrainedModels, split: DataFrame, label: str) -> DataFrame:
    """Test-side metrics of every candidate, selection score and best flag."""
    return evaluate_scores(test_scores(trained, split, label))


def feature_importance(spark, trained: TrainedModels, name: str) -> DataFrame:
    """gain importances (trees) or absolute coefficients (linear), one row per feature name.

    The vector has one entry per feature (model metadata on the driver), so it is tiny.
    """
    model = trained.models[name].stages[-1]
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray().tolist()
    else:
        values = [abs(v) for v in model.coefficients.toArray().tolist()]
    rows = [(n, i, float(v)) for i, (n, v) in enumerate(zip(trained.fitted.feature_names, values))]
    ranked = sorted(rows, key=lambda r: (-r[2], r[1]))  # highest first
    return spark.createDataFrame([(*r, k) for k, r in enumerate(ranked, 1)], "feature string, position int, importance double, rank int")


def save_pipeline(model: PipelineModel, path: str) -> None:
    """A3: the ML writer (directory of metadata + parquet), overwriting."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
