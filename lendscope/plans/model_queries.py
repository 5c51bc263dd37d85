"""Queries on fitted models (F1-F6, H2, H3, A3, A4): facts that every right fit shows, checked by SQL.

SQL cannot fit the models, but it knows the split, the feature layout and the rows that must come out; the flags beside
them are computed from the fits. Beside them stand keys without SQL that return the fits' own numbers (``model_metrics``,
``model_importances``, ``train_boosted``, ``model_contributions``, ``model_risk_factors``), which tests recompute.

Fits are memoised per input folder inside one Python process, so the keys that
share a fit (metrics, importances, scoring, persistence) train it once, the way
a saved model is reused.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lendscope import artefacts
from lendscope import settings as S
from lendscope.functions.columns import classify_risk, r2, r4
from lendscope.operators import attribution as A
from lendscope.operators import explain as I
from lendscope.operators import features as D
from lendscope.operators import models as M
from lendscope.operators import training as TR
from lendscope.operators.boosting import BoostedTrees
from lendscope.operators.clean import align_columns
from lendscope.plans import oracle
from lendscope.plans.feature_queries import KEY, LABEL, fitted_on_train, prepared
from lendscope.plans.oracle import r2 as sql_r2
from lendscope.plans.profile_queries import CAT_FEATURES, NUM_FEATURES
from lendscope.plans.fitted import memo
from lendscope.plans.registry import query
from lendscope.session import scratch_path, slug, written
from lendscope.sources import tables as T

def trained(spark: SparkSession, sf: str, name: str) -> M.TrainedModels:
    """One candidate, trained on the checkpointed split with the shared train-side preprocessing."""
    def fit():
        split, fitted = fitted_on_train(spark, sf)
        return M.train_candidates(split, LABEL, NUM_FEATURES, CAT_FEATURES, [name], fitted)

    return memo(spark, sf, f"model:{name}", fit)


def all_trained(spark: SparkSession, sf: str) -> M.TrainedModels:
    """Every candidate; the independent fits run from driver threads and share the executors."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=len(M.MODEL_ORDER)) as pool:
        parts = list(pool.map(lambda n: trained(spark, sf, n), M.MODEL_ORDER))
    merged = M.TrainedModels(parts[0].fitted, {}, parts[0].n_train, parts[0].n_test, parts[0].default_rate)
    for p in parts:
        merged.models.update(p.models)
    return merged


#: Every candidate must reach this AUC on the test side.
AUC_BOUND = 0.75
#: Largest share of a feature's absolute residual that the penalty may leave unbalanced at the optimum.
GRADIENT_BOUND = 1e-3

oracle._cte("split_sizes", ["split"], """
  select count(*) filter (where is_train) as n_train, count(*) filter (where not is_train) as n_test from split""")


def metrics_of(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """Metrics, selection score and best flag of the named candidates on the test side (the full result)."""
    tm = all_trained(spark, sf) if names == M.MODEL_ORDER else trained(spark, sf, names[0])
    return memo(spark, sf, f"metrics:{names}", lambda: written(M.evaluate(tm, fitted_on_train(spark, sf)[0], LABEL), "model-metrics"))


def _facts(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    """What every fit must show, as SQL can state it: sizes of both sides, AUC bound, metrics in range, one best."""
    sizes = trained(spark, sf, names[0])
    share = lambda c: F.col(c).between(0.0, 1.0)
    return metrics_of(spark, sf, names).select(
        "model", F.lit(sizes.n_train).cast("bigint").alias("n_train"), F.lit(sizes.n_test).cast("bigint").alias("n_test"),
        (F.col("roc_auc") >= AUC_BOUND).alias("auc_bound_met"),
        (share("accuracy") & share("precision") & share("recall") & share("f1")).alias("metrics_in_range"),
        F.sum(F.col("is_best").cast("int")).over(Window.partitionBy()).alias("n_best"))  # one row a model


def _facts_sql(*names: str) -> str:
    return " union all ".join(f"select '{n}' as model, n_train, n_test, true as auc_bound_met, true as metrics_in_range, "
                              "cast(1 as bigint) as n_best from split_sizes" for n in names)


def logistic_gradient(spark: SparkSession, sf: str) -> list[float]:
    """Per feature: weighted residual plus penalty, as a share of the weighted absolute residual (0 at the optimum)."""
    tm = trained(spark, sf, "Logistic Regression")
    split, fitted = fitted_on_train(spark, sf)
    model = tm.models["Logistic Regression"]
    coefficients = model.stages[-1].coefficients.toArray()
    train = D.with_class_weight(split.where("is_train").withColumn("label", F.col(LABEL).cast("double")), "label",
                                {float(k): v for k, v in tm.weights.items()})
    rows = model.transform(train).select(F.col("weight").alias("w"), (vector_to_array("probability")[1] - F.col("label")).alias("r"),
                                         vector_to_array("features").alias("x"))
    row = rows.agg(F.sum("w").alias("n"), *[f(F.col("w") * F.col("r") * F.col("x")[j]).alias(f"{n}{j}") for j in range(len(coefficients))
                                           for n, f in (("g", F.sum), ("a", lambda c: F.sum(F.abs(c))))]).first()
    penalty = row["n"] / max(1, tm.n_train)
    return [abs(row[f"g{j}"] + penalty * b) / max(row[f"a{j}"], 1e-12) for j, b in enumerate(coefficients)]


@query("train_logistic", f"select *, true as optimal from ({_facts_sql('Logistic Regression')})", ("split_sizes",))
def q_train_logistic(spark, sf):
    worst = max(logistic_gradient(spark, sf))
    return _facts(spark, sf, ["Logistic Regression"]).withColumn("optimal", F.lit(worst) < F.lit(GRADIENT_BOUND))


@query("train_random_forest", _facts_sql("Random Forest"), ("split_sizes",))
def q_train_random_forest(spark, sf):
    return _facts(spark, sf, ["Random Forest"])


@query("train_gbt", _facts_sql("Gradient Boosting"), ("split_sizes",))
def q_train_gbt(spark, sf):
    return _facts(spark, sf, ["Gradient Boosting"])


@query("compare_models", _facts_sql(*M.MODEL_ORDER), ("split_sizes",))
def q_compare_models(spark, sf):
    return _facts(spark, sf, M.MODEL_ORDER)


@query("model_metrics")
def q_model_metrics(spark, sf):
    """Metrics, selection score and choice of every candidate (the full result of ``compare_models``)."""
    return metrics_of(spark, sf, M.MODEL_ORDER)


@query("train_boosted")
def q_train_boosted(spark, sf):
    """mean training loss before each round and after the last."""
    tm = trained(spark, sf, "Gradient Boosting")
    model = tm.models["Gradient Boosting"].stages[-1]
    weight = tm.pos_weight
    total = tm.n_train * (1 - tm.default_rate) + weight * tm.n_train * tm.default_rate
    return spark.createDataFrame([(i, x / total) for i, x in enumerate(model.training_loss)], "round int, loss double")


@query("boosting_first_split", f"""
select feature, {sql_r2('gl * gl / (hl + 1.0E0) + (g - gl) * (g - gl) / (h - hl + 1.0E0) - g * g / (h + 1.0E0)')} as gain
from (select m.feature, sum(w.g) as g, sum(w.h) as h, sum(case when m.value <= 0.5E0 then w.g else 0.0E0 end) as gl,
             sum(case when m.value <= 0.5E0 then w.h else 0.0E0 end) as hl
      from matrix_long m join (
        select loan_id, case when loan_status = 1 then p * -0.5E0 else 0.5E0 end as g, case when loan_status = 1 then p * 0.25E0 else 0.25E0 end as h
        from split, (select cast(count(*) filter (where loan_status = 0) as double)
                            / cast(greatest(1, count(*) filter (where loan_status = 1)) as double) as p from split where is_train)
        where is_train) w on w.loan_id = m.loan_id
      where m.pos0 >= {len(NUM_FEATURES)} group by m.feature)""", ("matrix_long", "split"))
def q_boosting_first_split(spark, sf):
    """gains of the cuts that part the two values of each one-hot feature, at the root of the first tree."""
    split, fitted = fitted_on_train(spark, sf)
    train = split.where("is_train")
    weight = train.agg(D.scale_pos_weight(train, LABEL)).first()[0]
    rows = PipelineModel(stages=M._preprocess_stages(fitted)).transform(train.select(
        "*", F.col(LABEL).cast("double").alias("label"), F.when(F.col(LABEL) == 1, weight).otherwise(1.0).alias("weight")))
    run = BoostedTrees(weightCol="weight", rows=1.0).booster(rows)
    gains = run.root_gains()
    run.close()
    first = len(NUM_FEATURES)
    return spark.createDataFrame([(n, float(gains[first + j][0])) for j, n in enumerate(fitted.feature_names[first:])],
                                 "feature string, gain double").select("feature", r2("gain").alias("gain"))


def best_name(spark, sf) -> str:
    return metrics_of(spark, sf, M.MODEL_ORDER).where("is_best").select("model").first()["model"]


def chosen(spark, sf) -> PipelineModel:
    return all_trained(spark, sf).models[best_name(spark, sf)]


def explained_model(spark: SparkSession, sf: str):
    """The chosen pipeline and its explainer (once per session and input)."""
    def fit():
        split, fitted = fitted_on_train(spark, sf)
        model = chosen(spark, sf)
        return model, A.explainer(model, fitted.feature_names, I.feature_means(split.where("is_train"), fitted))

    return memo(spark, sf, "explained_model", fit)


@query("model_importances")
def q_model_importances(spark, sf):
    """importances of the chosen model's features, ranked (the full result of ``feature_importance``)."""
    return M.feature_importance(spark, all_trained(spark, sf), best_name(spark, sf))


@query("explained_predictions", "select loan_id, true as sums_to_prediction from applicants", ("applicants",))
def q_explained_predictions(spark, sf):
    """For every applicant, whether the chosen model's contributions and their base sum to its prediction."""
    model, explain = explained_model(spark, sf)
    rows = A.with_contributions(T.applicants(spark, sf), model, explain)
    p = vector_to_array("probability")[1]
    told = F.aggregate("contributions", F.lit(float(explain.base)), lambda s, c: s + c)
    as_probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-told)) if explain.scale == "log-odds" else told
    return rows.select(KEY, (F.abs(as_probability - p) < 1e-9).alias("sums_to_prediction"))


@query("model_contributions")
def q_model_contributions(spark, sf):
    """Every feature's contribution to the chosen model's prediction, for every applicant."""
    model, explain = explained_model(spark, sf)
    return A.contribution_rows(A.with_contributions(T.applicants(spark, sf), model, explain), explain, [KEY])


@query("model_risk_factors")
def q_model_risk_factors(spark, sf):
    """The strongest risk and positive factors of every applicant under the chosen model."""
    model, explain = explained_model(spark, sf)
    return A.top_rows(A.with_contributions(T.applicants(spark, sf), model, explain), explain, [KEY])


oracle._cte("feature_layout", ["levels"], " union all ".join(
    [f"select '{c}' as feature, {i} as position" for i, c in enumerate(NUM_FEATURES)]
    + ["select feature || '_' || level, " + str(len(NUM_FEATURES) - 1) + " + cast(row_number() over (order by case feature "
       + " ".join(f"when '{c}' then {j}" for j, c in enumerate(CAT_FEATURES)) + " end, level) as integer) from levels"]))


@query("feature_importance", """
select feature, position, true as valid, (select count(*) from feature_layout) as n_ranks from feature_layout""", ("feature_layout",))
def q_feature_importance(spark, sf):
    """Names and places in the vector; valid: finite, not negative, in order of rank, and a tree's sum to 1."""
    name = best_name(spark, sf)
    found = M.feature_importance(spark, all_trained(spark, sf), name)
    whole, by_rank = Window.partitionBy(), Window.orderBy("rank")  # one row a feature
    total = F.sum("importance").over(whole)
    sums = F.abs(total - 1.0) < 1e-6 if name != "Logistic Regression" else total > 0
    falls = F.coalesce(F.lag("importance").over(by_rank) >= F.col("importance"), F.lit(True))
    return found.select("feature", "position", (sums & falls & (F.col("importance") >= 0)).alias("valid"),
                        F.max("rank").over(whole).cast("bigint").alias("n_ranks"))


@query("batch_score_model", "select loan_id, true as in_range, true as level_agrees, true as score_agrees from applicants", ("applicants",))
def q_batch_score_model(spark, sf):
    """Every applicant under the chosen model: probability in range, risk level and score as its probability says."""
    p = F.col("default_prob")
    scored = M.batch_score(chosen(spark, sf), T.applicants(spark, sf), [KEY])
    edge = (F.abs(p - S.LOW_THRESHOLD) < 1e-4) | (F.abs(p - S.HIGH_THRESHOLD) < 1e-4)  # the level is of the unrounded one
    return scored.select(KEY, p.between(0.0, 1.0).alias("in_range"), (edge | (F.col("risk_level") == classify_risk(p))).alias("level_agrees"),
                         (F.abs(F.col("risk_score") - p * 100.0) < 0.06).alias("score_agrees"))


@query("score_one_applicant", "select loan_id, true as same_as_batch from applicants where loan_id in (select min(loan_id) from applicants)",
       ("applicants",))
def q_score_one_applicant(spark, sf):
    """H3: one applicant as a one-row table on the batch path, a trained column absent on the way in (C5 adds it)."""
    rows = T.applicants(spark, sf)
    one = rows.where(F.col(KEY) == rows.agg(F.min(KEY)).first()[0])
    types = {f.name: f.dataType for f in rows.schema}
    trained_columns = [KEY, *NUM_FEATURES, *CAT_FEATURES]
    cut = align_columns(one.drop(NUM_FEATURES[0]), trained_columns, types)
    whole = one.withColumn(NUM_FEATURES[0], F.lit(None).cast(types[NUM_FEATURES[0]]))
    a = M.batch_score(chosen(spark, sf), cut, [KEY]).withColumnsRenamed({"default_prob": "a", "risk_level": "la"}).select(KEY, "a", "la")
    b = M.batch_score(chosen(spark, sf), whole, [KEY]).withColumnsRenamed({"default_prob": "b", "risk_level": "lb"}).select(KEY, "b", "lb")
    return a.join(b, KEY).select(KEY, ((F.col("a") == F.col("b")) & (F.col("la") == F.col("lb"))).alias("same_as_batch"))


@query("pipeline_roundtrip", "select loan_id, true as equal from split", ("split",))
def q_pipeline_roundtrip(spark, sf):
    """Save the chosen pipeline to the shared folder, load it, score both sides both ways."""
    model = chosen(spark, sf)
    path = scratch_path(spark, f"models/{slug(sf)}/chosen")
    M.save_pipeline(model, path)
    loaded = M.load_pipeline(path)
    rows = fitted_on_train(spark, sf)[0]
    before = M.positive_probability(model, rows, [KEY]).withColumnRenamed("prob", "p_before")
    after = M.positive_probability(loaded, rows, [KEY]).withColumnRenamed("prob", "p_after")
    return before.join(after, KEY).select(KEY, (F.col("p_before") == F.col("p_after")).alias("equal"))


@query("run_info", """
select count(*) filter (where is_train) as n_train, count(*) filter (where not is_train) as n_test,
  (round_even(avg(cast(loan_status as double)) filter (where is_train) * 10000.0E0, 0) / 10000.0E0 + 0.0E0)
    as default_rate, (select count(*) from levels) + 7 as n_features
from split""", ("split", "levels"))
def q_run_info(spark, sf):
    """A4: run metadata written as a parquet table in the shared folder and read back."""
    split, fitted = fitted_on_train(spark, sf)
    info = split.agg(
        F.count_if(F.col("is_train")).alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"),
        r4(F.avg(F.when(F.col("is_train"), F.col(LABEL).cast("double")))).alias("default_rate"),
    ).withColumn("n_features", F.lit(len(fitted.feature_names)).cast("bigint"))
    path = scratch_path(spark, f"run_info/{slug(sf)}")
    info.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)



@query("train_tables", """
select 'model_metrics' as name, cast(3 as bigint) as n_rows, true as sound union all
select 'roc_points', cast(3 as bigint), true union all
select 'feature_importance', (select count(*) from feature_layout), true union all
select 'run_info', (select n_train + n_test from split_sizes), true""", ("feature_layout", "split_sizes"))
def q_train_tables(spark, sf):
    """The four tables that training writes, read back: their rows (curves; features; rows split) and soundness."""
    path = scratch_path(spark, f"train/{slug(sf)}")
    best = TR.train(prepared(spark, sf), path, all_trained(spark, sf))
    folder = artefacts.current(spark, path)
    metrics, points, importance, info = (spark.read.parquet(f"{folder}/{name}") for name in TR.TABLES)
    fact = lambda name, df, n, sound: df.agg(F.lit(name).alias("name"), n.cast("bigint").alias("n_rows"), sound.alias("sound"))
    whole = F.count_if((F.col("fpr") == 0) & (F.col("tpr") == 0) & F.col("threshold").isNull()) == F.count_if((F.col("fpr") == 1) & (F.col("tpr") == 1))
    sizes = F.max(F.col("n_train") + F.col("n_test"))
    parts = [fact("model_metrics", metrics, F.count(F.lit(1)), F.count_if(F.col("is_best")) == 1),
             fact("roc_points", points, F.count_distinct("model"), whole),
             fact("feature_importance", importance, F.count(F.lit(1)), F.count_if(F.col("importance").isNull()) == 0),
             fact("run_info", info, sizes, (F.max("best_model") == best) & (F.max(F.size("feature_names")) == F.max("n_features")))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
