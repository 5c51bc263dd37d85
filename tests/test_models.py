"""Fitted models: quality bounds, reload equality, scoring shape, K-Means structure."""

import pytest
from pyspark.sql import functions as F

from lendscope.operators import models as M
from lendscope.operators import segments as J
from lendscope.plans import model_queries as MQ
from lendscope.plans.feature_queries import fitted_on_train, split_applicants
from lendscope.plans.profile_queries import CAT_FEATURES, NUM_FEATURES
from lendscope.session import scratch_path
from lendscope.sources import tables as T

from conftest import SF001, SF01


@pytest.fixture(scope="module")
def logistic(spark):
    split = split_applicants(spark, SF01)
    return split, M.train_candidates(split, "loan_status", NUM_FEATURES, CAT_FEATURES, ["Logistic Regression"])


def test_logistic_auc_bound(spark, logistic):
    split, tm = logistic
    row = M.evaluate(tm, split, "loan_status").first()
    assert row["roc_auc"] >= 0.85
    assert tm.n_train + tm.n_test == 15000


def test_statistics_from_train_only(spark, logistic):
    split, tm = logistic
    train = split.where("is_train")
    mean_all = split.agg(F.avg("person_income")).first()[0]
    mean_train = train.agg(F.avg("person_income")).first()[0]
    assert tm.fitted.means["person_income"] == pytest.approx(mean_train, rel=1e-12)
    assert tm.fitted.means["person_income"] != mean_all


def test_pipeline_roundtrip(spark, logistic):
    split, tm = logistic
    model = tm.models["Logistic Regression"]
    path = scratch_path(spark, "test_models/logistic")
    M.save_pipeline(model, path)
    loaded = M.load_pipeline(path)
    test = split.where(~F.col("is_train"))
    a = M.positive_probability(model, test, ["loan_id"]).withColumnRenamed("prob", "a")
    b = M.positive_probability(loaded, test, ["loan_id"]).withColumnRenamed("prob", "b")
    assert a.join(b, "loan_id").where("a != b").count() == 0


def test_batch_score_unseen_category(spark, logistic):
    _, tm = logistic
    df = spark.createDataFrame(
        [(1, 30, 40000, None, "NEW_INTENT", "Z", 5000, 12.0, 0.125, "N", 5)],
        "loan_id long, person_age long, person_income long, person_emp_length double, loan_intent string, "
        "loan_grade string, loan_amnt long, loan_int_rate double, loan_percent_income double, "
        "cb_person_default_on_file string, cb_person_cred_hist_length long")
    row = M.batch_score(tm.models["Logistic Regression"], df, ["loan_id"]).first()
    assert 0.0 <= row["default_prob"] <= 1.0 and row["risk_level"] in ("LOW", "MEDIUM", "HIGH")


def test_trees_and_importances(spark):
    split = fitted_on_train(spark, SF001)[0]
    tm = MQ.trained(spark, SF001, "Random Forest")
    tm = M.TrainedModels(tm.fitted, {**tm.models, **MQ.trained(spark, SF001, "Gradient Boosting").models}, tm.n_train, tm.n_test, tm.default_rate)
    ev = {r["model"]: r for r in M.evaluate(tm, split, "loan_status").collect()}
    assert set(ev) == {"Random Forest", "Gradient Boosting"}
    assert sum(r["is_best"] for r in ev.values()) == 1
    imp = M.feature_importance(spark, tm, "Random Forest").collect()
    assert len(imp) == len(tm.fitted.feature_names)
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)


def test_kmeans_structure(spark):
    df = T.applicants(spark, SF001)
    feats = J.select_segmentation_features(df, "loan_status", ["loan_id"])
    assert feats[:4] == ["person_income", "loan_amnt", "loan_int_rate", "loan_percent_income"]
    space = J.fit_space(df, feats)
    vecs = J.vectors(df, space, ["loan_id"]).cache()
    m2, c2 = J.best_of_starts(vecs, 2, 2)
    m4, c4 = J.best_of_starts(vecs, 4, 2)
    assert c4 < c2
    assigned = m4.transform(vecs)
    sizes = assigned.groupBy("segment").count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == df.count()
    # own exact silhouette equals Spark's evaluator on the same clustering
    own = J.silhouette(df.join(assigned.select("loan_id", "segment"), "loan_id"), space).first()["silhouette"]
    assert own == pytest.approx(J.vector_silhouette(assigned), abs=1e-9)


def test_single_applicant_equals_batch_row(spark, logistic):
    split, tm = logistic
    model = tm.models["Logistic Regression"]
    test = split.where(~F.col("is_train"))
    one_id = test.select("loan_id").orderBy("loan_id").first()["loan_id"]
    single = M.batch_score(model, test.where(F.col("loan_id") == one_id), ["loan_id"]).first()
    batch = M.batch_score(model, test, ["loan_id"]).where(F.col("loan_id") == one_id).first()
    assert single.asDict() == batch.asDict()
