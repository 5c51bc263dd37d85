"""Keys that return a fit's own numbers: recomputed here from the models or from plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as E
from lendscope.operators import models as M
from lendscope.operators import segments as J
from lendscope.plans import model_queries as MQ
from lendscope.plans import segment_model_queries as SQ
from lendscope.plans.feature_queries import fitted_on_train
from lendscope.sources import tables as T

from conftest import SF001

#: Keys without SQL; each has a test below.
RECOMPUTED = {"model_metrics", "model_importances", "train_boosted", "model_contributions", "model_risk_factors",
              "kmeans_sweep", "kmeans_profiles", "assess_fitted"}
Q = E.queries()


def test_metrics_and_loss(spark):
    rows = {r["model"]: r for r in Q["model_metrics"](spark, SF001).collect()}
    assert set(rows) == set(M.MODEL_ORDER) and sum(r["is_best"] for r in rows.values()) == 1
    split, _ = fitted_on_train(spark, SF001)
    tm = MQ.all_trained(spark, SF001)
    for name, model in tm.models.items():
        scored = M.positive_probability(model, split.where("not is_train"), ["loan_status"]).collect()
        y, p = np.array([r.loan_status for r in scored]), np.array([r.prob for r in scored])
        assert rows[name]["accuracy"] == pytest.approx(((p >= 0.5) == y).mean(), abs=1e-4)
        wins = (p[y == 1][:, None] > p[y == 0][None, :]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :]).mean()
        assert rows[name]["roc_auc"] == pytest.approx(wins, abs=1e-4)
    losses = [r.loss for r in Q["train_boosted"](spark, SF001).orderBy("round").collect()]
    assert len(losses) == 301 and losses[0] == pytest.approx(np.log(2), rel=1e-9) and losses[-1] < losses[100] < losses[0]
    p = np.array([(r.prob, r.loan_status) for r in M.positive_probability(tm.models["Gradient Boosting"], split.where("is_train"), ["loan_status"]).collect()])
    w = np.where(p[:, 1] == 1, (p[:, 1] == 0).sum() / (p[:, 1] == 1).sum(), 1.0)
    assert losses[-1] == pytest.approx(-(w * np.log(np.where(p[:, 1] == 1, p[:, 0], 1 - p[:, 0]))).sum() / w.sum(), rel=1e-6)


def test_importances(spark):
    got = Q["model_importances"](spark, SF001).orderBy("rank").collect()
    model = MQ.chosen(spark, SF001).stages[-1]
    values = model.featureImportances.toArray() if hasattr(model, "featureImportances") else np.abs(model.coefficients.toArray())
    assert [r.importance for r in got] == sorted(values, reverse=True)
    assert {r.feature: r.importance for r in got} == dict(zip(fitted_on_train(spark, SF001)[1].feature_names, values))


def test_contributions_and_factors(spark):
    rows = Q["model_contributions"](spark, SF001).toPandas()
    names = fitted_on_train(spark, SF001)[1].feature_names
    people = T.applicants(spark, SF001)
    assert len(rows) == people.count() * len(names)
    model, explain = MQ.explained_model(spark, SF001)
    p = {r.loan_id: r.p for r in model.transform(people).select("loan_id", vector_to_array("probability")[1].alias("p")).collect()}
    told = rows.groupby("loan_id").contribution.sum() + explain.base
    for key, total in told.items():
        assert (1 / (1 + np.exp(-total)) if explain.scale == "log-odds" else total) == pytest.approx(p[key], abs=1e-9)
    factors = Q["model_risk_factors"](spark, SF001).toPandas()
    assert (factors.groupby(["loan_id", "direction"]).size() <= 5).all()
    rows["direction"] = np.where(rows.contribution > 0, "risk", "positive")
    rows["size"] = -rows.contribution.abs()
    top = rows.sort_values(["loan_id", "direction", "size", "position"]).groupby(["loan_id", "direction"]).head(5)
    want = {(r.loan_id, r.direction, r.raw_feature) for r in top.itertuples()}
    assert {(r.loan_id, r.direction, r.raw_feature) for r in factors.itertuples()} == want


def test_sweep_profiles_and_assessment(spark):
    sweep = Q["kmeans_sweep"](spark, SF001).orderBy("k").collect()
    assert [r.k for r in sweep] == list(range(2, 9)) and sum(r.is_best for r in sweep) == 1
    assert max(sweep, key=lambda r: (r.silhouette, -r.k)).is_best
    people = T.applicants(spark, SF001)
    x = np.array([r.x for r in J.vectors(people, SQ.space_of(spark, SF001), ["loan_id"]).select(vector_to_array("features").alias("x")).collect()])
    model, best, labelled = SQ.segment_model(spark, SF001)
    near = ((x[:, None, :] - best.centres[None]) ** 2).sum(2)
    assert near.min(1).sum() == pytest.approx(best.cost, rel=1e-9)
    assert best.cost <= next(r.inertia for r in sweep if r.is_best) * (1 + 1e-9)  # more starts, the same seeds first
    profiles = Q["kmeans_profiles"](spark, SF001).collect()
    assert {r.segment: r.cluster_size for r in profiles} == dict(zip(*np.unique(near.argmin(1), return_counts=True)))
    got = Q["assess_fitted"](spark, SF001).toPandas()
    classifier, _ = MQ.explained_model(spark, SF001)
    scored = M.batch_score(classifier, people, ["loan_id"]).toPandas().set_index("loan_id")
    one = got.drop_duplicates("loan_id").set_index("loan_id")
    assert set(one.index) <= set(scored.index) and (got.groupby("loan_id")["rank"].max() <= 5).all()
    assert (one.default_prob == scored.default_prob[one.index]).all() and (one.risk_level == scored.risk_level[one.index]).all()
    assigned = model.transform(people).select("loan_id", "segment").toPandas().set_index("loan_id").segment
    labels = {r.segment: r.segment_label for r in profiles}
    assert (one.segment == assigned[one.index]).all() and (one.segment_label == assigned[one.index].map(labels)).all()
    factors = Q["model_risk_factors"](spark, SF001).where("direction = 'risk'").toPandas().sort_values("rank").groupby("loan_id").feature.agg(", ".join)
    assert all(one.risk_factors[k] == factors.get(k, "") for k in one.index)
