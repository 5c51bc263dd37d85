"""Edge fixtures for detection, validation, quantiles, features, metrics and the split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.functions.quantiles import exact_quantiles
from lendscope.operators import clean as C
from lendscope.operators import features as D
from lendscope.operators import metrics as G
from lendscope.operators import profile as B
from lendscope.operators import training as TR


def test_id_trap_and_uniqueness(spark):
    df = spark.createDataFrame([("a", 1, 1.5), ("b", 2, 2.5), ("c", 3, 3.5)], "residence string, uid long, amount double")
    # 'residence' contains 'id'; uid matches by name too; amount is all-distinct double
    assert B.detect_id_columns(df) == ["residence", "uid", "amount"]


def test_id_null_blocks_uniqueness(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert B.detect_id_columns(df) == []


def test_target_candidate_order(spark):
    df = spark.createDataFrame([(0, 1), (1, 0)], "`default` int, loan_status int")
    assert B.detect_target_column(df) == ("loan_status", "name")


def test_target_bounds_exclusive(spark):
    rows = [(1 if i < 1 else 0, 1 if i < 90 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "y0 int, y1 int")
    assert B.detect_target_column(df) == (None, None)


def test_target_none(spark):
    df = spark.createDataFrame([(1.5, "a")], "a double, b string")
    assert B.detect_target_column(df) == (None, None)
    with pytest.raises(Exception):
        C.feature_projection(df, "missing_col", [])


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(size=5000).round(3).tolist() + [None] * 10
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(vals)], "x double, g int")
    out = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], ["g"]).collect()
    for r in out:
        xs = np.array([v for i, v in enumerate(vals) if v is not None and i % 3 == r["g"]])
        want = np.quantile(xs, [0.25, 0.5, 0.75])
        got = [r["q0"], r["q1"], r["q2"]]
        assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).first()["q0"] == 1.5


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan"))], "a int, b double")
    row = B.duplicate_stats(df).first()
    assert (row["n_rows"], row["duplicate_rows"], row["total_missing"]) == (3, 1, 3)
    rep = {r["column_name"]: (r["missing"], r["missing_pct"]) for r in B.missing_report(df).collect()}
    assert rep == {"b": (3, 100.0)}


def test_drop_sparse_columns(spark):
    rows = [(i, None if i < 7 else 1.0, None if i < 6 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, seventy double, sixty double")
    assert C.clean(df).columns == ["k", "sixty"]


def test_validate_rows_messages(spark):
    df = spark.createDataFrame([(1, "2.5", "x"), (2, "abc", "y"), (3, None, "z")], "k int, n string, c string")
    got = {r["k"]: (r["is_valid"], r["error_message"]) for r in C.validate_rows(df, ["n"], ["c"]).collect()}
    assert got[1] == (True, "")
    assert got[2] == (False, "Field 'n' must be numeric, got: 'abc'")
    assert got[3] == (False, "Field 'n' must be numeric, got: None")
    missing = C.validate_rows(df, ["n", "absent"], ["c"]).first()
    assert missing["error_message"] == "Missing required fields: ['absent']"


def test_unseen_level_and_constant(spark):
    train = spark.createDataFrame([("A", 1.0), ("B", 1.0), (None, 1.0)], "g string, x double")
    fitted = D.fit_features(train, ["x"], ["g"])
    assert fitted.levels["g"] == ["A", "B", "missing"]
    assert fitted.scales["x"] == 1.0  # zero std -> 1
    new = spark.createDataFrame([("Z", 3.0), (None, None)], "g string, x double")
    rows = D.transform(new, fitted).collect()
    assert [rows[0][c] for c in fitted.feature_names] == [2.0, 0.0, 0.0, 0.0]
    assert [rows[1][c] for c in fitted.feature_names] == [0.0, 0.0, 0.0, 1.0]


def test_split_is_exact_and_stratified(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "k long, y int")
    out = D.stratified_split(df, "y", "k", bucket_bits=4)
    counts = {(r["y"], r["is_train"]): r["count"] for r in out.groupBy("y", "is_train").count().collect()}
    assert counts[(1, True)] == 1000 - round(0.2 * 1000) and counts[(0, True)] == 2000 - 400
    # same membership as a plain global ranking by (hash, key)
    pdf = out.toPandas()
    pdf["h"] = ((pdf["k"] % 2**31) * 2654435761) % 2**32
    for y, grp in pdf.groupby("y"):
        grp = grp.sort_values(["h", "k"])
        n_train = len(grp) - int(np.rint(0.2 * len(grp)))
        assert grp["is_train"].tolist() == [True] * n_train + [False] * (len(grp) - n_train)


def test_no_positive_predictions(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2), (1, 0.3)], "y int, p double")
    row = G.classification_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    cm = {(r["actual"], r["predicted"]): r["count"] for r in G.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 1, (0, 1): 0, (1, 0): 2, (1, 1): 0}


def test_auc_ties_half_and_monotone(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert G.roc_auc(df).first()["roc_auc"] == 0.875
    sq = df.withColumn("p", F.col("p") * F.col("p"))
    assert G.roc_auc(sq).first()["roc_auc"] == 0.875


def test_roc_drops_collinear(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    pts = sorted((r["fpr"], r["tpr"]) for r in G.roc_curve(df).collect())
    assert pts == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)] or pts == [(0.0, 0.0), (0.0, 0.3333), (0.0, 1.0), (1.0, 1.0)]
    assert (0.0, 0.6667) not in pts


def test_select_best_first_on_ties(spark):
    df = spark.createDataFrame([("b", 1, 0.9, 0.5, 0.5), ("a", 0, 0.9, 0.5, 0.5)],
                               "model string, ordinal int, roc_auc double, recall double, f1 double")
    best = [r["model"] for r in G.select_best(df).where("is_best").collect()]
    assert best == ["a"]



def test_csv_na_tokens_and_reinference(spark):
    import os
    import tempfile

    from lendscope.sources.csv import read_csv

    d = tempfile.mkdtemp(prefix="lendscope-csv-")
    path = os.path.join(d, "x.csv")
    with open(path, "w") as fh:
        fh.write("a,b,c\n1,NA,x\n2,3.5,n/a\nNULL,4,y\n")
    df = read_csv(spark, path, multiline=True)
    types = dict(df.dtypes)
    assert types["a"] == "bigint" and types["b"] == "double" and types["c"] == "string"
    rows = sorted(df.collect(), key=lambda r: (r["a"] is None, r["a"] or 0))
    assert [r["a"] for r in rows] == [1, 2, None]
    assert [r["b"] for r in rows] == [None, 3.5, 4.0]
    assert [r["c"] for r in rows] == ["x", None, "y"]


def test_same_answer_for_1_and_8_partitions(spark):
    rows = [(i, 1 if i % 4 == 0 else 0, float((i * 37) % 101)) for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "k long, y int, x double")
    outs = []
    for n in (1, 8):
        part = df.repartition(n)
        split = {r["k"]: r["is_train"] for r in D.stratified_split(part, "y", "k", bucket_bits=6).collect()}
        qs = exact_quantiles(part, ["x"], [0.25, 0.5, 0.75], ["y"]).orderBy("y").collect()
        outs.append((split, [(r["y"], r["q0"], r["q1"], r["q2"]) for r in qs]))
    assert outs[0] == outs[1]


def test_clip_keeps_missing(spark):
    from lendscope.operators.scorecard import clip_bounds

    df = spark.createDataFrame([(None, 50.0, None, 3), (10**9, None, 1, None)],
                               "person_income long, person_emp_length double, loan_amnt long, cb_person_cred_hist_length int")
    rows = [tuple(r) for r in clip_bounds(df).collect()]
    assert rows == [(None, 40.0, None, 3), (500000, None, 500, None)]


def test_csv_hostile_fixture(spark, tmp_path):
    from lendscope.sources.csv import read_csv, write_csv

    path = tmp_path / "x.csv"
    path.write_text('id,name,day,rate,flag,note\n1,"say ""hi""",2024-01-05,NaN,True,"two\nlines"\n'
                    '2, NA ,2024-02-06,1e-3,False,"a,b"\n3,NA,n/a,.5,,"NULL"\n')
    df = read_csv(spark, str(path), multiline=True)
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "day": "string", "rate": "double", "flag": "boolean", "note": "string"}
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, 'say "hi"', "2024-01-05", None, True, "two\nlines"), (2, " NA ", "2024-02-06", 0.001, False, "a,b"),
                    (3, None, None, 0.5, None, None)]
    write_csv(df, str(tmp_path / "out"))
    again = read_csv(spark, str(tmp_path / "out"), multiline=True)
    assert again.dtypes == df.dtypes and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


def test_csv_scan_of_orders(spark):
    from lendscope.plans.registry import QUERIES, load_all

    load_all()
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    got = QUERIES["csv_scan_orders"](spark, "/root/testdata/sf0.001")
    assert got.columns == orders.columns and got.count() == orders.count()
    plan = got._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().options()
    assert plan.get("multiLine").get() == "false"


def test_target_with_nan_is_found(spark):
    df = spark.createDataFrame([(float("nan"), 1.5), (1.0, 2.5), (0.0, 2.5), (0.0, 3.5)], "t double, x double")
    assert B.detect_target_column(df) == ("t", "binary")


def test_id_detection_is_certain(spark):
    rows = [(i, i % 7, float(i) if i else None, float(i * 3)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "a long, b long, c double, d double")
    assert B.detect_id_columns(df) == ["a", "d"]
    late = spark.createDataFrame([(min(i, 29_998), 1) for i in range(30_000)], "e long, f int")  # one repeat, far behind
    assert B.detect_id_columns(late) == []


def test_duplicates_of_whole_lines(spark):
    from lendscope.plans.registry import QUERIES, load_all

    load_all()
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    repeated = lines.where("l_orderkey % 10 = 0").count()
    assert repeated and lines.distinct().count() == lines.count()
    assert QUERIES["duplicate_count_lines"](spark, "/root/testdata/sf0.001").first()[0] == repeated
    left = QUERIES["drop_duplicates_lines"](spark, "/root/testdata/sf0.001")
    assert left.columns == lines.columns and left.count() == lines.count()


def test_duplicates_by_hash_equal_plain_count(spark):
    rows = [(None, "x"), ("x", None), (None, "x"), ("", None), ("", None), ("", None), ("a", "b")]
    row = B.duplicate_stats(spark.createDataFrame(rows, "p string, q string")).first()
    assert (row["n_rows"], row["duplicate_rows"], row["total_missing"]) == (7, 3, 6)
    empty = B.duplicate_stats(spark.createDataFrame([], "p string, q string")).first()
    assert (empty["n_rows"], empty["duplicate_rows"], empty["total_missing"]) == (0, 0, 0)


def test_split_refuses_missing_labels_and_falls_back(spark):
    with pytest.raises(ValueError, match="20 missing"):
        D.stratified_split(spark.createDataFrame([(i, None if i < 20 else i % 2) for i in range(100)], "k long, y int"), "y", "k")
    lone = spark.createDataFrame([(i, 1 if i == 5 else 0) for i in range(100)], "k long, y int")  # a class of one row
    assert D.stratified_split(lone, "y", "k").where("is_train").count() == 80


def test_all_missing_numeric_is_dropped_and_wide_levels_raise(spark, monkeypatch):
    df = spark.createDataFrame([(None, 1.0, str(i)) for i in range(30)], "x double, y double, g string")
    assert D.fit_features(df, ["x", "y"], []).num_features == ["y"]
    monkeypatch.setattr(D.S, "MOST_LEVELS", 10)
    with pytest.raises(ValueError, match="g"):
        D.fit_levels(df, ["g"])


def test_unrounded_scores_decide(spark):
    near = spark.createDataFrame([(1, 0.50004), (0, 0.50001), (0, 0.49999)], "y int, p double")
    assert {(r["actual"], r["predicted"]): r["count"] for r in G.confusion_matrix(near).collect()}[(1, 1)] == 1
    pairs = spark.createDataFrame([(1, 0.30001 + i * 1e-5) for i in range(5)] + [(0, 0.3)] * 5, "y int, p double")
    assert G.roc_auc(pairs).first()["roc_auc"] == 1.0


def test_roc_of_many_scores_equals_numpy(spark):
    rng = np.random.default_rng(5)
    y, p, m = rng.integers(0, 2, 4000), np.round(rng.random(4000), 3), rng.integers(0, 3, 4000)
    df = spark.createDataFrame([(int(a), float(b), f"m{c}") for a, b, c in zip(y, p, m)], "y int, p double, model string").repartition(7)
    got = {r["model"]: r["roc_auc"] for r in G.roc_auc(df, group="model").collect()}
    for k in range(3):
        a, b = y[m == k], p[m == k]
        above = (b[a == 1][:, None] > b[a == 0][None, :]).mean() + 0.5 * (b[a == 1][:, None] == b[a == 0][None, :]).mean()
        assert got[f"m{k}"] == pytest.approx(above, abs=5e-5)


def test_skewed_quantiles_equal_numpy(spark, monkeypatch):
    from lendscope.functions import quantiles as Q

    rng = np.random.default_rng(2)
    n = 6000
    same = np.where(rng.random(n) < 0.9, 7.0, rng.random(n) * 1e6)
    wide = 10.0 ** rng.uniform(-300, 300, n)
    data = [(int(i % 3), float(a), float(b), None if i % 5 else float(b)) for i, (a, b) in enumerate(zip(same, wide))]
    df = spark.createDataFrame(data, "g int, a double, b double, c double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for few in (Q.FEW, 20):  # 20: several narrowing passes
        monkeypatch.setattr(Q, "FEW", few)
        for r in Q.exact_quantiles(df, ["a", "b", "c"], probs, ["g"]).collect():
            values = [x["abc".index(r["feature"]) + 1] for x in data if x[0] == r["g"]]
            values = [v for v in values if v is not None]
            assert r["n"] == len(values)
            assert [r[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)


def test_quantiles_shuffle_no_raw_rows(spark):
    """Every exchange above the unpivoted rows carries partial aggregates, whatever the broadcast threshold."""
    from lendscope.functions import quantiles as Q

    plans = []
    listed = type(spark.range(1)).collect
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        type(spark.range(1)).collect = lambda self: (plans.append(self._jdf.queryExecution().sparkPlan().toString()), listed(self))[1]
        Q.exact_quantiles(spark.range(5000).select(F.rand(1).alias("x"), F.rand(2).alias("y")), ["x", "y"], [0.5]).count()
    finally:
        type(spark.range(1)).collect = listed
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) >= 2 and all("SortMergeJoin" not in p and "ShuffledHashJoin" not in p for p in plans)


def _sides(out):
    return {(r["y"], r["is_train"]): r["n"] for r in out.groupBy("y", "is_train").agg(F.count("*").alias("n")).collect()}


def test_split_of_negative_and_repeated_keys(spark):
    label = (F.col("id") % 5 == 0).cast("int").alias("y")
    negative = spark.range(1000).select((F.col("id") - 500).alias("k"), label)
    assert _sides(D.stratified_split(negative, "y", "k")) == {(0, True): 640, (0, False): 160, (1, True): 160, (1, False): 40}
    ten = spark.range(1000).select((F.col("id") % 10).alias("k"), "id", label)
    assert _sides(D.stratified_split(ten, "y", "k")) == {(0, True): 640, (0, False): 160, (1, True): 160, (1, False): 40}
    one = spark.range(1000).select(F.lit(7).alias("k"), "id", label)
    assert _sides(D.stratified_split(one, "y", "k", bucket_bits=4)) == {(0, True): 640, (0, False): 160, (1, True): 160, (1, False): 40}
    none = spark.range(1000).select(F.lit(None).cast("long").alias("k"), "id", label)
    out = D.stratified_split(none, "y", "k")
    assert _sides(out) == {(0, True): 640, (0, False): 160, (1, True): 160, (1, False): 40} and out.where("is_train is null").count() == 0
    equal = spark.range(100).select(F.lit(7).alias("k"), (F.col("id") % 2).cast("int").alias("y"))
    assert _sides(D.stratified_split(equal, "y", "k")) == {(0, True): 50, (1, True): 50}  # equal rows stay together
    shuffled = ten.orderBy(F.rand(3)).repartition(7)
    assert sorted(D.stratified_split(shuffled, "y", "k").where("is_train").select("id").collect()) == \
        sorted(D.stratified_split(ten, "y", "k").where("is_train").select("id").collect())


def test_prepare_chooses_a_unique_id(spark):
    df = spark.range(1500).select((F.col("id") % 7).alias("residence"), (F.col("id") * 3 - 900).alias("loan_id"),
                                  (F.col("id") % 11).cast("double").alias("x"), (F.col("id") % 4 == 0).cast("int").alias("loan_status"))
    ready = TR.prepare(df)
    assert (ready.key, ready.num_features) == ("loan_id", ["x"])
    assert _sides(ready.split.withColumnRenamed("loan_status", "y")) == {(0, True): 900, (0, False): 225, (1, True): 300, (1, False): 75}
    without = TR.prepare(df.drop("loan_id").withColumn("z", F.rand(1)).withColumn("w", F.lit("a")))
    assert without.key == "_row" and without.split.where("is_train is null").count() == 0


def test_levels_with_quotes_and_backslashes(spark):
    levels = ["a\\", "o'k", "plain", "\\'", "x\\n"]
    df = spark.createDataFrame([(i, levels[i % 5], float(i)) for i in range(50)], "k long, c string, x double")
    fitted = D.fit_features(df, ["x"], ["c"])
    from pyspark.ml.feature import SQLTransformer
    rows = SQLTransformer(statement=fitted.sql_statement()).transform(df).orderBy("k").collect()
    for r in rows:
        assert [r[f"__f{i}"] for i in range(1, 6)] == [float(r["c"] == lv) for lv in fitted.levels["c"]]
