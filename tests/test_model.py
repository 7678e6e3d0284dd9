"""Invariants for fitted models and sampling (no SQL oracle for these)."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sitewise.operators import model as MO
from sitewise.operators import windows as WI
from sitewise.plans import report as RP

LV = ["a", "b", "c"]


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        cls = LV[i % 3]
        x = {"a": 0.0, "b": 5.0, "c": 10.0}[cls] + float(rng.normal())
        rows.append((i, cls, x, float(rng.normal()), ["u", "v"][i % 2]))
    return spark.createDataFrame(rows, "id long, y string, x1 double, x2 double, cat string")


def _recipe():
    return MO.feature_recipe(["x1", "x2"], ["cat"], "y", LV)


def test_accuracy_above_majority_and_roundtrip(spark, separable, tmp_path):
    sp = WI.stratified_split(separable, "y", "id", 0.8, 123)
    tr, te = sp.where("split = 'train'"), sp.where("split = 'test'")
    assert tr.count() == 480 and te.count() == 120
    m = MO.fit(_recipe(), MO.random_forest(10, 2, 1), tr)
    pr = MO.predict(m, te, "id", "y", LV)
    acc = pr.agg(F.avg((F.col("truth") == F.col("pred")).cast("double"))).first()[0]
    assert acc > 0.8
    path = str(tmp_path / "m")
    m.write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    pr2 = MO.predict(PipelineModel.load(path), te, "id", "y", LV)
    assert sorted(pr.select("id", "pred").collect()) == sorted(pr2.select("id", "pred").collect())
    probs = pr.select(sum(F.col(c) for c in MO.prob_names(LV).values()).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in probs)


def test_forest_keeps_node_ids_and_its_trees(spark, separable):
    """Levels start from each row's node, not from the root; the trees stay."""
    est = MO.random_forest(6, 2, 1)
    assert est.getCacheNodeIds()
    kept, walked = (MO.fit(_recipe(), e, separable).stages[-1] for e in (est, est.copy({est.cacheNodeIds: False})))
    assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_boosted_and_others_predict_all_rows(spark, separable):
    for est in (MO.boosted_trees(3, 2, 0.3), MO.logistic(0.0), MO.linear_svm(0.01), MO.decision_tree(3)):
        pr = MO.predict(MO.fit(_recipe(), est, separable), separable, "id", "y", LV)
        assert pr.count() == 600
        assert pr.agg(F.avg((F.col("truth") == F.col("pred")).cast("double"))).first()[0] > 0.8


def test_adaboost_separable(spark, separable):
    out = MO.adaboost_samme(_recipe(), separable, separable, "id", "y", LV, rounds=3, depth=2)
    assert out.agg(F.avg((F.col("truth") == F.col("pred")).cast("double"))).first()[0] > 0.8


def test_adaboost_gives_one_row_per_test_row(spark, separable):
    """Repeated keys: votes are added row by row, not joined by key."""
    few = separable.where("id < 40")
    out = MO.adaboost_samme(_recipe(), separable, few.unionByName(few), "id", "y", LV, rounds=3, depth=2)
    assert out.count() == 80 and out.distinct().count() == 40


def test_split_and_folds_are_stable(spark, separable):
    a = WI.stratified_split(separable, "y", "id").select("id", "split")
    b = WI.stratified_split(separable.repartition(7), "y", "id").select("id", "split")
    assert sorted(a.collect()) == sorted(b.collect())
    f = WI.vfold_assign(separable, "y", "id", 5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in f} == {40}
    h = WI.vfold_assign_hash(separable, "id", 5).select("fold").distinct().count()
    assert h == 5


def test_latin_hypercube_one_point_per_stratum():
    g = MO.latin_hypercube({"a": (0.0, 1.0), "b": (-2.0, -1.0)}, 10, 123, log10=["b"])
    assert len(g) == 10
    assert sorted(int(p["a"] * 10) for p in g) == list(range(10))
    assert sorted(int((np.log10(p["b"]) + 2) * 10) for p in g) == list(range(10))


def test_tune_and_select_best(spark, separable):
    folds = WI.vfold_assign(separable, "y", "id", 2)
    grid = [{"mtry": 1, "min_n": 1}, {"mtry": 2, "min_n": 50}]
    res = MO.tune_grid(_recipe(), lambda mtry, min_n: MO.random_forest(5, mtry, min_n), grid, folds, "fold", "id", "y", LV, "rf")
    assert res.count() == 2 * 2 * 3
    best = MO.select_best(res).first()
    means = res.where("metric = 'accuracy'").groupBy("param_id").agg(F.avg("estimate").alias("m")).collect()
    assert best["mean"] == max(r["m"] for r in means)


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "maj", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))]
    rows += [(100 + i, "min", float(x) + 5, float(y) + 5) for i, (x, y) in enumerate(rng.normal(size=(13, 2)))]
    df = spark.createDataFrame(rows, "id long, y string, a double, b double")
    out = MO.smote_2d(df, "y", "a", "b", "id", k=5)
    sizes = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert sizes == {"maj": 60, "min": 60}
    base = {r[0]: (r[2], r[3]) for r in rows}
    for r in out.where("synthetic").collect():
        bx, by = base[r["base_id"]]
        # new point lies on the segment from its base to the chosen neighbour
        cross = (r["a"] - bx) * (r["ny"] - by) - (r["b"] - by) * (r["nx"] - bx)
        assert abs(cross) < 1e-6
        assert min(bx, r["nx"]) - 1e-9 <= r["a"] <= max(bx, r["nx"]) + 1e-9
    again = MO.smote_2d(df, "y", "a", "b", "id", k=5).where("synthetic").select("id", "a", "b")
    assert sorted(again.collect()) == sorted(out.where("synthetic").select("id", "a", "b").collect())


def test_shapley_additivity(spark, separable):
    m = MO.fit(_recipe(), MO.random_forest(5, 2, 1), separable)
    small = separable.where("id < 12")
    phi = MO.shapley_sampled(m, small, separable, ["x1", "x2", "cat"], "id", LV, samples=6)
    tot = phi.groupBy("id").agg(F.sum("phi").alias("s"), F.first("fx").alias("fx"), F.first("base").alias("base")).collect()
    assert len(tot) == 12
    for r in tot:
        assert r["s"] == pytest.approx(r["fx"] - r["base"], abs=1e-9)


def plain_shapley(m, rows, background, features, samples, seed=123):
    """Each walk step by step, every mixture scored; hashes taken from Spark."""
    spark = rows.sparkSession
    bg = [r.asDict() for r in background.withColumn("h", F.xxhash64("id", F.lit(seed))).orderBy("h", "id").drop("h").collect()]
    hashes = spark.range(samples).withColumnRenamed("id", "s").crossJoin(rows).withColumn("sid", F.col("id") * 1009 + F.col("s")).select(
        "id", "s", F.pmod(F.xxhash64(F.col("sid"), F.lit(seed + 1)), F.lit(len(bg))).alias("b"),
        F.array(*[F.xxhash64("sid", F.lit(j), F.lit(seed)) for j in range(len(features))]).alias("h")).collect()
    xs = {r["id"]: r.asDict() for r in rows.collect()}
    mixed = []
    for w in hashes:
        order = sorted(range(len(features)), key=lambda j: (w["h"][j], j))
        for t in range(len(features) + 1):
            row = {**bg[w["b"]], **{features[j]: xs[w["id"]][features[j]] for j in order[:t]}}
            mixed.append((w["id"], int(w["s"]), t, features[order[t - 1]] if t else None, *[row[f] for f in features], row["y"]))
    types = dict(rows.dtypes)
    df = spark.createDataFrame(mixed, "k long, s int, t int, added string, " + ", ".join(f"{f} {types[f]}" for f in features) + ", y string")
    got = m.transform(df).select("k", "s", "t", "added", vector_to_array("probability").alias("p")).collect()
    cls = {r["id"]: int(r["prediction"]) for r in m.transform(rows).select("id", "prediction").collect()}
    f = {(r["k"], r["s"], r["t"]): r["p"][cls[r["k"]]] for r in got}
    phi = {(i, g): 0.0 for i in xs for g in features}
    for r in got:
        if r["t"]:
            phi[r["k"], r["added"]] += (f[r["k"], r["s"], r["t"]] - f[r["k"], r["s"], r["t"] - 1]) / samples
    return phi


@pytest.mark.parametrize("features", [["x1", "x2", "cat"], ["x1"]])
def test_shapley_equals_plain_walks_without_ordering_them(spark, separable, features):
    m = MO.fit(_recipe(), MO.random_forest(5, 2, 1), separable)
    small = separable.where("id < 9")
    if len(features) == 1:  # a model of the one feature alone
        m = MO.fit(MO.feature_recipe(["x1"], [], "y", LV), MO.random_forest(5, None, 1), separable)
    out = MO.shapley_sampled(m, small, separable, features, "id", LV, samples=4)
    assert "lag(" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = plain_shapley(m, small, separable, features, 4)
    got = {(r["id"], r["feature"]): r["phi"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_permutation_importance_ranks_signal(spark, separable):
    m = MO.fit(_recipe(), MO.random_forest(10, 2, 1), separable)
    imp = {r["feature"]: r["importance"] for r in MO.permutation_importance(m, separable, ["x1", "x2", "cat"], "id", "y", LV).collect()}
    assert imp["x1"] > 0.3 and imp["x1"] > imp["x2"]


def test_report_parameter_checks(spark):
    RP.validate_params("single", "ASIA", 2005)
    for args in (("weekly", None, 2005), ("single", None, 2005), ("overall", None, 1999), ("single", "Mars", 2005)):
        with pytest.raises(ValueError):
            RP.validate_params(*args, known_regions=["ASIA"])
    df = spark.createDataFrame([("ASIA", "x")], "region string, s string")
    present, rejected = RP.batch_split(df, "region", ["ASIA", "Mars"])
    assert present.count() == 1 and [r["region"] for r in rejected.collect()] == ["Mars"]


def test_fold_and_feature_counts(spark, separable):
    """Number of distinct fold ids and number of features (report figures)."""
    folds = WI.vfold_assign(separable, "y", "id", 5)
    assert folds.select(F.countDistinct("fold")).first()[0] == 5
    features = [c for c in separable.columns if c not in ("id", "y")]
    assert len(separable.columns) - 2 == len(features) == 3
    prep = _recipe().fit(separable)
    width = prep.transform(separable).select("features").first()[0].size
    assert width == 2 + 2 + 1  # two numeric, two levels of cat, plus the unseen-level slot


def test_report_rollup_keeps_real_nulls(spark):
    import datetime as dt

    rows = [("r1", "bad", dt.date(2001, 1, 1)), ("r1", "ok", dt.date(2001, 1, 1)), ("r1", None, dt.date(2002, 1, 1)),
            ("r2", "ok", dt.date(2001, 5, 1))]
    df = spark.createDataFrame(rows, "region string, s string, d date")
    out = RP.report_long(df, "region", "s", "d", "bad").collect()
    got = {(r["region"], r["section"], r["status_group"], r["year"]): (r["n"], r["value"]) for r in out}
    assert got[("r1", "headline", None, None)] == (3, pytest.approx(100 / 3, abs=1e-6))
    assert got[("r1", "distribution", None, None)] == (1, pytest.approx(1 / 3, abs=1e-6))
    assert got[("r1", "trend", None, 2002)] == (1, None)
    assert got[("r2", "headline", None, None)] == (1, 0.0)
    assert len(out) == (1 + 3 + 3) + (1 + 1 + 1)


def test_registered_tuning_is_the_whole_job(spark, monkeypatch):
    """Two families, 10 points, 5 folds, the reference's ranges; run with small
    models on few rows, each point's parameters recorded."""
    from sitewise.plans import bindings as B
    from sitewise.plans import q_model as Q
    from tests.tables import SF_SMALL

    assert MO.random_forest().getMaxDepth() == 30
    asked = []
    small = {"random_forest": lambda **p: asked.append(("random_forest", p)) or MO.decision_tree(1),
             "boosted_trees": lambda **p: asked.append(("boosted_trees", p)) or MO.decision_tree(2)}
    monkeypatch.setattr(Q, "MAKE", small)
    sites = B.order_sites(spark, SF_SMALL).limit(400).checkpoint()
    monkeypatch.setattr(B, "order_sites", lambda s, d: sites)
    res = Q.tune(spark, SF_SMALL).groupBy("model").count().collect()
    assert {r["model"]: r["count"] for r in res} == {"random_forest": 150, "boosted_trees": 150}
    assert len(asked) == 100
    ranges = {"random_forest": {"mtry": (5, 15), "trees": (500, 1000), "min_n": (2, 10)},
              "boosted_trees": {"trees": (500, 1000), "tree_depth": (3, 8), "learn_rate": (0.01, 0.1)}}
    for name, p in asked:
        assert set(p) == set(ranges[name])
        assert all(lo <= p[k] <= hi for k, (lo, hi) in ranges[name].items())
