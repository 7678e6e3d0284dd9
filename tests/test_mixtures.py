"""Mixtures walked down flat trees, against Spark ML's own scores."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sitewise.operators import mixtures as MX
from sitewise.operators import model as MO

LV = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(i, LV[int(rng.integers(0, 3))], None if i % 19 == 0 else float(rng.integers(0, 40)), float(rng.normal()),
             None if i % 23 == 0 else ["u", "v", "w"][int(rng.integers(0, 3))]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, y string, x1 double, x2 double, cat string")


def recipe():
    return MO.feature_recipe(["x1", "x2"], ["cat"], "y", LV)


def test_flat_trees_score_as_the_forest_does(spark, table):
    m = MO.fit(recipe(), MO.random_forest(4, 3, 1), table)
    sources = MX.slot_sources(m.stages[:-1], ["x1", "x2", "cat"])
    assert sources.tolist() == [0, 1, 2, 2, 2, 2]
    forest = MX.Forest.of(spark, m.stages[-1], len(sources))
    got = m.transform(table).select(vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).collect()
    x, p = np.array([r["x"] for r in got]), np.array([r["p"] for r in got])
    for c in range(p.shape[1]):
        assert np.allclose(forest.share(forest.codes(x), np.full(len(x), c)), p[:, c], atol=1e-12)


def test_mixtures_are_not_rows_of_the_model(spark, table, monkeypatch):
    """The model scores the two ends of a walk; codes are shuffled, not features. Rows of a
    model that is not known slot by slot give the same values."""
    m = MO.fit(recipe(), MO.random_forest(4, 3, 1), table)
    few = table.where("id < 20")
    out = MO.shapley_sampled(m, few, table, ["x1", "x2", "cat"], "id", LV, samples=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_t#" not in plan and "MapInArrow" in plan
    got = {(r["id"], r["feature"]): r for r in out.collect()}
    monkeypatch.setattr(MO, "slot_sources", lambda *_: None)
    want = MO.shapley_sampled(m, few, table, ["x1", "x2", "cat"], "id", LV, samples=5).collect()
    assert len(want) == len(got) == 60
    for r in want:
        for c in ("phi", "fx", "base"):
            assert got[r["id"], r["feature"]][c] == pytest.approx(r[c], abs=1e-9)


def test_unknown_models_are_refused(spark, table):
    logistic = MO.fit(recipe(), MO.logistic(0.01), table)
    assert MX.Forest.of(spark, logistic.stages[-1], 6) is None
    assert MX.slot_sources([logistic.stages[-1]], ["x1"]) is None
    out = MO.shapley_sampled(logistic, table.where("id < 5"), table, ["x1", "x2", "cat"], "id", LV, samples=2)
    sums = out.groupBy("id").agg(F.sum("phi").alias("s"), F.first("fx").alias("fx"), F.first("base").alias("b")).collect()
    assert len(sums) == 5 and all(r["s"] == pytest.approx(r["fx"] - r["b"], abs=1e-9) for r in sums)
