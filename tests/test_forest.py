"""Forest of deep trees against a plain tree, Spark ML's forest, and itself."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array

from sitewise.operators import forest as FO
from sitewise.operators import model as MO
from sitewise.plans import q_model as Q

CLASSES = 3


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 40, 500), rng.integers(0, 2, 500), np.round(rng.normal(size=500), 2), np.ones(500)])
    y = ((x[:, 0] > 15).astype(int) + (x[:, 2] > 0.3)).astype(int)
    y[::7] = rng.integers(0, 3, len(y[::7]))
    return x, y


def frame(spark, x, y, parts=4):
    rows = [(i, [float(v) for v in r], None if c is None else int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(parts)
    return df.select("id", array_to_vector("x").alias("features"), "label")


def probabilities(model, df):
    got = model.transform(df).select("id", vector_to_array("probability").alias("p")).collect()
    return np.array([r["p"] for r in sorted(got, key=lambda r: r["id"])])


def plain_tree(bins, y, min_n, levels):
    """Nested (feature, bin, left, right) or the leaf's class counts, every cut tried."""
    n, counts = len(y), np.bincount(y, minlength=CLASSES)
    best = (1e-12, None)
    if levels:
        for f in range(bins.shape[1]):
            for c in range(bins[:, f].max()):
                go = bins[:, f] <= c
                a, b = np.bincount(y[go], minlength=CLASSES), np.bincount(y[~go], minlength=CLASSES)
                if min(a.sum(), b.sum()) < min_n:
                    continue
                gain = ((a**2).sum() / a.sum() + (b**2).sum() / b.sum() - (counts**2).sum() / n) / n
                if gain > best[0] + 1e-12:
                    best = (gain, (f, c, go))
    if best[1] is None:
        return counts.tolist()
    f, c, go = best[1]
    left, right = (plain_tree(bins[s], y[s], min_n, levels - 1) for s in (go, ~go))
    if isinstance(left, list) and isinstance(right, list) and np.argmax(left) == np.argmax(right):
        return counts.tolist()
    return f, c, left, right


def plain_leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("min_n, levels", [(1, 30), (6, 30), (3, 4), (6, 0)])
def test_grows_the_plain_tree(table, min_n, levels):
    x, y = table
    x = x[:, 2:3]  # one feature: no draw decides a tie
    layout = FO._Layout([np.unique(np.quantile(x, np.arange(1, 200) / 200))])
    bins = layout.bins(x)
    w = np.random.default_rng(1).poisson(1.0, len(y)).astype(np.uint8)
    use = w > 0
    want = plain_tree(np.repeat(bins, w, axis=0), np.repeat(y, w), min_n, levels)
    f, c, left, leaves = FO._pruned(*FO._grow(
        layout, bins[use], y[use], w[use], CLASSES, 1, min_n, levels, np.random.default_rng(0)))
    end = left[FO._walk(bins, f, c, left)]
    assert leaves.sum() == w.sum()
    assert np.array_equal(np.array([np.bincount(y[end == i], w[end == i], CLASSES) for i in range(len(leaves))]), leaves)
    assert [leaves[i].tolist() for i in end] == [plain_leaf(want, row) for row in bins]


def test_rows_survive_packing(table):
    x, _ = table
    layout = FO._Layout([np.arange(0, 39.0), np.array([0.0]), np.array([-1.0, 0.0, 1.0]), np.array([])])
    bins = layout.bins(x)
    assert layout.pack(bins).shape == (500, 3)  # two wide features, two in bits
    assert np.array_equal(layout.unpack(layout.pack(bins).tobytes(), 500), bins)
    none = FO._Layout([np.array([])] * 2)
    assert np.array_equal(none.unpack(none.pack(bins[:, 3:].repeat(2, 1)).tobytes(), 500), bins[:, 3:].repeat(2, 1))


def test_same_forest_whether_nodes_fit_a_task_or_not(spark, table, monkeypatch):
    """One feature, so no draw decides a tie: nodes above LOCAL rows by jobs over all
    blocks, waves of two trees."""
    df = frame(spark, table[0][:, 2:3], table[1])
    whole = FO.DeepForest(5, 1, 1).fit(df)
    monkeypatch.setattr(FO, "LOCAL", 60)
    monkeypatch.setattr(FO, "WAVE", 1000)
    parts = FO.DeepForest(5, 1, 1).fit(df)
    assert [len(tops) for tops, _ in whole.waves] == [5] and [len(tops) for tops, _ in parts.waves] == [2, 2, 1]
    assert all(len(top[0]) == 1 for tops, _ in whole.waves for top in tops.values())
    assert all(len(top[0]) > 7 for tops, _ in parts.waves for top in tops.values())
    assert probabilities(whole, df) == pytest.approx(probabilities(parts, df), abs=1e-12)


def test_equals_sparks_forest_up_to_its_draws(spark, table, monkeypatch):
    """About as near to Spark's forest as two of those are to each other."""
    df = frame(spark, *table).checkpoint()
    spark_forest = MO.random_forest(60, 2, 5, seed=1).fit(df)
    a, b = probabilities(spark_forest, df), probabilities(MO.random_forest(60, 2, 5, seed=2).fit(df), df)
    for local in (FO.LOCAL, 60):
        monkeypatch.setattr(FO, "LOCAL", local)
        forest = MO.deep_forest(60, 2, 5).fit(df)
        assert np.abs(probabilities(forest, df) - a).mean() < 1.5 * np.abs(a - b).mean() + 0.005
    assert sum(len(g[1][0]) for _, grown in forest.waves for g in grown.collect()) > 0.5 * spark_forest.totalNumNodes


def test_edge_rows(spark, table):
    """Unlabelled rows teach nothing, repeated and NaN rows are scored, no rows are refused."""
    x, y = table
    x = x[:60].copy()
    x[3, 0] = np.nan
    y = [None if i % 9 == 0 else int(v) for i, v in enumerate(y[:60])]
    df = frame(spark, x, y)
    m = FO.DeepForest(20, 2, 1).fit(df)
    assert sum(g[1][3].sum() for _, grown in m.waves for g in grown.collect()) < 20 * 60
    out = m.transform(df.unionByName(df)).collect()
    assert len(out) == 120 and all(sum(r["probability"]) == pytest.approx(1) for r in out)
    assert all(r["prediction"] == np.argmax(r["probability"]) for r in out)
    m.release()
    assert m.transform(df.where("id < 5")).count() == 5
    assert m.transform(df.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        FO.DeepForest(5).fit(df.where("label IS NULL"))
    one = FO.DeepForest(8).fit(df.where("label = 1").limit(1))  # a tree may have drawn nothing
    assert all(r["probability"].toArray().tolist() == [0, 1] for r in one.transform(df).collect())


def test_registered_forests_keep_their_nodes_off_the_driver():
    """750 trees of Spark's forest do not fit the time limit, nor the driver at size."""
    assert isinstance(Q.MAKE["random_forest"](5, 750, 6), FO.DeepForest)
    big = MO.deep_forest(**Q.FOREST)
    assert (big.trees, big.mtry, big.min_n, big.levels, big.max_bins) == (750, 10, 6, 30, 64)
