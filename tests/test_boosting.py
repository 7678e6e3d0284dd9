"""Boosted trees against a plain booster, split by split."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sitewise.operators import boosting as BO

CLASSES, ROUNDS, DEPTH, RATE = 3, 6, 3, 0.3


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 9, 180), rng.integers(0, 2, 180), np.round(rng.normal(size=180), 1), np.ones(180)])
    y = ((x[:, 0] > 4).astype(int) + (x[:, 2] > 0.3)).astype(int)
    y[::17] = rng.integers(0, 3, len(y[::17]))
    return x, y


def frame(spark, x, y, parts=4):
    rows = [(i, [float(v) for v in r], None if c is None else int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(parts)
    return df.select("id", array_to_vector("x").alias("features"), "label")


def plain_tree(x, g, h, cuts, depth, rows):
    """Nested (feature, cut, left, right) or leaf value, every cut tried on the rows themselves."""
    G, H = g[rows].sum(), h[rows].sum()
    best = (BO.LEAST_GAIN, None)
    if depth:
        for f, cs in enumerate(cuts):
            for c in cs:
                left = rows[x[rows, f] <= c]
                GL, HL = g[left].sum(), h[left].sum()
                GR, HR = G - GL, H - HL
                if min(HL, HR) < BO.SCALE:
                    continue
                gain = sum((a / BO.SCALE) ** 2 / (b / BO.SCALE + 1) for a, b in ((GL, HL), (GR, HR)))
                gain -= (G / BO.SCALE) ** 2 / (H / BO.SCALE + 1)
                if gain > best[0]:
                    best = (gain, (f, c))
    if best[1] is None:
        return -RATE * (G / BO.SCALE) / (H / BO.SCALE + 1)
    f, c = best[1]
    go = x[rows, f] <= c
    return (f, c, plain_tree(x, g, h, cuts, depth - 1, rows[go]), plain_tree(x, g, h, cuts, depth - 1, rows[~go]))


def plain_score(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_boost(x, y, cuts):
    scores, rounds = np.zeros((len(x), CLASSES)), []
    for _ in range(ROUNDS):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        h = np.rint(p * (1 - p) * BO.SCALE)
        g = np.rint((p - np.eye(CLASSES)[y]) * BO.SCALE)
        trees = [plain_tree(x, g[:, c], h[:, c], cuts, DEPTH, np.arange(len(x))) for c in range(CLASSES)]
        scores += np.array([[plain_score(t, r) for t in trees] for r in x])
        rounds.append(trees)
    return scores, rounds


def nested(m, at):
    if m.feature[at] < 0:
        return m.value[at]
    return (m.feature[at], m.cut[at], nested(m, m.left[at]), nested(m, m.left[at] + 1))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return abs(a - b) < 1e-9
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])


def test_equals_a_plain_booster_split_by_split(spark, table, monkeypatch):
    x, y = table
    monkeypatch.setattr(BO, "PENDING", 4)  # scores are renewed within the fit
    df = frame(spark, x, y)
    m = BO.boost(df, "features", "label", CLASSES, ROUNDS, DEPTH, RATE, tasks=3)
    cuts = [np.unique(x[:, f])[:-1] for f in range(4)]
    scores, rounds = plain_boost(x, y, cuts)
    for r, trees in enumerate(rounds):
        for c, t in enumerate(trees):
            assert same(nested(m, m.roots[r, c]), t), (r, c)
    got = {r["id"]: r for r in m.staged(m.transform(df), [2, ROUNDS]).select(
        "id", "prediction", "scores", vector_to_array("probability").alias("p")).collect()}
    for i, s in enumerate(scores):
        assert np.allclose(got[i]["scores"][CLASSES:], s, atol=1e-9)
        e = np.exp(s - s.max())
        assert np.allclose(got[i]["p"], e / e.sum(), atol=1e-9)
        assert got[i]["prediction"] == s.argmax()
    two = BO.boost(df, "features", "label", CLASSES, 2, DEPTH, RATE, tasks=1)
    first = {r["id"]: r["scores"] for r in two.staged(df, [2]).collect()}
    assert all(np.allclose(first[i], got[i]["scores"][:CLASSES], atol=1e-12) for i in first)


def test_same_trees_whatever_the_partitioning(spark, table):
    x, y = table
    a = BO.boost(frame(spark, x, y, 1), "features", "label", CLASSES, 3, 4, RATE, tasks=1)
    b = BO.boost(frame(spark, x[::-1], y[::-1], 7), "features", "label", CLASSES, 3, 4, RATE, tasks=4)
    for i, j in zip(a._arrays(), b._arrays()):
        assert np.array_equal(i, j)


def test_edge_rows(spark, table):
    x, y = table
    odd = np.vstack([x, [[np.nan, 1, np.nan, 1]], [[3, 0, 0.1, 1]], [[3, 0, 0.1, 1]]])
    labels = [*y.tolist(), 2, None, 7]
    m = BO.boost(frame(spark, odd, labels), "features", "label", CLASSES, 2, 3, RATE, tasks=4)
    out = m.transform(frame(spark, odd, labels))
    assert out.count() == len(odd) and out.where(F.col("prediction").isNull()).count() == 0
    one = BO.boost(frame(spark, x[:5] * 0, [1] * 5), "features", "label", CLASSES, 2, 3, RATE)
    assert (one.feature == -1).all()
    assert {r["prediction"] for r in one.transform(frame(spark, x[:3], [0] * 3)).collect()} == {1.0}
    none = BO.boost(frame(spark, x, y).where("false"), "features", "label", CLASSES, 2, 3, RATE)
    assert {r["prediction"] for r in none.transform(frame(spark, x[:3], [0] * 3)).collect()} == {0.0}
    stump = BO.boost(frame(spark, x, y), "features", "label", CLASSES, 2, 0, RATE, tasks=2)
    assert (stump.feature == -1).all()
    with pytest.raises(ValueError):
        BO.boost(frame(spark, x, y), "features", "label", CLASSES, 1, 1, RATE, max_bins=300)


def test_a_round_goes_on_from_the_blocks_before_it(spark, table):
    """Scores and gradients after one more round equal those derived from all trees anew."""
    x, y = table
    layout = BO._Layout([np.unique(x[:, f])[:-1] for f in range(4)])
    cuts = [np.unique(x[:, f])[:-1] for f in range(4)]
    rows = frame(spark, x, y, 2).select(vector_to_array("features").alias("x"), F.col("label").alias("y"))
    binned = BO._binned(rows, cuts).checkpoint()
    done = []
    blocks = BO._scored_blocks(binned, layout, CLASSES, done)
    for _ in range(3):
        done.append(BO._grow_round(layout, lambda tree, nodes: BO._sums(blocks, layout, tree, nodes), CLASSES, 2, RATE, 1.0, 1.0))
        blocks = BO._next_blocks(blocks, done[-1])
    anew = BO._scored_blocks(binned, layout, CLASSES, done).collect()
    for a, b in zip(blocks.collect(), anew, strict=True):
        assert all(np.array_equal(i, j) for i, j in zip(a, b, strict=True))
