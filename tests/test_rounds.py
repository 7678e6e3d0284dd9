"""What boosting rounds keep, write and walk."""

import os

import numpy as np
from pyspark.ml.functions import array_to_vector

from sitewise.operators import boosting as BO
from sitewise.operators import model as MO

LV = ["a", "b", "c"]


def test_joint_bytes_give_each_features_sums():
    rng = np.random.default_rng(4)
    widths = [64, 60, 25, 7, 4, 1, 256, *[2] * 18]
    layout = BO._Layout([np.arange(w - 1) + 0.5 for w in widths])
    assert len(layout.columns) < len(widths) / 2 and max(layout.values) <= 256
    bins = np.column_stack([rng.integers(0, w, 500) for w in widths]).astype(np.uint8)
    grad, hess = rng.integers(-9, 9, (2, 500)), rng.integers(0, 9, (2, 500))
    slot = np.array([rng.integers(-1, 2, 500), np.where(rng.random(500) < 0.5, 2, -1)])
    spans = [(0, 2), (2, 3)]
    found = BO._histogram(layout, layout.joint(bins), grad, hess, slot, spans)
    got = np.concatenate([np.moveaxis(layout.single(cells), 0, -1) for cells in found])
    want = np.zeros((3, layout.size, 2))
    for c in range(2):
        for i in np.flatnonzero(slot[c] >= 0):
            for f, b in enumerate(bins[i]):
                want[slot[c, i], layout.start[f] + b] += grad[c, i], hess[c, i]
    assert np.array_equal(got, want)
    none = BO._histogram(layout, layout.joint(bins), grad, hess, np.full((2, 500), -1), spans)
    assert all(cells.dtype == np.float64 and not cells.any() for part in none for cells in part)


def test_renewed_blocks_are_written_not_walked_anew(spark, monkeypatch):
    """All trees so far were walked down by every row each PENDING rounds; superseded blocks go."""
    rng = np.random.default_rng(6)
    rows = [([float(v) for v in rng.normal(size=3)], int(rng.integers(0, 3))) for _ in range(200)]
    df = spark.createDataFrame(rows, "x array<double>, label int").repartition(3).select(array_to_vector("x").alias("features"), "label")
    once = BO.boost(df, "features", "label", 3, 7, 2, 0.3, tasks=2)
    calls = []
    scored = BO._scored_blocks
    monkeypatch.setattr(BO, "_scored_blocks", lambda *a: calls.append(1) or scored(*a))
    monkeypatch.setattr(BO, "PENDING", 2)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    often = BO.boost(df, "features", "label", 3, 7, 2, 0.3, tasks=2)
    assert len(calls) == 1
    assert len(set(os.listdir(folder)) - before) <= 1  # the binned rows
    for a, b in zip(once._arrays(), often._arrays()):
        assert np.array_equal(a, b)


def test_adaboost_rounds_hold_no_rows_in_memory(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, LV[i % 3], 5.0 * (i % 3) + float(rng.normal()), ["u", "v"][i % 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y string, x1 double, cat string")
    levels, kind = [], type(df)
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, level: levels.append(level) or persist(self, level))
    out = MO.adaboost_samme(MO.feature_recipe(["x1"], ["cat"], "y", LV), df, df, "id", "y", LV, rounds=3, depth=2)
    assert out.count() == 90
    assert len(levels) == 3 and not any(level.useMemory for level in levels)
