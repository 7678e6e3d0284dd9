"""Multinomial gradient boosting on histograms, all classes in one pass.

Features are cut into at most ``max_bins`` bins once (one aggregate of quantile
sketches) and written as one byte each, in blocks of rows. A round grows one
tree per class on the softmax loss, level by level: one narrow job sums
gradients and Hessians per (node, feature, bin) of all classes; the sums, whose
size depends on nodes and bins but not on rows, choose the splits. Of two
siblings only the lighter one is summed, the other is parent minus sibling.

* Features whose bins multiply to at most 256 share a byte, and sums are taken per
  byte: a row counts in a handful of cells instead of one per feature. What belongs to a
  single feature is added up from them once per task.
* The rows never move: blocks with their gradients are persisted and read block
  by block. Each round's first job derives them from the round before, walking the
  rows down the newest trees alone. Every ``PENDING`` rounds the blocks are written
  with their scores, so a lost executor costs some rounds and the lineage, which
  travels with every task, stays short. Blocks are per-partition
  numpy work on an RDD, as a DataFrame job per level would spend most of its time
  on planning.
* Gradients are rounded to multiples of 1 / ``SCALE`` and added as integers: the
  trees are the same whatever the partitioning and the order of rows.
* The driver holds the trees and one level's sums. Beyond ``FAN_IN`` partitions
  the sums are added on executors first.

Edge cases: rows whose label is null or not in 0 .. classes - 1 are not learnt
from; NaN and null features lie above every cut; a feature of one value is never
split; no rows or no splits leave trees of one leaf; equal gains go to the first
feature, then the lowest cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.session import checkpoint, remove

SCALE = 1 << 24  # gradients are multiples of 1 / SCALE
PENDING = 10  # rounds between two writings of the scored blocks
JOINT = 1 << 8  # values of one byte
FAN_IN = 64  # partitions whose sums the driver adds itself
CHUNK = 1 << 16  # rows summed at once
LEAST_GAIN = 1e-6


# ---------------------------------------------------------------- bins

def feature_cuts(rows: DataFrame, x: str, width: int, max_bins: int) -> list[np.ndarray]:
    """Inner cuts of each of the ``width`` elements of the array column ``x``:
    distinct approximate quantiles below the largest value, found in one
    aggregate. A value at or below a cut goes to its left."""
    if width == 0:
        return []
    probs = [i / max_bins for i in range(max_bins)]
    value = [F.nanvl(F.col(x)[i], F.lit(None).cast("double")) for i in range(width)]
    found = rows.agg(F.array(*[
        F.struct(F.percentile_approx(v, probs, 10_000).alias("q"), F.max(v).alias("top")) for v in value]).alias("cuts")).first()
    return [np.unique([q for q in f["q"] or [] if q < f["top"]]) for f in found["cuts"]]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column as a (rows, width) matrix, nulls as NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), width)


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(x array, y int) as blocks of rows: labels, and one byte per feature."""
    width = len(cuts)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            out = np.empty(x.shape, np.uint8)
            for i, c in enumerate(cuts):
                out[:, i] = np.searchsorted(c, x[:, i], side="left")
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([y.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["y", "bins"])

    return rows.mapInArrow(to_bins, "y binary, bins binary")


class _Layout:
    """Cells of a histogram: the bins of all features side by side. Rows hold ``columns``
    of joint values: features whose widths multiply to at most ``JOINT``, the widest first."""

    def __init__(self, cuts: list[np.ndarray]):
        widths = np.array([len(c) + 1 for c in cuts], np.int64)
        self.start = np.cumsum(widths) - widths
        self.size = int(widths.sum())
        self.feature = np.repeat(np.arange(len(cuts)), widths)
        self.first = self.start[self.feature]
        self.bin = np.arange(self.size) - self.first
        self.last = self.bin == widths[self.feature] - 1
        self.columns, self.values = [], []  # features and number of values of each column
        self.column, self.unit, self.widths = np.zeros(len(cuts), np.int64), np.ones(len(cuts), np.int64), widths
        for f in np.argsort(-widths, kind="stable").tolist():
            c = next((c for c, n in enumerate(self.values) if n * widths[f] <= JOINT), len(self.columns))
            if c == len(self.columns):
                self.columns.append([])
                self.values.append(1)
            self.columns[c].append(f)
            self.column[f], self.unit[f] = c, self.values[c]
            self.values[c] *= int(widths[f])

    def bins_of(self, f: int) -> np.ndarray:
        """The bin of feature ``f`` in each value of its column."""
        return np.arange(self.values[self.column[f]]) // self.unit[f] % self.widths[f]

    def joint(self, bins: np.ndarray) -> np.ndarray:
        """Bins (rows, features) as joint values (columns, rows)."""
        out = np.empty((len(self.columns), len(bins)), np.uint8)
        for c, features in enumerate(self.columns):
            out[c] = sum(bins[:, f].astype(np.int64) * self.unit[f] for f in features)
        return out

    def single(self, sums: list[np.ndarray]) -> np.ndarray:
        """Sums per joint value of each column (..., values), added up per feature and bin."""
        out = np.empty((*sums[0].shape[:-1], self.size))
        for c, features in enumerate(self.columns):
            for f in features:
                of_bin = (self.bins_of(f)[:, None] == np.arange(self.widths[f])).astype(np.float64)
                out[..., self.start[f]:self.start[f] + self.widths[f]] = sums[c] @ of_bin
        return out

    def steps(self, feature: np.ndarray, cut: np.ndarray, left: np.ndarray):
        """Per node its column, its left child (a leaf leads to itself) and which of the
        column's values go right."""
        inner = feature >= 0
        right = np.zeros((len(feature), JOINT), np.uint8)
        for v in np.flatnonzero(inner):
            goes = self.bins_of(feature[v]) > cut[v]
            right[v, :len(goes)] = goes
        return np.where(inner, self.column[feature], 0), np.where(inner, left, np.arange(len(feature))), right.ravel()


# ---------------------------------------------------------------- one round

def _histogram(layout: _Layout, codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, slot: np.ndarray, spans: list) -> list:
    """Per class of ``spans`` (its first and one past its last slot) and column, the gradient and
    Hessian sums (2, slots, values) of the rows whose slot is not negative. Sums of whole
    numbers below 2**53 are exact in doubles."""
    out = []
    for c, (first, end) in enumerate(spans):
        if first == end:
            out.append(None)
            continue
        use = np.flatnonzero(slot[c] >= 0)
        at = slot[c].take(use) - first
        weights = [w[c].take(use).astype(np.float64) for w in (grad, hess)]
        cells = []
        for values, code in zip(layout.values, codes):
            cell = at * values
            cell += code.take(use)
            found = np.zeros((2, end - first, values))  # doubles also where no row counts
            for j, w in enumerate(weights):
                found[j] += np.bincount(cell, w, (end - first) * values).reshape(end - first, values)
            cells.append(found)
        out.append(cells)
    return out


def _best_splits(layout: _Layout, hist: np.ndarray, l2: float, min_child: float):
    """Per node: gain and cell of its best split, sums left of it and of all."""
    cum = hist.cumsum(axis=1)
    before = np.concatenate([np.zeros_like(cum[:, :1]), cum], axis=1)[:, layout.first]
    left = cum - before
    total = hist[:, layout.feature == 0].sum(axis=1)
    right = total[:, None] - left

    def worth(s):
        return (s[..., 0] / SCALE) ** 2 / (s[..., 1] / SCALE + l2)

    gain = worth(left) + worth(right) - worth(total)[:, None]
    bad = layout.last | (left[..., 1] < min_child * SCALE) | (right[..., 1] < min_child * SCALE)
    gain = np.where(bad, -np.inf, gain)
    at = gain.argmax(axis=1)
    row = np.arange(len(hist))
    return gain[row, at], at, left[row, at], total


def _walk(codes: np.ndarray, steps, root: int, levels: int) -> np.ndarray:
    """The node in which each row ends, at most ``levels`` below ``root``."""
    column, left, right = steps
    flat, n = codes.ravel(), codes.shape[1]
    rows = np.arange(n)
    node = np.full(n, root)
    for _ in range(levels):
        at = column.take(node)
        at *= n
        at += rows
        side = node * JOINT
        side += flat.take(at)
        node = left.take(node)
        node += right.take(side)
    return node


def _levels(feature: np.ndarray, left: np.ndarray, classes: int) -> tuple[int, np.ndarray]:
    """Depth of the deepest tree, and the class of each node."""
    depth, owner = np.zeros(len(feature), np.int64), np.arange(len(feature))
    owner[classes:] = 0
    for v in np.flatnonzero(feature >= 0):  # a child stands behind its parent
        depth[left[v]:left[v] + 2] = depth[v] + 1
        owner[left[v]:left[v] + 2] = owner[v]
    return int(depth.max(initial=0)), owner


def _raise_scores(layout: _Layout, codes: np.ndarray, scores: np.ndarray, rounds: list) -> None:
    """Adds the leaf values of ``rounds``, in order."""
    for feature, cut, left, value in rounds:
        steps = layout.steps(feature, cut, left)
        depth, _ = _levels(feature, left, len(scores))
        for c in range(len(scores)):
            scores[c] += value.take(_walk(codes, steps, c, depth))


def _gradients(y: np.ndarray, scores: np.ndarray):
    p = np.exp(scores - scores.max(axis=0))
    p /= p.sum(axis=0)
    hess = np.rint(p * (1 - p) * SCALE).astype(np.int32)
    p[y, np.arange(len(y))] -= 1
    return np.rint(p * SCALE).astype(np.int32), hess


def _grow_round(layout: _Layout, sums_of, classes: int, depth: int, rate: float, l2: float, min_child: float):
    """One tree per class. ``sums_of(tree, nodes)`` gives the histograms of
    ``nodes`` of the unfinished ``tree`` over all rows. Nodes 0 .. classes - 1
    are the roots, a right child follows its left one. Returns feature, bin,
    left, value."""
    feature, cut, left = [-1] * classes, [0] * classes, [-1] * classes

    def tree():
        return np.array(feature), np.array(cut), np.array(left)

    open_nodes = list(range(classes))
    hist = sums_of(tree(), open_nodes)
    sums = list(hist[:, layout.feature == 0].sum(axis=1))
    for level in range(depth):
        gain, at, less, total = _best_splits(layout, hist, l2, min_child)
        parents, small = [], []
        for i, v in enumerate(open_nodes):
            if gain[i] > LEAST_GAIN:
                feature[v], cut[v], left[v] = int(layout.feature[at[i]]), int(layout.bin[at[i]]), len(feature)
                feature += [-1, -1]
                cut += [0, 0]
                left += [-1, -1]
                sums += [less[i], total[i] - less[i]]
                parents.append(i)
                small.append(left[v] + int(2 * less[i][1] > total[i][1]))
        if not parents or level + 1 == depth:
            break
        children = [left[open_nodes[i]] + side for i in parents for side in (0, 1)]
        light = sums_of(tree(), small)
        heavy = hist[parents] - light
        hist = np.empty((len(children), layout.size, 2), np.int64)
        side = np.array(small) - np.array(children[::2])
        pair = 2 * np.arange(len(small))
        hist[pair + side] = light
        hist[pair + 1 - side] = heavy
        open_nodes = children
    s = np.array(sums, np.float64) / SCALE
    value = np.where(np.array(feature) < 0, -rate * s[:, 0] / (s[:, 1] + l2), 0.0)
    return *tree(), value


# ---------------------------------------------------------------- fit

def _scored_blocks(binned: DataFrame, layout: _Layout, classes: int, done: list):
    """Persisted blocks (y, joint values, scores after the rounds ``done``, their
    gradients and Hessians) of up to ``CHUNK`` rows."""
    width = len(layout.start)
    given = binned.sparkSession.sparkContext.broadcast((layout, list(done)))

    def block(parts):
        layout, done = given.value
        y = np.concatenate([p[0] for p in parts])
        codes = np.concatenate([p[1] for p in parts], axis=1)
        scores = np.zeros((classes, len(y)))
        _raise_scores(layout, codes, scores, done)
        return y, codes, scores, *_gradients(y, scores)

    def blocks(rows):
        layout, parts, n = given.value[0], [], 0
        for row in rows:
            y = np.frombuffer(row.y, np.int32)
            if parts and n + len(y) > CHUNK:
                yield block(parts)
                parts, n = [], 0
            parts.append((y, layout.joint(np.frombuffer(row.bins, np.uint8).reshape(len(y), width))))
            n += len(y)
        if parts:
            yield block(parts)

    return _kept(binned.rdd.mapPartitions(blocks), layout)


def _kept(blocks, layout: _Layout):
    blocks.layout = layout
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _next_blocks(blocks, newest):
    """The persisted blocks after one more round."""
    layout = blocks.layout

    def block(kept):
        y, codes, scores = kept[:3]
        scores = scores.copy()
        _raise_scores(layout, codes, scores, [newest])
        return y, codes, scores, *_gradients(y, scores)

    return _kept(blocks.map(block), layout)


def _sums(blocks, layout: _Layout, tree, nodes: list[int]) -> np.ndarray:
    """Histograms of ``nodes`` over all blocks, one narrow job."""
    slots = len(nodes)
    slot_of = np.full(len(tree[0]), -1)
    slot_of[nodes] = np.arange(slots)

    def part(rows):
        total, spans = None, None
        for _, codes, scores, grad, hess in rows:
            if spans is None:
                steps = layout.steps(*tree)
                depth, owner = _levels(tree[0], tree[2], len(scores))
                mine = owner[nodes]  # the nodes of a class stand together
                spans = [(int((mine < c).sum()), int((mine <= c).sum())) for c in range(len(scores))]
            slot = [slot_of.take(_walk(codes, steps, c, depth)) for c in range(len(scores))]
            sums = _histogram(layout, codes, grad, hess, slot, spans)
            if total is None:
                total = sums
            else:
                for have, more in zip(total, sums):
                    for a, b in zip(have or [], more or []):
                        a += b
        out = np.zeros((slots, layout.size, 2), np.int64)
        for (first, end), cells in zip(spans or [], total or []):
            if cells is not None:
                out[first:end] = np.moveaxis(layout.single(cells), 0, -1)
        yield out

    parts = blocks.mapPartitions(part)
    return parts.treeReduce(np.add) if blocks.getNumPartitions() > FAN_IN else sum(parts.collect())


def boost(rows: DataFrame, features: str, label: str, classes: int, rounds: int, depth: int, rate: float, l2: float = 1.0,
          min_child: float = 1.0, max_bins: int = 64, tasks: int | None = None) -> "BoostedTreesModel":
    """Fits ``rounds`` trees per class to the vector column ``features``."""
    if not 2 <= max_bins <= 256:
        raise ValueError("max_bins must lie in 2 .. 256: a bin is one byte")
    if l2 <= 0:
        raise ValueError("l2 must be positive")
    x = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y")).where(
        F.col("y").between(0, classes - 1))
    head = x.select(F.size("x")).first()
    width = head[0] if head else 0
    if width == 0:  # nothing to learn from: one leaf per class
        leaf = (np.full(classes, -1), np.zeros(classes, int), np.full(classes, -1), np.zeros(classes))
        return BoostedTreesModel(features, classes, [], [leaf] * rounds)
    cuts = feature_cuts(x, "x", width, max_bins)
    layout = _Layout(cuts)
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    binned = checkpoint(_binned(x.repartition(tasks), cuts))
    done: list = []
    blocks, written = None, None
    for r in range(rounds):
        old = blocks
        blocks = _scored_blocks(binned, layout, classes, done) if old is None else _next_blocks(old, done[-1])
        renewed = r > 0 and r % PENDING == 0
        if renewed:
            blocks.checkpoint()  # by the round's first job

        def sums_of(tree, nodes):
            return _sums(blocks, layout, tree, nodes)

        done.append(_grow_round(layout, sums_of, classes, depth, rate, l2, min_child))
        if old is not None:  # the round's first job has read them
            old.unpersist()
        if renewed:
            if written:  # nothing reads the older blocks any more
                remove(rows.sparkSession, written)
            written = blocks.getCheckpointFile()
    if blocks is not None:
        blocks.unpersist()
    if written:
        remove(rows.sparkSession, written)
    return BoostedTreesModel(features, classes, cuts, done)


class BoostedTrees(Estimator):
    """``boost`` as a pipeline stage; the classes are those of the labels."""

    def __init__(self, trees: int, depth: int, learn_rate: float, features: str = "features", label: str = "label",
                 classes: int | None = None, **settings):
        super().__init__()
        self.trees, self.depth, self.learn_rate = trees, depth, learn_rate
        self.features, self.label, self.classes, self.settings = features, label, classes, settings

    def _fit(self, dataset: DataFrame) -> "BoostedTreesModel":
        classes = self.classes
        if classes is None:
            classes = int((dataset.agg(F.max(self.label)).first()[0] or 0)) + 1
        return boost(dataset, self.features, self.label, classes, self.trees, self.depth, self.learn_rate, **self.settings)


class BoostedTreesModel(Model):
    """Trees as flat arrays over all rounds: feature (-1: leaf), cut value, left
    child (the right one follows), leaf value; ``roots`` is (rounds, classes)."""

    def __init__(self, features: str, classes: int, cuts: list[np.ndarray], rounds: list):
        super().__init__()
        self.features, self.classes, self.rounds = features, classes, len(rounds)
        offsets = np.cumsum([0] + [len(r[0]) for r in rounds])
        self.roots = offsets[:-1, None] + np.arange(classes)

        def joined(i, shift=False):
            parts = [np.where(r[0] >= 0, r[i] + o, -1) if shift else r[i] for r, o in zip(rounds, offsets)]
            return np.concatenate(parts) if parts else np.zeros(0)

        self.feature = joined(0).astype(np.int32)
        bins = joined(1).astype(np.int64)
        self.left = joined(2, shift=True).astype(np.int32)
        self.value = joined(3)
        self.cut = np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(self.feature, bins)], np.float64)

    def _arrays(self):
        return self.roots, self.feature, self.cut, self.left, self.value

    def staged(self, df: DataFrame, stages: Sequence[int], out: str = "scores") -> DataFrame:
        """Adds ``out``: per entry of ``stages`` the class scores after that many
        rounds, one after the other, so one fit serves every smaller one."""
        return df.withColumn(out, _scores(df, self._arrays(), self.features, list(stages)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw = "_raw"
        df = self.staged(dataset, [self.rounds], raw)
        top = F.array_max(raw)
        e = F.transform(raw, lambda v: F.exp(v - top))
        total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
        return df.withColumns({
            "rawPrediction": array_to_vector(F.col(raw)),
            "probability": array_to_vector(F.transform(e, lambda v: v / total)),
            "prediction": (F.array_position(raw, top) - 1).cast("double"),
        }).drop(raw)


def score_matrix(arrays, x: np.ndarray, stages: Sequence[int]) -> np.ndarray:
    """Scores (rows, stages x classes) after each number of rounds."""
    roots, feature, cut, left, value = arrays
    rounds, classes = roots.shape
    out = np.zeros((len(x), len(stages), classes))
    if not rounds or not len(x):
        return out.reshape(len(x), -1)
    block = max(1, (1 << 20) // (len(x) * classes))
    row = np.arange(len(x))[:, None]
    for lo in range(0, rounds, block):
        node = np.repeat(roots[lo:lo + block].reshape(1, -1), len(x), axis=0)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = ~(x[row, np.where(inner, f, 0)] <= cut[node])
            node = np.where(inner, left[node] + right, node)
        leaf = value[node].reshape(len(x), -1, classes)
        for i, stage in enumerate(stages):
            out[:, i] += leaf[:, :max(0, stage - lo)].sum(axis=1)
    return out.reshape(len(x), -1)


def _scores(df: DataFrame, arrays, features: str, stages: list[int]):
    shared = df.sparkSession.sparkContext.broadcast(arrays)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            parts = []
            for lo in range(0, len(xs), 1024):
                x = np.array([np.asarray(r, np.float64) for r in xs.iloc[lo:lo + 1024]])
                parts += list(score_matrix(shared.value, x, stages))
            yield pd.Series(parts, dtype=object)

    return run(vector_to_array(features))
