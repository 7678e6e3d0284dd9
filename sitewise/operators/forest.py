"""Random forest of many deep trees on histograms.

Bagged classification trees: every tree draws its rows (Poisson weights), every
node ``mtry`` features, and takes the cut of the largest Gini gain that leaves
``min_n`` rows on both sides. Splits whose two leaves name the same class are
taken back, as Spark ML does. Probabilities are the mean of the leaves' shares.

* While a node has more than ``LOCAL`` rows, its class counts per (feature, bin)
  are summed over all blocks, one job per level for all trees of a wave. The
  rows of a smaller node are dealt to one task, which grows everything below:
  counting deep levels over all blocks would shuffle a histogram per node and
  block for nodes of a few rows.
* Trees are grown in waves of about ``WAVE`` dealt rows, so a shuffle has a bounded size.
* Subtrees stay on the executors (``release`` frees them). Rows to be scored are dealt to them by tree and
  node; the driver holds only the nodes above ``LOCAL`` rows.
* Rows travel as packed bytes (one per wide feature, one bit per two-valued one).

Edge cases: rows whose label is null or not in 0 .. classes - 1 are not learnt
from; no row left is an error, as in Spark ML; NaN lies above every cut; a tree
that drew no row has no vote; equal gains go to the feature drawn first, then the
lowest cut. A split above ``LOCAL`` rows is never taken back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators.boosting import FAN_IN, _matrix, feature_cuts
from sitewise.session import checkpoint

LOCAL = 1 << 17  # rows of a node that one task grows further
WAVE = 1 << 27  # rows of all trees that are dealt at once
SLICE = 1 << 14  # rows counted at once
HELD = 1 << 23  # scores a task holds before it hands them on
LEAST_GAIN = 1e-12


# ---------------------------------------------------------------- rows

class _Layout:
    """Bins per feature; two-valued features travel as bits."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.widths = np.array([len(c) + 1 for c in cuts], np.int64)
        self.bits, self.bytes = np.flatnonzero(self.widths <= 2), np.flatnonzero(self.widths > 2)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for i, c in enumerate(self.cuts):
            out[:, i] = np.searchsorted(c, x[:, i], side="left")
        return out

    def pack(self, bins: np.ndarray) -> np.ndarray:
        return np.concatenate([bins[:, self.bytes], np.packbits(bins[:, self.bits], axis=1)], axis=1)

    def unpack(self, data: bytes, rows: int) -> np.ndarray:
        packed = np.frombuffer(data, np.uint8).reshape(rows, -1)
        out = np.empty((rows, len(self.cuts)), np.uint8)
        out[:, self.bytes] = packed[:, :len(self.bytes)]
        out[:, self.bits] = np.unpackbits(packed[:, len(self.bytes):], axis=1, count=len(self.bits))
        return out


def _blocks(rows: DataFrame, layout: _Layout, mark: str) -> DataFrame:
    """Blocks of rows (block, n, mark, packed bins), written; ``rows`` has the array x
    and the long column ``mark``."""
    width = len(layout.cuts)

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
            packed = layout.pack(layout.bins(_matrix(batch.column("x"), width)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows]), pa.array([m.tobytes()], pa.binary()), pa.array([packed.tobytes()], pa.binary())],
                ["n", "mark", "bins"])

    out = rows.select("x", F.col(mark).alias("mark")).mapInArrow(to_blocks, "n long, mark binary, bins binary")
    return checkpoint(out.withColumn("block", F.monotonically_increasing_id()))


def _bag(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often ``tree`` drew each row of the block."""
    return np.random.default_rng([seed, tree, block]).poisson(1.0, n).astype(np.uint8)


# ---------------------------------------------------------------- nodes

def _draw(rng: np.random.Generator, nodes: int, width: int, mtry: int) -> np.ndarray:
    return np.argsort(rng.random((nodes, width)), axis=1)[:, :mtry]


def _cells(layout: _Layout, feats: np.ndarray):
    """First cell of each (node, drawn feature), and the number of cells."""
    widths = layout.widths[feats].ravel()
    end = widths.cumsum()
    return (end - widths).reshape(feats.shape), int(end[-1])


def _count(bins, y, w, slot, feats, start, size: int, classes: int) -> np.ndarray:
    """Rows per (class, cell) of the nodes ``slot``, counted as often as drawn."""
    out = np.zeros((classes, size))
    ends = np.append(start[1:, 0], size)
    for lo in range(0, len(slot), SLICE):
        part = slice(lo, lo + SLICE)
        s = slot[part]
        first, last = start[s.min(), 0], ends[s.max()]
        span = int(last - first)
        at = feats[s]
        at += (np.arange(len(s)) * bins.shape[1])[:, None]
        at = bins[part].ravel().take(at) + start[s]
        at += (y[part] * span - first)[:, None]
        out[:, first:last] += np.bincount(at.ravel(), np.repeat(w[part], feats.shape[1]), span * classes).reshape(classes, span)
    return out


def _best(layout: _Layout, hist, feats, start, min_n: int):
    """Per node: Gini gain, feature and bin of its best cut, class counts left of it and of all."""
    mtry = feats.shape[1]
    first, widths = start.ravel(), layout.widths[feats].ravel()
    pair = np.repeat(np.arange(len(first)), widths)
    node = np.repeat(np.arange(len(feats)), np.add.reduceat(widths, np.arange(0, len(widths), mtry)))
    left = hist.cumsum(axis=1)
    left -= np.concatenate([np.zeros((len(hist), 1)), left], axis=1)[:, first][:, pair]
    total = left[:, first[::mtry] + widths[::mtry] - 1]
    right = total[:, node]
    right -= left
    n_left, n_right, n = left.sum(axis=0), right.sum(axis=0), total.sum(axis=0)
    gain = (left * left).sum(axis=0) / np.maximum(n_left, 1) + (right * right).sum(axis=0) / np.maximum(n_right, 1)
    gain -= ((total * total).sum(axis=0) / n)[node]
    gain[(n_left < min_n) | (n_right < min_n)] = -np.inf
    top = np.maximum.reduceat(gain, first[::mtry])
    hit = np.flatnonzero(gain == top[node])
    at = hit[np.unique(node[hit], return_index=True)[1]]
    return top / n, feats.ravel()[pair[at]], at - first[pair[at]], left[:, at].T, total.T


def _grow(layout: _Layout, bins, y, w, classes: int, mtry: int, min_n: int, levels: int, rng: np.random.Generator):
    """The tree over the given rows, level by level: feature (-1: leaf), bin, left child
    (its place in the next level; the right one follows) and class counts of each node."""
    width = len(layout.cuts)
    counts = [np.bincount(y, w, classes)[None]]
    feature, cut, left = [], [], []  # per level
    sizes = np.array([len(y)])
    for level in range(levels + 1):
        total = counts[level]
        f, c, child = (np.full(len(total), v, np.int64) for v in (-1, 0, -1))
        feature, cut, left = feature + [f], cut + [c], left + [child]
        n = total.sum(axis=1)
        ask = (n >= 2 * min_n) & (total.max(axis=1) < n) & (level < levels)
        nodes = np.flatnonzero(ask)
        if not len(nodes):
            break
        use = np.repeat(ask, sizes)
        bins, y, w = bins[use], y[use], w[use]
        sizes = sizes[nodes]
        ends = sizes.cumsum()
        feats = _draw(rng, len(nodes), width, mtry)
        less = np.empty((len(nodes), classes))
        # nodes side by side until they have SLICE rows: their counts stay small
        bounds = [0, *(np.flatnonzero(np.diff((ends - sizes) // SLICE)) + 1), len(nodes)]
        for lo, hi in zip(bounds, bounds[1:]):
            part = slice(ends[lo] - sizes[lo], ends[hi - 1])
            start, size = _cells(layout, feats[lo:hi])
            slot = np.repeat(np.arange(hi - lo), sizes[lo:hi])
            hist = _count(bins[part], y[part], w[part], slot, feats[lo:hi], start, size, classes)
            gain, bf, bc, less[lo:hi], _ = _best(layout, hist, feats[lo:hi], start, min_n)
            won = gain > LEAST_GAIN
            f[nodes[lo:hi][won]], c[nodes[lo:hi][won]] = bf[won], bc[won]
        split = f[nodes] >= 0
        if not split.any():
            break
        parents = nodes[split]
        child[parents] = 2 * np.arange(len(parents))
        slot = np.repeat(np.where(split, split.cumsum() - 1, -1), sizes)
        use = np.flatnonzero(slot >= 0)
        slot = slot[use]
        side = 2 * slot + (bins[use, f[parents][slot]] > c[parents][slot])
        order = np.argsort(side, kind="stable")
        use = use[order]
        bins, y, w = bins[use], y[use], w[use]
        sizes = np.bincount(side, minlength=2 * len(parents))
        both = np.empty((2 * len(parents), classes))
        both[::2] = less[split]
        both[1::2] = total[parents] - less[split]
        counts.append(both)
    return feature, cut, left, counts


def _pruned(feature: list, cut: list, left: list, counts: list):
    """Levels as one tree (feature, bin, left, counts of its leaves): a split whose
    two leaves name the same class becomes a leaf. ``left`` counts within the next level."""
    for level in range(len(feature) - 2, -1, -1):
        inner = np.flatnonzero(feature[level] >= 0)
        a = left[level][inner]
        name = counts[level + 1].argmax(axis=1)
        same = (feature[level + 1][a] < 0) & (feature[level + 1][a + 1] < 0) & (name[a] == name[a + 1])
        feature[level][inner[same]] = -1
    keep = np.zeros(1, np.int64)
    out, known = [], 0
    for level in range(len(feature)):
        f = feature[level][keep]
        known += len(keep)
        inner = f >= 0
        child = np.full(len(f), -1, np.int64)
        child[inner] = known + 2 * np.arange(inner.sum())
        out.append((f, cut[level][keep], child, counts[level][keep][~inner]))
        keep = (left[level][keep][inner][:, None] + np.arange(2)).ravel()
        if not len(keep):
            break
    f, c, child, leaves = (np.concatenate(part) for part in zip(*out))
    child[f < 0] = np.arange(len(leaves))
    return f.astype(np.int16), c.astype(np.uint8), child.astype(np.int32), leaves.astype(np.int32)


def _walk(bins: np.ndarray, feature, cut, left) -> np.ndarray:
    """The node in which each row ends."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows):
        at = node[rows]
        inner = feature[at] >= 0
        rows, at = rows[inner], at[inner]
        node[rows] = left[at] + (bins[rows, feature[at]] > cut[at])
    return node


class _Top:
    """The nodes of a tree above ``LOCAL`` rows, and their children."""

    def __init__(self, rows: int):
        self.feature, self.cut, self.left, self.level, self.rows, self.leaf = [-1], [0], [-1], [0], [rows], [False]

    def arrays(self):
        return np.array(self.feature), np.array(self.cut), np.array(self.left)

    def open(self, levels: int) -> list[int]:
        return [v for v, f in enumerate(self.feature)
                if f < 0 and not self.leaf[v] and self.rows[v] > LOCAL and self.level[v] < levels]

    def split(self, v: int, feature: int, cut: int, less: int, all_rows: int) -> None:
        self.feature[v], self.cut[v], self.left[v] = feature, cut, len(self.feature)
        for n in (less, all_rows - less):
            for values, new in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.level, self.level[v] + 1),
                                (self.rows, n), (self.leaf, False)):
                values.append(new)


# ---------------------------------------------------------------- fit

def _marked(row, layout: _Layout):
    return np.frombuffer(row.mark, np.int64), layout.unpack(row.bins, row.n)


def _grow_tops(blocks, layout: _Layout, trees: range, rows: int, classes: int, mtry: int, min_n: int, levels: int, seed: int):
    """The trees down to nodes of ``LOCAL`` rows, a job per level."""
    tops = {t: _Top(rows) for t in trees}
    while True:
        asked = [(t, v) for t in trees for v in tops[t].open(levels)]
        if not asked:
            return tops
        feats = np.concatenate([_draw(np.random.default_rng([seed, t, v, 1]), 1, len(layout.cuts), mtry) for t, v in asked])
        start, size = _cells(layout, feats)
        plan = {}
        for i, (t, v) in enumerate(asked):
            plan.setdefault(t, (tops[t].arrays(), np.full(len(tops[t].feature), -1)))[1][v] = i
        given = blocks.context.broadcast((plan, feats, start))

        def part(some):
            plan, feats, start = given.value
            out = np.zeros((classes, size))
            for row in some:
                y, bins = _marked(row, layout)
                for t, (arrays, slots) in plan.items():
                    w = _bag(seed, t, row.block, row.n)
                    slot = np.where(w > 0, slots[_walk(bins, *arrays)], -1)
                    use = np.flatnonzero(slot >= 0)
                    if len(use):
                        mine = slots[slots >= 0]
                        lo, hi = mine.min(), mine.max() + 1
                        first = start[lo, 0]
                        last = start[hi, 0] if hi < len(start) else size
                        out[:, first:last] += _count(bins[use], y[use], w[use], slot[use] - lo, feats[lo:hi], start[lo:hi] - first,
                                                     int(last - first), classes)
            yield out

        parts = blocks.mapPartitions(part)
        hist = parts.treeReduce(np.add) if blocks.getNumPartitions() > FAN_IN else sum(parts.collect())
        gain, feature, cut, less, total = _best(layout, hist, feats, start, min_n)
        for i, (t, v) in enumerate(asked):
            if gain[i] > LEAST_GAIN:
                tops[t].split(v, int(feature[i]), int(cut[i]), int(less[i].sum()), int(total[i].sum()))
            else:
                tops[t].leaf[v] = True


def _dealt(bins: np.ndarray, top, use: np.ndarray):
    """Rows ``use`` by the node of ``top`` they end in: (node, rows)."""
    node = _walk(bins[use], *top)
    order = np.argsort(node, kind="stable")
    nodes, first = np.unique(node[order], return_index=True)
    return zip(nodes.tolist(), np.split(use[order], first[1:]))


def _place(key) -> int:
    return key[0] * 1_000_003 + key[1]


def _subtrees(blocks, layout: _Layout, tops: dict, classes: int, mtry: int, min_n: int, levels: int, seed: int, tasks: int):
    """((tree, node), subtree) of every undivided node of ``tops``, persisted."""
    given = blocks.context.broadcast({t: (top.arrays(), top.level, top.leaf) for t, top in tops.items()})

    def deal(some):
        for row in some:
            y, bins = _marked(row, layout)
            packed, y = layout.pack(bins), y.astype(np.uint16)
            for t, (top, _, _) in given.value.items():
                w = _bag(seed, t, row.block, row.n)
                for v, rows in _dealt(bins, top, np.flatnonzero(w)):
                    yield (t, v), (len(rows), packed[rows].tobytes(), y[rows].tobytes(), w[rows].tobytes())

    def grown(key, parts):
        n = sum(p[0] for p in parts)
        bins = layout.unpack(b"".join(p[1] for p in parts), n)
        y = np.frombuffer(b"".join(p[2] for p in parts), np.uint16).astype(np.int64)
        w = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        _, level, leaf = given.value[key[0]]
        below = 0 if leaf[key[1]] else levels - level[key[1]]
        rng = np.random.default_rng([seed, *key])
        return key, _pruned(*_grow(layout, bins, y, w, classes, mtry, min_n, below, rng))

    def grow(pairs):
        at, parts = None, []
        for key, value in pairs:
            if key != at and parts:
                yield grown(at, parts)
                parts = []
            at = key
            parts.append(value)
        if parts:
            yield grown(at, parts)

    dealt = blocks.mapPartitions(deal).repartitionAndSortWithinPartitions(tasks, _place)
    return dealt.mapPartitions(grow).persist(StorageLevel.MEMORY_AND_DISK)


class DeepForest(Estimator):
    """``trees`` bagged trees; the classes are those of the labels."""

    def __init__(self, trees: int, mtry: int | None = None, min_n: int = 1, levels: int = 30, max_bins: int = 64, seed: int = 123,
                 features: str = "features", label: str = "label"):
        super().__init__()
        if not 2 <= max_bins <= 256:
            raise ValueError("max_bins must lie in 2 .. 256: a bin is one byte")
        if trees < 1 or min_n < 1 or (mtry is not None and mtry < 1):
            raise ValueError("trees, mtry and min_n must be positive")
        self.trees, self.mtry, self.min_n, self.levels = trees, mtry, min_n, levels
        self.max_bins, self.seed, self.features, self.label = max_bins, seed, features, label

    def _fit(self, dataset: DataFrame) -> "DeepForestModel":
        x = dataset.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("long").alias("y")).where("y >= 0")
        head = x.agg(F.max(F.size("x")).alias("width"), F.max("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
        if not head["n"] or not head["width"]:
            raise ValueError("a forest needs labelled rows with features")
        width, classes, n = head["width"], head["y"] + 1, head["n"]
        if classes > 1 << 16:
            raise ValueError("more than 65536 classes")
        mtry = min(self.mtry or int(np.ceil(np.sqrt(width))), width)
        layout = _Layout(feature_cuts(x, "x", width, self.max_bins))
        tasks = dataset.sparkSession.sparkContext.defaultParallelism
        blocks = _blocks(x.repartition(tasks), layout, "y").rdd
        wave, waves = max(1, WAVE // n), []
        for lo in range(0, self.trees, wave):
            trees = range(lo, min(lo + wave, self.trees))
            tops = _grow_tops(blocks, layout, trees, n, classes, mtry, self.min_n, self.levels, self.seed)
            grown = _subtrees(blocks, layout, tops, classes, mtry, self.min_n, self.levels, self.seed, 4 * tasks)
            grown.count()
            waves.append(({t: top.arrays() for t, top in tops.items()}, grown))
        return DeepForestModel(self.features, classes, layout, waves)


class DeepForestModel(Model):
    """Per wave of trees: their upper nodes, and the persisted subtrees."""

    def __init__(self, features: str, classes: int, layout: _Layout, waves: list):
        super().__init__()
        self.features, self.classes, self.layout, self.waves = features, classes, layout, waves

    def release(self) -> None:
        """Frees the subtrees; a later use grows them anew. Scored rows are written and stay."""
        for _, grown in self.waves:
            grown.unpersist()

    def _votes(self, blocks, tops: dict, grown):
        """(block, shares summed over the trees of a wave), in parts."""
        layout, classes = self.layout, self.classes
        tasks = grown.getNumPartitions()
        given = blocks.context.broadcast(tops)

        def deal(some):
            for row in some:
                _, bins = _marked(row, layout)
                packed = layout.pack(bins)
                for t, top in given.value.items():
                    for v, rows in _dealt(bins, top, np.arange(row.n)):
                        yield (t, v, 1), (row.block, row.n, rows.astype(np.int32).tobytes(), packed[rows].tobytes())

        def score(pairs):
            at, sums, held = None, {}, 0
            for key, value in pairs:
                if key[2] == 0:
                    at, (feature, cut, left, leaves) = key[:2], value
                    shares = leaves / leaves.sum(axis=1, keepdims=True)
                elif key[:2] == at:  # a tree that drew no row has no subtree
                    block, n, rows, packed = value
                    if block not in sums:
                        if held + n * classes > HELD:
                            yield from sums.items()
                            sums, held = {}, 0
                        sums[block] = np.zeros((n, classes))
                        held += n * classes
                    rows = np.frombuffer(rows, np.int32)
                    sums[block][rows] += shares[left[_walk(layout.unpack(packed, len(rows)), feature, cut, left)]]
            yield from sums.items()

        both = grown.map(lambda g: ((*g[0], 0), g[1])).union(blocks.mapPartitions(deal))
        return both.repartitionAndSortWithinPartitions(tasks, _place).mapPartitions(score)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        df = checkpoint(dataset.withColumn("_at", F.monotonically_increasing_id()))
        tasks = spark.sparkContext.defaultParallelism
        blocks = _blocks(df.select(vector_to_array(self.features).alias("x"), "_at").repartition(tasks), self.layout, "_at")
        votes = spark.sparkContext.union([self._votes(blocks.rdd, *wave) for wave in self.waves])
        votes = votes.reduceByKey(np.add, 4 * tasks).map(lambda kv: (kv[0], kv[1].tobytes()))
        votes = spark.createDataFrame(votes, "block long, votes binary")
        classes = self.classes

        def to_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for mark, vote in zip(batch.column("mark"), batch.column("votes")):
                    at = np.frombuffer(mark.as_py(), np.int64)
                    flat = np.frombuffer(vote.as_py()) if vote.is_valid else np.zeros(len(at) * classes)
                    ends = np.arange(len(at) + 1, dtype=np.int32) * classes
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["_at", "_raw"])

        rows = checkpoint(blocks.join(votes, "block", "left").select("mark", "votes").mapInArrow(to_rows, "_at long, _raw array<double>"))
        total = F.aggregate("_raw", F.lit(0.0), lambda a, b: a + b)
        return df.join(rows, "_at").withColumns({
            "rawPrediction": array_to_vector(F.col("_raw")),
            "probability": array_to_vector(F.transform("_raw", lambda v: F.when(total > 0, v / total).otherwise(0.0))),
            "prediction": (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double"),
        }).drop("_at", "_raw")
