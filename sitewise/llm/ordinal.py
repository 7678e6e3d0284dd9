"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < G share one weight vector over hashed text features and
have ordered thresholds: P(grade > j) = sigmoid(w.x - t_j). The expected grade
is the sum of these tails; a document is selected when the tail probability of
the wanted grade reaches a level.

Features (binary, hashed into ``BUCKETS`` slots): letter words, the runs of
``GRAM`` bytes inside them, runs of symbols, and steps of whole-text statistics: share of capitals, symbols, digits,
repeated words and repeated lines, mean word length, number of words.

The model is fitted on at most ``FIT_ROWS`` labelled rows (the smallest hashes
of doc_id, a documented bound); features of fewer than ``MIN_ROWS`` of them
or with small odds have no weight. Scoring covers every row and whole texts.

Defined cases: a null text is empty; a null grade is not used, one outside the
levels counts as the nearest; several labels
of a document all count; a level that no label has gets an empty interval; no
labels at all: grade and tail are null and every document is selected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.tables import fresh
from sitewise.llm.textbytes import LEAN, LETTER_TABLES, TEXTS, WHITE, byte_tables, mix, text_chunks, text_parts, words

BUCKETS = 1 << 18
GRAM = 4
FIT_ROWS = 10000
MIN_ROWS = 5
STEPS = 100
LEAST_ODDS = 0.2
PART = 1 << 20

_ALNUM = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))
_NOT_SYMBOL = bytes(b for b in range(256) if b in WHITE or b in _ALNUM or b >= 128 or b < 32 or b == 127)
SYMBOLS = byte_tables(_NOT_SYMBOL)
TOKENS = byte_tables(WHITE)
LINES = byte_tables(b"\n", lower=False)
_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[b for b in range(256) if b not in _NOT_SYMBOL]] = 3
# Steps of the statistics: shares, mean length, number of words.
SHARES = np.array([0.001, 0.01, 0.03, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
LENGTHS = np.array([2, 3, 4, 4.5, 5, 5.5, 6, 7, 9, 12])
COUNTS = np.array([1, 3, 10, 30, 100, 300, 1000, 3000, 10000])


def _per_text(counts: np.ndarray) -> list[slice]:
    ends = np.cumsum(counts)
    return [slice(a, b) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the runs of GRAM letter bytes, and their number in each text."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    values, stop = LETTER_TABLES
    v, bad = values[buf], stop[buf]
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + v[j : j + n]
        ok &= ~bad[j : j + n]
    # not across the end of a text
    for j in range(1, GRAM):
        edge = offsets[1:-1] - j
        ok[edge[(edge >= 0) & (edge < n)]] = False
    at = np.flatnonzero(ok)
    slots = (mix(h[at] + np.uint64(3)) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return slots, np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])


def features(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct feature slots of each text of a chunk."""
    w, wn, _ = words(buf, offsets, LETTER_TABLES)
    gram, gn = _grams(buf, offsets)
    s, sn, _ = words(buf, offsets, SYMBOLS)
    t, tn, _ = words(buf, offsets, TOKENS)
    ln, lnn, _ = words(buf, offsets, LINES)
    slot_w = (w & np.uint64(BUCKETS - 1)).astype(np.int32)
    slot_s = (mix(s + np.uint64(7)) & np.uint64(BUCKETS - 1)).astype(np.int32)
    kinds = np.zeros((4, len(buf) + 1), dtype=np.int64)
    k = _KIND[buf]
    for i in range(1, 4):
        np.cumsum(k == i, out=kinds[i, 1:])
    out, grams = [], _per_text(gn)
    for i, (a, b, c, d) in enumerate(zip(_per_text(wn), _per_text(sn), _per_text(tn), _per_text(lnn), strict=True)):
        e = grams[i]
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        n = max(1, hi - lo)
        nt, nl = c.stop - c.start, d.stop - d.start
        stats = [
            *(np.searchsorted(SHARES, (kinds[j, hi] - kinds[j, lo]) / n, side="right") for j in (1, 2, 3)),
            np.searchsorted(SHARES, 1 - len(np.unique(t[c])) / max(1, nt), side="right"),
            np.searchsorted(SHARES, 1 - len(np.unique(ln[d])) / max(1, nl), side="right"),
            np.searchsorted(LENGTHS, (hi - lo) / max(1, nt), side="right"),
            np.searchsorted(COUNTS, nt, side="right"),
        ]
        stat = mix(np.array([(j + 1) * 1000 + int(x) for j, x in enumerate(stats)], dtype=np.uint64))
        stat = (stat & np.uint64(BUCKETS - 1)).astype(np.int32)
        out.append(np.unique(np.concatenate([slot_w[a], gram[e], slot_s[b], stat])))
    return out


def _parts(n: int) -> list[slice]:
    return [slice(a, a + PART) for a in range(0, n, PART)]


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))

    def score(self, slots: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum() for x in slots])


def fit(slots: list[np.ndarray], grades: np.ndarray, levels: int, steps: int = STEPS, l2: float = 40.0) -> OrdinalModel:
    """Penalised maximum likelihood by full-batch Adam steps."""
    return _fit(np.concatenate(slots), np.array([len(x) for x in slots]), grades, levels, steps, l2)


def _fit(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, levels: int, steps: int = STEPS, l2: float = 40.0) -> OrdinalModel:
    """fit of slots one after another; works through them in parts of PART."""
    n, cuts = len(sizes), range(levels - 1)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    # A feature's value is its strongest log odds over the grade cuts, so the
    # penalty falls most on features that hardly tell the grades apart; those
    # below LEAST_ODDS are left out.
    seen = np.bincount(flat, minlength=BUCKETS)
    odds = np.zeros(BUCKETS)
    for j in cuts:
        high = grades > j
        if high.any() and not high.all():
            a = sum(np.bincount(flat[p][high[row[p]]], minlength=BUCKETS) for p in _parts(len(flat)))
            odds = np.maximum(odds, np.abs(np.log((a + 0.5) / (high.sum() + 1)) - np.log((seen - a + 0.5) / (n - high.sum() + 1))))
    use = np.flatnonzero((seen >= min(MIN_ROWS, n)) & (odds >= LEAST_ODDS))
    m, value = len(use), odds[use]
    new = np.full(BUCKETS, -1, dtype=np.int32)
    new[use] = np.arange(m)
    idx = new[flat]
    keep = idx >= 0
    row, idx = row[keep], idx[keep]
    each = value.astype(np.float32)[idx]
    del keep, flat
    parts = _parts(len(idx))
    share = np.array([(grades > j).mean() for j in cuts]).clip(1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.1))
    par = np.concatenate([np.zeros(m), first[:1], gaps])
    m1, m2 = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, steps + 1):
        w, t0, g = par[:m], par[m], par[m + 1 :]
        t = t0 + np.concatenate([[0.0], np.cumsum(np.exp(g))])
        score = sum((np.bincount(row[p], weights=w[idx[p]] * each[p], minlength=n) for p in parts), np.zeros(n))
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - t[None, :], -50, 50)))
        # P(grade) is the difference of neighbouring tails
        full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], axis=1)
        up, down = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        d_score = -(up - down) / p / n
        d_t = np.zeros(levels + 1)
        np.add.at(d_t, grades, up / p / n)
        np.add.at(d_t, grades + 1, -down / p / n)
        d_t = d_t[1:levels]
        rest = np.cumsum(d_t[::-1])[::-1]
        slope_w = sum((np.bincount(idx[p], weights=d_score[row[p]] * each[p], minlength=m) for p in parts), l2 / n * w)
        grad = np.concatenate([slope_w, rest[:1], rest[1:] * np.exp(g)])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        par = par - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[use] = par[:m] * value
    return OrdinalModel(weights, par[m] + np.concatenate([[0.0], np.cumsum(np.exp(par[m + 1 :]))]))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_parts(batches, TEXTS):
        found = [x.tobytes() for _, buf, off in text_chunks(batch.column("text"), LEAN) for x in features(buf, off)]
        yield pa.RecordBatch.from_arrays([batch.column("grade").cast(pa.int32()), pa.array(found, pa.binary())], names=["grade", "slots"])


def fit_documents(docs: DataFrame, ratings: DataFrame, levels: int, rows: int = FIT_ROWS) -> OrdinalModel | None:
    """Model fitted on at most ``rows`` of the ratings (doc_id, grade in 0..levels-1)."""
    some = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.least(F.greatest(F.col("grade").cast("int"), F.lit(0)), F.lit(levels - 1)).alias("grade"))
    some = some.orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id", "grade").limit(rows)
    # at most `rows` rows of two numbers: bounded by the parameter
    data = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("grade", "text")
    table = data.mapInArrow(_slots, "grade int, slots binary").toArrow()
    grades = table.column("grade").to_numpy()
    lists = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in table.column("slots")]
    # the same order whatever the partitioning, so that sums are the same
    order = [i for i in sorted(range(len(lists)), key=lambda i: (grades[i], len(lists[i]), int(lists[i].sum(dtype=np.int64)))) if len(lists[i])]
    if not order:
        return None
    sizes = np.array([len(lists[i]) for i in order])
    flat, grades = np.concatenate([lists[i] for i in order]), grades[order]
    del lists, table
    return _fit(flat, sizes, grades.astype(np.int64), levels)


OUT = ("expected_grade", "tail_probability", "selected")


def score_documents(docs: DataFrame, model: OrdinalModel | None, keep_grade: int, level: float = 0.5, out: tuple[str, str, str] = OUT) -> DataFrame:
    """Adds the expected grade, the tail probability (of ``keep_grade`` or
    better) and whether the row is selected; input columns of these names are
    replaced."""
    docs = docs.drop(*out)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({out[0]: none, out[1]: none, out[2]: F.lit(True)})
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, *(StructField(c, t()) for c, t in zip(out, (DoubleType, DoubleType, BooleanType), strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, TEXTS):
            scores = [model.score(features(buf, off)) for _, buf, off in text_chunks(batch.column("text"), LEAN)]
            tails = model.tails(np.concatenate(scores) if scores else np.empty(0))
            tail = tails[:, keep_grade - 1] if keep_grade > 0 else np.ones(len(tails))
            more = [pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= level)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *out])

    return docs.mapInArrow(run, schema)


def select_documents(docs: DataFrame, model: OrdinalModel | None, keep_grade: int, level: float = 0.5) -> DataFrame:
    """The rows that score_documents selects, with their columns as they are."""
    out = tuple(fresh(docs, c) for c in OUT)
    return score_documents(docs, model, keep_grade, level, out).where(F.col(out[2])).select(*docs.columns)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grade of a labelled document: one point for quality, one for not being
    toxic, so 2 is good, 1 is junk or toxic, 0 is both. A null label gives none."""
    return labels.select("doc_id", (F.col("quality").cast("int") + F.lit(1) - F.col("toxic").cast("int")).alias("grade"))
