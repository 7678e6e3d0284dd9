"""Hidden Markov language model.

Training texts are those whose crc32(doc_id) mod 7 is not 2. Tokens are words
(A-Z lower-cased) and one end per text. The model's alphabet is the end, the
most frequent words, and classes of all other words by their first two bytes;
a word outside the alphabet has its class's probability times
(c + 1) / (N_class + V_class + 1), which leaves a share for unseen words.

Baum-Welch runs over all training texts in every round: tasks compute scaled
forward-backward passes over runs of ``SEGMENT`` tokens (a run inside a text
starts from the states' long-run shares), the expected counts are cut into
blocks, summed by block on the executors, and only the sums (states x alphabet,
a fixed size) reach the driver. Scoring is exact: the scaled forward recursion
over each whole text.

Word counts cover the corpus in a table. The counts of at most ``TABLE`` words
are sent to the tasks, those of all others are joined, so nothing sent grows
with the input. Words are known by 64-bit hashes.

Defined cases: a null text is empty (one end token), a null doc_id has the
empty text as its id; without training texts N = V = 0 and score = base_score;
repeated rows are scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.textbytes import WORD_TABLES, mix, text_chunks, words
from sitewise.session import shared_path

STATES = 8
ROUNDS = 4
ALPHABET = 16384  # words with an emission of their own, at most
TABLE = 1 << 18  # words whose counts are sent to the tasks, at most
CLASSES = 256
SEGMENT = 128
BLOCKS = 128
BATCH_BYTES = 1 << 21
END = 0  # symbol of the end of a text; classes follow, then words
END_HASH = -(1 << 62)  # key of the end among the counts
SEED = 11


def is_held_out(doc_id: Column) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 7 == 2


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word classes, words per text) of a chunk."""
    h, n, starts = words(buf, offsets)
    values = WORD_TABLES[0]
    first = values[buf[starts]] if len(starts) else np.empty(0, np.uint64)
    after = np.zeros(len(buf) + 1, np.uint64)
    if len(buf):
        after[:-1] = values[buf]
        after[offsets] = 0  # a text's first byte follows no word of the text before
    second = after[starts + 1] if len(starts) else first
    cls = (mix(first * np.uint64(3) + second) & np.uint64(CLASSES - 1)).astype(np.int32)
    return h.view(np.int64), cls, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hs, cs, texts = [], [], 0
        for _, buf, offsets in text_chunks(batch.column("text")):
            h, c, n = tokens(buf, offsets)
            hs.append(h)
            cs.append(c)
            texts += len(n)
        h = np.concatenate(hs) if hs else np.empty(0, np.int64)
        c = np.concatenate(cs) if cs else np.empty(0, np.int32)
        key, at, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(key, END_HASH)), pa.array(np.append(c[at], -1).astype(np.int32)), pa.array(np.append(n, texts).astype(np.int64))],
            names=["h", "cls", "n"])


@dataclass
class Vocabulary:
    """Bounded tables sent to the tasks; sorted by hash."""

    train_tokens: int
    distinct: int
    table: np.ndarray  # hashes with known counts
    table_n: np.ndarray
    words: np.ndarray  # hashes of the alphabet
    class_total: np.ndarray  # N_class + V_class + 1 of the words outside the alphabet

    @property
    def symbols(self) -> int:
        return 1 + CLASSES + len(self.words)

    def symbol(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        at, hit = _find(self.words, h)
        return np.where(hit, 1 + CLASSES + at, 1 + cls).astype(np.int32)


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 0:
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _least(sizes: list[tuple[int, int]], most: int) -> int:
    """Smallest step of counts such that the words from it on are at most ``most``."""
    total, least = 0, None
    for step, n in sorted(sizes, reverse=True):
        if total + n > most:
            break
        total, least = total + n, step
    return (max((s for s, _ in sizes), default=0) + 1) if least is None else least


def vocabulary(counts: DataFrame) -> Vocabulary:
    step = F.floor(F.log2("n") * 32).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).collect()  # at most 32 * 64 rows
    ranks = [(r["step"], r["v"]) for r in sizes]
    cut, cut_words = _least(ranks, TABLE), _least(ranks, ALPHABET)
    top = counts.where((step >= cut) & (F.col("h") != END_HASH)).select("h", "n").toArrow()  # at most TABLE rows
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    alphabet = h[np.floor(np.log2(np.maximum(n, 1)) * 32).astype(int) >= cut_words]
    rest = counts.where((step < cut_words) & (F.col("h") != END_HASH)).groupBy("cls").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    total = np.ones(CLASSES)
    for r in rest:
        total[r["cls"]] += r["n"] + r["v"]
    return Vocabulary(sum(r["n"] for r in sizes), sum(r["v"] for r in sizes), h, n, alphabet, total)


# ------------------------------------------------------------------ model


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K

    def long_run(self) -> np.ndarray:
        p = self.start
        for _ in range(200):
            p = 0.5 * p + 0.5 * (p @ self.move)
        return p / p.sum()


def first_model(symbols: int, counts: np.ndarray, states: int = STATES) -> Model:
    """Slow states whose emissions are the word shares times random factors."""
    rng = np.random.default_rng(SEED)
    emit = (counts + 0.5)[:, None] * np.exp(rng.normal(0, 0.7, size=(symbols, states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def expected_counts(model: Model, seqs: np.ndarray, lengths: np.ndarray, heads: np.ndarray):
    """(emission, transition, start counts, log-likelihood) of padded runs.

    seqs is runs x time; heads marks runs that begin a text. Runs are sorted by
    falling length, so the active ones at a time are a prefix."""
    symbols, k = model.emit.shape
    move = model.move.astype(np.float32)
    emit = model.emit.astype(np.float32)
    n, most = seqs.shape
    active = np.searchsorted(-lengths, -np.arange(most), side="left")  # runs longer than t
    first = np.where(heads[:, None], model.start, model.long_run()).astype(np.float32)
    alpha = np.zeros((most, n, k), np.float32)
    scale = np.ones((most, n), np.float32)
    for t in range(most):
        m = active[t]
        a = (first if t == 0 else alpha[t - 1, :m] @ move)[:m] * emit[seqs[:m, t]]
        c = np.maximum(a.sum(axis=1), 1e-30)
        alpha[t, :m] = a / c[:, None]
        scale[t, :m] = c
    emission = np.zeros((k, symbols))
    transition = np.zeros((k, k))
    beta = np.ones((n, k), np.float32)
    gamma = np.zeros_like(alpha)
    for t in range(most - 1, -1, -1):
        m = active[t]
        if t + 1 < most and (nxt := active[t + 1]):
            b = emit[seqs[:nxt, t + 1]] * beta[:nxt] / scale[t + 1, :nxt, None]
            transition += (alpha[t, :nxt].T @ b) * move
            beta[:nxt] = b @ move.T
        gamma[t, :m] = alpha[t, :m] * beta[:m]
    valid = np.arange(most)[:, None] < lengths[None, :]
    flat = seqs.T[valid]
    g = gamma[valid]
    for j in range(k):
        emission[j] = np.bincount(flat, weights=g[:, j], minlength=symbols)
    start = gamma[0][heads].sum(axis=0, dtype=np.float64)
    return emission.T, transition, start, float(np.log(scale).sum())


def runs_of(sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (symbols one after another, n of each, ends included) as padded runs."""
    ends = np.cumsum(n)
    pieces = -(-n // SEGMENT)
    text = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (ends - n)[text] + nth * SEGMENT
    lengths = np.minimum(ends[text] - begin, SEGMENT)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths, heads = begin[order], lengths[order], nth[order] == 0
    at = begin[:, None] + np.arange(lengths.max() if len(lengths) else 0)[None, :]
    return sym[np.minimum(at, len(sym) - 1)], lengths, heads


def with_ends(sym: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.full(len(sym) + len(n), END, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(n + 1) - 1] = False
    out[keep] = sym
    return out


def _blocks(size: int) -> list[tuple[int, int]]:
    edge = [size * i // BLOCKS for i in range(BLOCKS + 1)]
    return list(zip(edge, edge[1:], strict=False))


def _expect(vocab, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocab.value, model.value
        k = len(m.start)
        total = np.zeros(m.emit.size + k * k + k + 1)
        for batch in batches:
            for _, buf, offsets in text_chunks(batch.column("text"), BATCH_BYTES):
                h, cls, n = tokens(buf, offsets)
                sym = with_ends(v.symbol(h, cls), n)
                emission, transition, start, ll = expected_counts(m, *runs_of(sym, n + 1))
                total += np.concatenate([emission.ravel(), transition.ravel(), start, [ll]])
        parts = [(i, total[a:b].tobytes()) for i, (a, b) in enumerate(_blocks(len(total))) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["block", "part"])

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
            x = np.frombuffer(x)
            sums[i] = sums[i] + x if i in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "part"])


def train_round(texts: DataFrame, vocab, model: Model) -> tuple[Model, float]:
    """One Baum-Welch round over all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    kind = "block int, part binary"
    rows = texts.mapInArrow(_expect(vocab, sent), kind).repartition("block").mapInArrow(_sum_blocks, kind)
    total = np.concatenate([np.frombuffer(bytes(r["part"])) for r in sorted(rows.collect(), key=lambda r: r["block"])])
    sent.unpersist()
    symbols, k = model.emit.shape
    emission, rest = total[: symbols * k].reshape(symbols, k), total[symbols * k :]
    emission = emission + 0.01
    move = rest[: k * k].reshape(k, k) + 0.1
    start = rest[k * k : k * k + k] + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emission / emission.sum(axis=0)), float(rest[-1])


# ------------------------------------------------------------------ scoring


def forward(model: Model, sym: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of each text's symbols (n of each, ends included)."""
    begin = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    at, length = begin[order], n[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    score = np.zeros(len(n))
    a = np.broadcast_to(model.start, (len(n), len(model.start)))
    for t, m in enumerate(active.tolist()):
        a = (a[:m] if t == 0 else a[:m] @ model.move) * model.emit[sym[at[:m] + t]]
        c = a.sum(axis=1)
        a = a / c[:, None]
        score[:m] += np.log10(c)
    out = np.empty(len(n))
    out[order] = score
    return out


_SCORED = "id long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, symbols double, rare array<struct<h:long,m:long>>"
_SCORED_ARROW = pa.schema([
    ("id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("logs", pa.float64()), ("symbols", pa.float64()), ("rare", pa.list_(pa.struct([("h", pa.int64()), ("m", pa.int64())]))),
])


def _score(vocab, model, train_texts: int):
    """Per text: its tokens with known counts summed, the likelihood of its
    symbols, and its other words with their numbers. ``logs`` is the sum of
    log10(c + 1); ``symbols`` the model's part that needs no more counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = vocab.value, model.value
        logs_of = np.log10(v.table_n + 1.0)
        minus = np.log10(v.class_total)
        end_log = np.log10(train_texts + 1.0)
        for batch in batches:
            got = {c: [] for c in ("n", "known", "logs", "outside", "sym")}
            rare_h, rare_m, rare_n = [], [], []
            for _, buf, offsets in text_chunks(batch.column("text")):
                h, cls, n = tokens(buf, offsets)
                at, hit = _find(v.table, h)
                log = np.where(hit, logs_of[at] if len(logs_of) else 0.0, 0.0)
                sym = v.symbol(h, cls)
                out = sym <= CLASSES
                text = np.repeat(np.arange(len(n)), n)
                add = lambda w, text=text, n=n: np.bincount(text, weights=w, minlength=len(n))
                got["n"].append(n + 1)
                got["known"].append(add(hit.astype(float)) + (train_texts > 0))
                got["logs"].append(add(log) + end_log)
                got["outside"].append(add(np.where(out, log - minus[cls], 0.0)))
                got["sym"].append(with_ends(sym, n))
                miss, owner = h[~hit], text[~hit]
                order = np.lexsort((miss, owner))
                miss, owner = miss[order], owner[order]
                first = np.ones(len(miss), bool)
                first[1:] = (miss[1:] != miss[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(first)
                rare_h.append(miss[begin])
                rare_m.append(np.diff(np.append(begin, len(miss))))
                rare_n.append(np.bincount(owner[begin], minlength=len(n)))
            cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
            n = cat(got["n"], np.int64)
            known, logs = cat(got["known"], float), cat(got["logs"], float)
            like = forward(m, cat(got["sym"], np.int32), n) + cat(got["outside"], float)
            ends = np.concatenate([[0], np.cumsum(cat(rare_n, np.int64))]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                [pa.array(cat(rare_h, np.int64)), pa.array(cat(rare_m, np.int64))], names=["h", "m"]))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(known.astype(np.int64)),
                pa.array(logs), pa.array(like), rare], schema=_SCORED_ARROW)

    return run


def train_and_score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Scores of every document under the word-count base and the model."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), is_held_out(F.col("doc_id")).alias("held_out"))
    texts = rows.where(~F.col("held_out")).select("text")
    path = shared_path(spark, "hmm-counts")
    texts.mapInArrow(_count, "h long, cls int, n long").groupBy("h").agg(F.first("cls").alias("cls"), F.sum("n").alias("n")).where(
        F.col("n") > 0).write.parquet(path)
    counts = spark.read.parquet(path)
    v = vocabulary(counts)
    ends = counts.where(F.col("h") == END_HASH).first()
    train_texts = ends["n"] if ends else 0
    sc = spark.sparkContext
    vocab = sc.broadcast(v)
    weight = np.full(v.symbols, 1.0)
    at, hit = _find(v.table, v.words)
    weight[1 + CLASSES :] = v.table_n[at] if len(at) else 0
    weight[1 : 1 + CLASSES] = v.class_total
    weight[END] = train_texts + 1
    model = first_model(v.symbols, weight, states)
    for _ in range(rounds if train_texts else 0):
        model, _ = train_round(texts, vocab, model)
    sent = sc.broadcast(model)
    path = shared_path(spark, "hmm-scores")
    rows.withColumn("id", F.monotonically_increasing_id()).select("id", "doc_id", "held_out", "text").mapInArrow(
        _score(vocab, sent, train_texts), _SCORED).write.parquet(path)
    scored = spark.read.parquet(path)
    rare = scored.select("id", F.explode("rare").alias("x")).select("id", "x.h", "x.m")
    rare = rare.join(counts.select("h", "n"), "h").groupBy("id").agg(
        F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("rare_logs"), F.sum("m").alias("rare_known"))
    out = scored.drop("rare").join(rare, "id", "left")
    more = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(v.train_tokens + v.distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("symbols") + more if train_texts else base).alias("score"))
