"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed; in each window of ``w`` consecutive
hashes the smallest is kept, the rightmost on ties, with its position. Two
texts that share a run of at least ``w + k - 1`` code points share a kept hash.

Fingerprint text: for each kept gram 8 hex digits of its hash and 8 of its
position (code points), in order of position. A text of fewer than k code
points is one gram; fewer than w grams are one window; an empty or null text
has the empty fingerprint. Likeness is the Jaccard coefficient of the kept
hashes; two empty fingerprints are alike (1.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.textbytes import mix, mix_int

K, W = 12, 32
_U = np.uint64
_B = _U(0xD6E8FEB86659FD93)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values: runs of 1, 2, 4 ... are doubled, then joined."""
    h = mix(codes.astype(_U) + _U(1))
    if len(h) <= k:
        out = len(h)
        for x in h.tolist():
            out = mix_int(out * int(_B) + x)
        return np.array([out], dtype=_U)
    base, size, done, have = int(_B), 1, None, 0
    n, bits = len(h), k
    while bits:
        if bits & 1:
            if done is None:
                done, have = h, size
            else:
                m = n - have - size + 1
                done = done[:m] * _U(base) + h[have : have + m]
                have += size
        bits >>= 1
        if bits:
            h = h[: n - 2 * size + 1] * _U(base) + h[size:]
            base = base * base & 0xFFFFFFFFFFFFFFFF
            size *= 2
    return mix(done)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, by doubled and overlapped halves."""
    if len(x) <= w:
        return x.min(keepdims=True)
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of one text."""
    if not text:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    g = grams(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), k)
    n = len(g)
    # smaller hash first, then the larger position: the rightmost of equal ones
    key = (g & _U(0xFFFFFFFF00000000)) | (_U(0xFFFFFFFF) - np.arange(n, dtype=_U))
    kept = window_min(key, w)
    kept = kept[np.concatenate([[True], kept[1:] != kept[:-1]])]
    return (kept >> _U(32)).astype(np.uint32), (_U(0xFFFFFFFF) - (kept & _U(0xFFFFFFFF))).astype(np.uint32)


def encode(hashes: np.ndarray, positions: np.ndarray) -> str:
    return np.stack([hashes, positions], axis=1).astype(">u4").tobytes().hex() if len(hashes) else ""


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").reshape(-1, 2).astype(np.uint32)
    return a[:, 0], a[:, 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sets given as sorted distinct hashes."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(df: DataFrame, text: str = "text", k: int = K, w: int = W, out: str = "fingerprint") -> DataFrame:
    """Adds the winnowing fingerprint of a text column."""

    @F.pandas_udf("string")
    def fp(s):
        return s.map(lambda t: encode(*winnow(t or "", k, w)))

    return df.withColumn(out, fp(F.col(text)))


# ------------------------------------------------------------------ edited copies

_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, hashes, positions, distinct hashes) of the row before
        for batch in batches:
            rows = []
            for doc_id, text, halo in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("_halo").to_pylist(), strict=True
            ):
                if held is None and halo:
                    continue
                h, p = winnow(text, k, w)
                now = (doc_id, text, h, p, np.unique(h))
                if held is not None:
                    rows.append(_one(held, now, k, w))
                held = None if halo else now
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _one(a, b, k, w) -> dict:
    text, n = a[1], len(a[1])
    cut = n // 3
    edited = text[: n - cut] + b[1][:cut]
    h, p = winnow(edited, k, w)
    return {
        "doc_id": a[0], "n_chars": n, "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": encode(a[2], a[3]), "edited_fingerprint": encode(h, p),
        "near_edited": likeness(a[4], np.unique(h)), "near_next": likeness(a[4], b[4]),
    }


def edited_copies(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprint of each text and of its edited text: the last third replaced
    by the start of the next document in descending doc_id (after the last: the
    first).

    Rows are dealt out by ranges of doc_id and streamed in order, so each text
    is moved once and a task holds two texts. A range's last row needs the
    first row of the next lower range: that one row is sent to both. The driver
    sees one bound and one maximum per partition. A null doc_id sorts last; of
    equal ids the smaller text comes first.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(least))
    ids = docs.select(order.alias("id"))
    bounds = (ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10000).alias("b")).first()["b"] or []) if n > 1 else []
    bounds = sorted(set(bounds))
    bucket = F.lit(0)
    if bounds:
        # number of bounds that are not above the id, by position in the sorted array
        @F.pandas_udf("int")
        def bucket_of(s):
            return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), s.to_numpy(), side="right").astype("int32"))

        bucket = bucket_of(order)
    tops = dict(
        (r["b"], r["m"]) for r in ids.select(F.col("id"), (bucket_of(F.col("id")) if bounds else F.lit(0)).alias("b"))
        .groupBy("b").agg(F.max("id").alias("m")).collect()
    )
    if not tops:
        return spark.createDataFrame([], _SCHEMA)
    full = sorted(tops)
    # the first row of a range also goes, marked, to the range above it; that of the highest range to the lowest
    goes = {tops[b]: full[(i + 1) % len(full)] for i, b in enumerate(full)}
    above = F.create_map(*[x for m, b in goes.items() for x in (F.lit(m).cast("long"), F.lit(b))])
    rows = rows.withColumn("_id", order).withColumn("_b", bucket.cast("int"))
    target = F.element_at(above, F.col("_id"))
    rows = rows.withColumn("_to", F.explode(F.when(target.isNull(), F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("h"))))
                                            .otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("h")),
                                                               F.struct(target.alias("b"), F.lit(True).alias("h"))))))
    rows = rows.select("doc_id", "text", "_id", F.col("_to.b").alias("_b"), F.col("_to.h").alias("_halo"))
    rows = rows.repartitionById(n, F.col("_b")).sortWithinPartitions(F.col("_halo"), F.col("_id").desc(), F.col("text"))
    return rows.select("doc_id", "text", "_halo").mapInArrow(_in_order(k, w), _SCHEMA)
