"""Vectorised word work on Arrow string columns (numpy over the UTF-8 buffer).

A word is a run of bytes that are no separator; the default separators are
space and 0x09-0x0D. A-Z are lower-cased by table, other bytes are untouched.
Word hashes are polynomial sums over random byte values modulo 2**64, mixed;
they depend on the bytes of the word alone, so they agree between tasks.

Work is done in chunks of whole texts of about ``CHUNK`` bytes, so memory is
bounded by the longest single text, not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
TEXTS = 1 << 20  # bytes of texts that are Python objects at a time
LEAN = 1 << 16  # for steps of many arrays as long as the chunk; workers keep what they once took
WHITE = b" \t\n\x0b\x0c\r"
_U = np.uint64
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the output."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], dtype=_U))[0])


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        out = []
        for b in (_BASE, _BASE_INV):
            a = np.full(size, b, dtype=_U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=_U))
        _powers = (out[0], out[1])
    return _powers


def byte_tables(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(value of each byte, is-separator) after the A-Z fold."""
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    values = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    values = values[fold]
    sep = np.zeros(256, dtype=bool)
    sep[np.frombuffer(separators, dtype=np.uint8)] = True
    values[sep] = 0
    return values, sep


WORD_TABLES = byte_tables(WHITE)
# Letter words: runs of a-z (A-Z lower-cased) and of bytes of other characters.
LETTER_TABLES = byte_tables(bytes(b for b in range(128) if not (65 <= b < 91 or 97 <= b < 123)))


def text_chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        lo, hi = int(offsets[a]), int(offsets[b])
        yield a, raw[lo:hi], offsets[a : b + 1] - lo
        a = b


def text_parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have size bytes or less together, or one text:
    what a step makes of a batch is in memory for one run at a time."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = np.cumsum(n)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(run, run[a] - n[a] + size, side="right")))
            yield batch.slice(a, b - a)
            a = b


def words(buf: np.ndarray, offsets: np.ndarray, tables=WORD_TABLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word counts per text, byte starts) of one chunk."""
    n_docs = len(offsets) - 1
    if len(buf) == 0:
        return np.empty(0, _U), np.zeros(n_docs, np.int64), np.empty(0, np.int64)
    values, is_sep = tables
    sep = is_sep[buf]
    start = ~sep
    start[1:] &= sep[:-1]
    first = offsets[:-1]
    first = first[first < len(buf)]
    start[first] = ~sep[first]
    starts = np.flatnonzero(start)
    if len(starts) == 0:
        return np.empty(0, _U), np.zeros(n_docs, np.int64), starts
    up, down = powers(len(buf))
    part = values[buf]
    part *= up[: len(buf)]
    sums = np.add.reduceat(part, starts)
    sums *= down[starts]
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return mix(sums), counts, starts


def hash_word(word: str | bytes) -> int:
    """Hash of one word, as ``words`` gives it."""
    raw = word.encode() if isinstance(word, str) else word
    h, c, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    if len(h) != 1:
        raise ValueError("not one word")
    return int(h[0])
