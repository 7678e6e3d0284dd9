"""Merge-type SentencePiece encoding and decoding.

A text is normalised as the model says (spaces become U+2581, one is put in
front), cut into symbols of one character, and adjacent pairs that form a piece
wait in an agenda ordered by score, then by position. The best pair is merged,
its neighbours join the agenda. Characters outside the vocabulary become their
byte pieces.

Merges cannot cross two adjacent characters that no piece contains side by
side. The class proves from the vocabulary that none holds U+2581 after another
character, and whether the line feed is alone, and cuts the text there; equal
chunks of a batch then have equal ids and are encoded once. Symbols are numbers
and a pair is looked up in a table of all two-part splits of the pieces. Chunks
of up to ``SHORT`` characters have their agendas side by side as rows of an
array, the best pair of each row is merged at each step; longer chunks have a
heap. Nothing is kept from one batch to the next.

All chunks that are encoded are checked against the sentencepiece library in
blocks, as is one whole text per batch; for a model without such cuts every
whole text is. A difference raises.

Defined cases: a null text is the empty text (the end id alone, decoded as
empty); rows without doc_id and repeated rows are encoded like others, one
output row each; an empty table gives an empty table; extra columns are not
read; texts of any length are encoded whole. Models with unused pieces or a
normaliser that changes white space are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.textbytes import text_parts

SPACE = "▁"
SHORT = 48  # characters; longer chunks have a heap
CELLS = 1 << 18  # symbols of short chunks worked on together
BLOCK = 1 << 16  # characters given to the library at once
SIZE = 1 << 19  # characters of texts encoded together
_NONE = np.iinfo(np.int32).max
_PAD = -1
_LOW = (1 << 32) - 1


def _ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], .., begin[0] + n[0] - 1, begin[1], .."""
    return np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n)


class MergeEncoder:
    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.lib = sp = SentencePieceProcessor(model_file=model)
        score, self.id, self.byte = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                if sp.is_unused(i):
                    raise ValueError("models with unused pieces are not supported")
                score[piece], self.id[piece] = sp.get_score(i), i
        probe = sp.id_to_piece(sp.encode("  a  b "))
        if probe[:1] != [SPACE * 2] or probe[-1:] != [SPACE]:
            raise ValueError("the model's normaliser changes white space")
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        cuts = not any(b == SPACE != a for a, b in pairs)
        self.alone = not any("\n" in p for p in pairs) and cuts
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if cuts else "(?s:.+)")
        self.eos = sp.eos_id()
        self._feed = sp.encode("\n")[len(sp.encode("")) :][-len(sp.encode("a\n")) + len(sp.encode("a")) :]
        self.shown = list(map(str, range(sp.get_piece_size())))
        self._tables(score)

    def _tables(self, score: dict[str, float]) -> None:
        """Numbers of symbols (pieces and their characters) and the pair table:
        (left, right) -> rank of the merged piece << 32 | its number."""
        self.symbols = list(dict.fromkeys(chain(self.id, chain.from_iterable(self.id))))
        number = {s: i for i, s in enumerate(self.symbols)}
        levels = {v: i for i, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.pair = {}
        for piece in self.id:
            for i in range(1, len(piece)):
                if (x := number.get(piece[:i])) is not None and (y := number.get(piece[i:])) is not None:
                    self.pair[x << 32 | y] = levels[score[piece]] << 32 | number[piece]
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        order = np.argsort(keys)
        # the last key is greater than any pair's
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        values = np.fromiter(self.pair.values(), np.int64, len(self.pair))[order]
        self.rank, self.to = np.append(values >> 32, _NONE).astype(np.int32), np.append(values & _LOW, _PAD).astype(np.int32)
        # a character outside the vocabulary is the number of symbols plus its code point
        self.of_char = np.arange(0x110000, dtype=np.int32) + len(self.symbols)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.id_of = np.array([self.id.get(s, -1) for s in self.symbols], np.int32)

    def _find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places in the pair table; the last place for pairs that form no piece."""
        key = x.astype(np.int64) << 32 | y.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return at

    def _rows(self, sym: np.ndarray, row: np.ndarray):
        """Merges the rows of sym (padded at the right) side by side; yields
        (row, symbols) of those whose agenda is empty."""
        rank = np.full((len(sym), max(sym.shape[1] - 1, 1)), _NONE, np.int32)
        if sym.shape[1] > 1:
            real = np.flatnonzero(sym[:, 1:].ravel() != _PAD)
            left, right = sym[:, :-1].ravel()[real], sym[:, 1:].ravel()[real]
            rank.ravel()[real] = self.rank[self._find(left, right)]
        while len(sym):
            at = rank.argmin(axis=1)  # the first of the best: the leftmost
            line = np.arange(len(sym))
            on = rank[line, at] != _NONE
            if not on.all():
                yield row[~on], sym[~on]
                sym, rank, row, at = sym[on], rank[on], row[on], at[on]
                line = np.arange(len(sym))
                if not len(sym):
                    return
            new = self.to[self._find(sym[line, at], sym[line, at + 1])]
            # the pair becomes one symbol: what follows moves by one
            width = sym.shape[1] - 1
            cols = np.arange(width)
            sym = np.take_along_axis(sym, cols + (cols > at[:, None]), axis=1)
            sym[line, at] = new
            if width == 1:
                yield row, sym
                return
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols > at[:, None]), axis=1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                left, right = sym[ok, side[ok]], sym[ok, side[ok] + 1]
                value = np.full(len(ok), _NONE, np.int32)
                real = right != _PAD
                value[real] = self.rank[self._find(left[real], right[real])]
                rank[ok, side[ok]] = value

    def _heap(self, sym: list[int]) -> list[int]:
        """Symbols of one long chunk, merged by an agenda on a heap; entries whose
        symbols changed are skipped."""
        get, n = self.pair.get, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(e >> 32, i, i + 1, k, e & _LOW) for i in range(n - 1) if (e := get(k := sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, key, new = heapq.heappop(agenda)
            if sym[a] < 0 or sym[b] < 0 or after[a] != b or sym[a] << 32 | sym[b] != key:
                continue
            sym[a], sym[b] = new, _PAD
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                if (e := get(k := new << 32 | sym[c])) is not None:
                    heapq.heappush(agenda, (e >> 32, a, c, k, e & _LOW))
            p = before[a]
            if p >= 0 and (e := get(k := sym[p] << 32 | new)) is not None:
                heapq.heappush(agenda, (e >> 32, p, a, k, e & _LOW))
        return [x for x in sym if x != _PAD]

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, number of ids of each) by the agenda."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        every = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")]
        begin = np.cumsum(size) - size
        rows, syms = [], []
        for i in np.flatnonzero(size > SHORT).tolist():
            out = self._heap(every[begin[i] : begin[i] + size[i]].tolist())
            rows.append(np.full(len(out), i))
            syms.append(np.array(out, np.int32))
        order = np.argsort(size, kind="stable")
        order = order[(size[order] <= SHORT) & (size[order] > 0)]
        a = 0
        while a < len(order):
            b = min(len(order), a + CELLS // int(size[order[min(len(order), a + CELLS // int(size[order[a]])) - 1]]))
            part = order[a:b]
            a = b
            n = size[part]
            sym = np.full((len(part), int(n[-1])), _PAD, np.int32)
            sym[np.arange(sym.shape[1]) < n[:, None]] = every[_ragged(begin[part], n)]
            for row, done in self._rows(sym, part):
                real = done != _PAD
                rows.append(np.repeat(row, real.sum(axis=1)))
                syms.append(done[real])
        if not rows:
            return np.empty(0, np.int32), np.zeros(len(chunks), np.int64)
        row, sym = np.concatenate(rows), np.concatenate(syms)
        order = np.argsort(row, kind="stable")  # symbols of a chunk stay in order
        return self._ids(row[order], sym[order], len(chunks))

    def _ids(self, row: np.ndarray, sym: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = sym < len(self.symbols)
        ids = np.where(known, self.id_of[np.where(known, sym, 0)], -1).astype(np.int32)
        rare = np.flatnonzero(ids < 0)
        if len(rare):
            kinds, which = np.unique(sym[rare], return_inverse=True)
            lists = []
            for k in kinds.tolist():
                raw = (self.symbols[k] if k < len(self.symbols) else chr(k - len(self.symbols))).encode()
                lists.append([self.byte[b] for b in raw] if self.byte else [self.lib.unk_id()])
            width = np.array([len(x) for x in lists])
            times = np.ones(len(sym), np.int64)
            times[rare] = width[which]
            spread = np.repeat(ids, times)
            flat = np.array(list(chain.from_iterable(lists)), np.int32)
            spread[spread < 0] = flat[_ragged((np.cumsum(width) - width)[which], width[which])]
            ids, row = spread, np.repeat(row, times)
        return ids, np.bincount(row, minlength=n)

    def check(self, chunks: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        """Compares chunks with the library, which gets them in blocks, a line
        feed before each: no piece crosses it."""
        first, feed = self.lib.encode("\n")[:-len(self._feed)], self._feed
        end = np.cumsum(count)
        size = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
        a = 0
        while a < len(chunks):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK, side="right")))
            theirs = np.array(self.lib.encode("\n" + "\n".join(chunks[a:b])), np.int32)
            n = count[a:b] + len(feed)
            at = np.cumsum(n) - n + len(first)
            mine = np.empty(len(first) + int(n.sum()), np.int32)
            mine[: len(first)] = first
            mine[_ragged(at, np.full(b - a, len(feed)))] = np.tile(feed, b - a)
            mine[_ragged(at + len(feed), count[a:b])] = ids[end[a] - count[a] : end[b - 1]]
            if not np.array_equal(mine, theirs):
                raise ValueError(f"differs from the library between {chunks[a]!r} and {chunks[b - 1]!r}")
            a = b

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, the end id last."""
        number = defaultdict(count().__next__)  # of distinct chunks; those of a text are let go once numbered
        cut = [np.fromiter(map(number.__getitem__, c), np.int32, len(c)) for c in map(self.chunks, texts)]
        distinct = list(number)
        del number
        ids, n = self.merge(distinct)
        if self.alone:
            self.check(distinct, ids, n)
        del distinct
        begin = np.cumsum(n) - n
        for i, which in enumerate(cut):
            got = ids[_ragged(begin[which], n[which])].tolist()
            if (i == 0 or not self.alone) and self.lib.encode(texts[i]) != got:
                raise ValueError("differs from the library on a whole text")
            yield [*got, self.eos]

    def show(self, ids: list[int]) -> str:
        """The ids as decimals joined by one space."""
        return " ".join(map(self.shown.__getitem__, ids))


_worker: dict[str, MergeEncoder] = {}


def worker_encoder(model: str) -> MergeEncoder:
    if model not in _worker:
        _worker[model] = MergeEncoder(model)
    return _worker[model]


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_IDS = "doc_id long, token_ids array<int>, decoded string"


def _rows(model: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        names = ["doc_id", "token_ids", "decoded"] if full else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        for part in text_parts(batches, SIZE):
            n, kept, back = [], [], []
            for ids in enc.encode_batch([t or "" for t in part.column("text").to_pylist()]):
                n.append(len(ids))
                text = enc.lib.decode(ids)
                kept.append(np.array(ids, np.int32) if full else sha(enc.show(ids)))
                back.append(text if full else sha(text))
            if full:
                cols = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(kept))), pa.array(back, pa.string())]
            else:
                cols = [pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=names)

    return run


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """Token ids (end id last) and the text decoded from them; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_rows(model, True), _IDS)


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """Token count, digest of the ids and of the decoded text of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_rows(model, False), _SCHEMA)
