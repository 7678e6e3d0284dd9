"""Byte-pair encoding and decoding by a deterministic tokenization automaton.

Construction. The automaton reads tokens (arc labels) and accepts exactly the
token sequences that byte-pair encoding makes. It starts as one state with a
loop for each byte. Merges are applied in order of rank, each by one gadget:
for a merge (u, v) -> w, arcs labelled u get a state of their own if they shared
it, the arc v leaves that state, and wherever an arc u stands an arc w is added
that leads where v led. States copied from each other differ in few arcs, and
labels that are allowed at the same states share a column, so the arcs are a bit
matrix of (state, column): ``state_of`` tells where a label leads, ``column_of``
which arcs it has. A split copies one row or one column; nothing is recomputed.

Encoding. A text is cut at added tokens and then by the pre-split pattern. Each
prefix of a piece has one accepted token sequence, so one label reaches each
byte position: from every reached position the byte trie of the labels is
walked, and a label found there is taken if the position's state has its arc.
All pieces of a batch are walked together, position by position, in numpy; the
ids are read back from the last label of each piece. Decoding concatenates the
bytes of the labels.

Letters and digits of the pre-split are those of the library's Unicode version:
code points that the installed regex module counts as letters or digits and the
library does not are found by asking its pre-splitter once, when the automaton
is compiled.

Defined cases: a null text is the empty text (no ids, empty decoded text); rows
without doc_id and repeated rows are encoded like others, one output row each;
an empty table gives an empty table; extra columns are not read. Pieces of any
length are encoded whole. Tokenizer files with other features (normalisers,
dropout, unknown tokens, prefix spaces, added tokens that strip) are refused.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pre-split pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 256  # bytes; longer pieces are walked one by one
SIZE = 1 << 21  # characters of texts encoded together


def byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file: printable Latin-1
    bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Gadgets:
    """Bit matrix of allowed arcs, grown by merge gadgets."""

    def __init__(self, n_labels: int, singles: list[int]):
        self.state_of = np.full(n_labels, -1, np.int32)
        self.column_of = np.full(n_labels, -1, np.int32)
        self.arcs = np.zeros((1024, 1024), np.uint8)
        self.arcs[0, 0] = 1
        self.states, self.columns = 1, 1
        # the start holds state 0, so no gadget takes an arc from it
        self.in_state, self.in_column = [1 + len(singles)], [len(singles)]
        self.state_of[singles] = 0
        self.column_of[singles] = 0

    def _room(self) -> None:
        s, c = self.arcs.shape
        if self.states == s or self.columns == c:
            wide = np.zeros((s * (2 if self.states == s else 1), c * (2 if self.columns == c else 1)), np.uint8)
            wide[:s, :c] = self.arcs
            self.arcs = wide

    def own_state(self, label: int) -> int:
        old = int(self.state_of[label])
        if self.in_state[old] == 1:
            return old
        self._room()
        new = self.states
        self.arcs[new] = self.arcs[old]
        self.states += 1
        self.in_state[old] -= 1
        self.in_state.append(1)
        self.state_of[label] = new
        return new

    def own_column(self, label: int) -> int:
        old = int(self.column_of[label])
        if self.in_column[old] == 1:
            return old
        self._room()
        new = self.columns
        self.arcs[:, new] = self.arcs[:, old]
        self.columns += 1
        self.in_column[old] -= 1
        self.in_column.append(1)
        self.column_of[label] = new
        return new

    def merge(self, u: int, v: int, w: int) -> None:
        if self.column_of[u] < 0 or self.column_of[v] < 0:
            return  # a part that no text makes
        if not self.arcs[self.state_of[u], self.column_of[v]]:
            return  # u is never followed by v: the merge has no place
        if self.column_of[w] >= 0:
            raise ValueError("two merges make one token")
        target = self.state_of[v]  # before u's arcs move: with u = v they differ
        self.state_of[w] = target
        self.in_state[target] += 1
        state, column = self.own_state(u), self.own_column(v)
        self.arcs[state, column] = 0
        self.column_of[w] = self.column_of[u]
        self.in_column[self.column_of[u]] += 1


class Automaton:
    """Compiled tables; what is pickled is the tables alone."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        byte = byte_letters()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.labels = [b""] * size
        for token, i in vocab.items():
            if all(ch in byte for ch in token):
                self.labels[i] = bytes(byte[ch] for ch in token)
        for token, i in self.added.items():
            self.labels[i] = token.encode()
        singles = [i for t, i in vocab.items() if len(t) == 1 and t in byte]
        if len(singles) != 256:
            raise ValueError("the vocabulary lacks a byte")
        g = Gadgets(size, singles)
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            g.merge(vocab[a], vocab[b], vocab[a + b])
        self.state_of, self.column_of = g.state_of, g.column_of
        self.arcs = np.packbits(g.arcs[: g.states, : g.columns], axis=1, bitorder="little")
        self._trie()
        self.odd = odd_code_points(path)
        self.length = np.array([len(x) for x in self.labels], np.int32)

    @staticmethod
    def _check(spec: dict) -> None:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        off = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain = (
            model["type"] == "BPE" and not any(model.get(k) for k in off) and spec["normalizer"] is None
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and (spec["decoder"] or {}).get("type") == "ByteLevel"
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]))
        if not plain:
            raise ValueError("not a plain byte-level vocabulary")

    def _trie(self) -> None:
        """Transitions of the byte trie as sorted keys node * 256 + byte."""
        step: dict[int, int] = {}
        label = [-1]
        for i in np.flatnonzero(self.column_of >= 0).tolist():
            node = 0
            for b in self.labels[i]:
                key = node * 256 + b
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(label)
                    label.append(-1)
                node = nxt
            label[node] = i
        keys = np.fromiter(step.keys(), np.int64, len(step))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.fromiter(step.values(), np.int32, len(step))[order]
        self.label_at = np.array(label, np.int32)
        # from the root every byte has a node: no search is needed
        self.first = np.array([step[b] for b in range(256)], np.int32)

    def allowed(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        c = self.column_of[label]
        return (self.arcs[state, c >> 3] >> (c & 7)) & 1 == 1

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece). Pieces of
        LONG bytes or less are walked together."""
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[: int((size > 0).sum())]
        n_long = int((size > LONG).sum())
        found = [(np.full(len(ids), i), np.arange(len(ids), 0, -1), np.array(ids, np.int32))
                 for i in order[:n_long].tolist() for ids in [self._one(pieces[i])]]
        order = order[n_long:]
        if len(order):
            length = size[order]
            buf = np.frombuffer(b"".join([pieces[i] for i in order.tolist()]), np.uint8)
            found += [(order[live], np.full(len(live), back), label) for back, (live, label) in enumerate(self._walk(buf, length))]
        count = np.zeros(len(pieces), np.int64)
        if not found:
            return np.empty(0, np.int32), count
        piece, back, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        # the walk is read from the end: higher steps back stand first
        return ids[np.lexsort((-back, piece))], np.bincount(piece, minlength=len(pieces))

    def _walk(self, buf: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Walks pieces that lie one after the other, sorted by falling length;
        yields (piece, label) of the last labels, then of those before them, ..."""
        begin = np.cumsum(length) - length
        slot = begin + np.arange(len(length))  # one slot more than bytes in each piece
        last = np.full(len(buf) + len(length), -1, np.int32)
        state = np.zeros(len(last), np.int32)
        for j in range(int(length[0])):
            live = np.arange(int(np.searchsorted(-length, -j, side="left")))
            here = state[slot[live] + j]
            node = self.first[buf[begin[live] + j]]
            at = j
            while len(live):
                at += 1
                label = self.label_at[node]
                ok = np.flatnonzero(label >= 0)
                ok = ok[self.allowed(here[ok], label[ok])]
                to = slot[live[ok]] + at
                last[to] = label[ok]
                state[to] = self.state_of[label[ok]]
                on = length[live] > at
                live, here, node = live[on], here[on], node[on]
                if not len(live):
                    break
                key = node.astype(np.int64) * 256 + buf[begin[live] + at]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                on = self.keys[i] == key
                live, here, node = live[on], here[on], self.nodes[i[on]]
        end, live = length.copy(), np.arange(len(length))
        while len(live):
            label = last[slot[live] + end[live]]
            if (label < 0).any():
                raise ValueError("a position that no label reaches")
            yield live, label
            end[live] -= self.length[label]
            live = live[end[live] > 0]

    def _one(self, piece: bytes) -> list[int]:
        """The same walk for one long piece, in plain Python."""
        if not hasattr(self, "_step"):
            self._step = dict(zip(self.keys.tolist(), self.nodes.tolist(), strict=True))
            self._plain = self.label_at.tolist(), self.column_of.tolist(), self.state_of.tolist()
        step, (label_at, column_of, state_of) = self._step, self._plain
        n = len(piece)
        last = np.full(n + 1, -1, np.int32)
        state = np.zeros(n + 1, np.int32)
        for j in range(n):
            row = self.arcs[state[j]]
            node, at = 0, j
            while at < n:
                node = step.get(node * 256 + piece[at])
                if node is None:
                    break
                at += 1
                label = label_at[node]
                if label >= 0 and (row[column_of[label] >> 3] >> (column_of[label] & 7)) & 1:
                    last[at], state[at] = label, state_of[label]
        out = []
        while n:
            out.append(int(last[n]))
            n -= int(self.length[out[-1]])
        return out[::-1]

    def decode(self, ids) -> str:
        """Bytes of the labels, in order; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


def odd_code_points(path: str) -> np.ndarray:
    """Code points that regex counts as letters or digits and the library's
    pre-splitter does not: next to a letter (a digit) it cuts them off."""
    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    odd = []
    for kind, mate in ((r"\p{L}", "x"), (r"\p{N}", "1")):
        every = regex.findall(kind, "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000))
        for a in range(0, len(every), 4096):
            part = every[a : a + 4096]
            # "!" before each probe: a letter or digit then stands with its mate in one piece of two characters
            cuts = {begin for _, (begin, _) in split("".join("!" + mate + c for c in part))}
            odd += [ord(c) for i, c in enumerate(part) if 3 * i + 2 in cuts]
    return np.array(sorted(odd), np.int64)


class Encoder:
    """Encodes texts by an automaton. Equal pieces of a batch are walked once;
    nothing is kept from one batch to the next."""

    def __init__(self, automaton: Automaton):
        import re

        import regex

        self.auto = automaton
        self.split = regex.compile(PATTERN).findall
        white = " \\t-\\r"  # the same pattern where all characters are ASCII
        ascii_only = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{white}A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.split_ascii = re.compile(ascii_only.replace(r"\s", f"[{white}]").replace(r"\S", f"[^{white}]")).findall
        self.special = regex.compile("|".join(sorted(map(regex.escape, automaton.added), key=len, reverse=True))) if automaton.added else None
        self.odd = np.zeros(0x110000, bool)
        self.odd[automaton.odd] = True
        self.shown = list(map(str, range(len(automaton.labels))))

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(t in text for t in self.auto.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii(text)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        odd = self.odd[points]
        if not odd.any():
            return self.split(text)
        # split as if they were signs, then read the pieces from the text itself
        out, at = [], 0
        for p in self.split(np.where(odd, np.uint32(33), points).astype("<u4").tobytes().decode("utf-32-le")):
            out.append(text[at : at + len(p)])
            at += len(p)
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        split = [self.pieces(t) for t in texts]
        every = dict.fromkeys(chain.from_iterable(split))
        # an added token that was cut out is one label; as a piece it cannot come from the pattern
        added = [p for p in every if p in self.auto.added]
        plain = [p for p in every if p not in self.auto.added] if added else list(every)
        ids, count = self.auto.encode_pieces([p.encode() for p in plain])
        ids = np.concatenate([ids, np.array([self.auto.added[p] for p in added], np.int32)])
        count = np.concatenate([count, np.ones(len(added), np.int64)])
        begin = np.cumsum(count) - count
        every.update(zip(chain(plain, added), range(len(every))))
        piece = np.fromiter(map(every.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        n = count[piece]
        end = np.cumsum(n)
        out = ids[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(begin[piece] - end + n, n)]
        upto = np.concatenate([[0], end])[np.cumsum([0, *map(len, split)])].tolist()
        for a, b in zip(upto[:-1], upto[1:], strict=True):
            yield out[a:b].tolist()

    def show(self, ids: list[int]) -> str:
        """The ids as decimals joined by commas."""
        return ",".join(map(self.shown.__getitem__, ids))


def compile_automaton(path: str) -> Automaton:
    """The automaton of a tokenizer file. Its size depends on the file alone."""
    return Automaton(path)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have SIZE bytes or less together, or one text."""
    for batch in batches:
        size = np.array([len(t) if t else 0 for t in batch.column("text").to_pylist()], np.int64)
        run = np.cumsum(size)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(run, run[a] - size[a] + SIZE, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _rows(shared, schema: pa.Schema):
    full = schema is _IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        enc = Encoder(auto)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in _parts(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            got = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode_batch(texts), strict=True):
                back = auto.decode(ids)
                got.append((doc, ids, back) if full else (doc, len(ids), sha(enc.show(ids)), sha(back)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    return run


def _encode(docs: DataFrame, automaton: Automaton, schema: pa.Schema, kind: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # some 10 MB for 50,000 merges
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_rows(shared, schema), kind)


def encode_documents(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """Token ids of each document and the text decoded from them."""
    return _encode(docs, automaton, _IDS, "doc_id long, token_ids array<int>, decoded string")


def encode_digests(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """Token count, digest of the ids and of the decoded text of each document."""
    return _encode(docs, automaton, _DIGESTS, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
