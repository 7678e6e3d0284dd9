"""Chat formatting with offset-aligned loss masks.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``. Conversations
are rendered whole, encoded once with offsets, and the sorted spans of the
trained turns are intersected with the token spans by binary search: a token is
under the loss mask when its span lies in a trained turn's text. The four
marks are single tokens of the encoder, which splits at them first, so no token
straddles the edge of a text.

Escape inside roles and texts, reversible: a backslash is doubled, and a
backslash is put after the first character of every control string (``CONTROL``).
Reading back: a doubled backslash is one, a single one is dropped.

Long conversations: turns are gathered in blocks of ``TURNS_PER_BLOCK`` turn
numbers, each block is streamed and rendered in pieces that end at a turn
(``PIECE_CHARS``). Since the encoder splits at the marks, the pieces' tokens in
order are those of the whole conversation; nearly all have one piece. A hot
conversation is so spread over tasks and held in bounded memory.

Defined cases: a null text is empty, a null role is the empty role, a null turn
sorts first, equal turns sort by role and text, a null conv_id is one
conversation with a null id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of common chat templates, escaped inside texts.
CONTROL = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TURNS_PER_BLOCK = 256
PIECE_CHARS = 1 << 20
TRAINED = ("assistant",)

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    while True:
        # repeated, as a mark may begin inside one that was found before it
        out = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if out == text:
            return out
        text = out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def encoder(path: str) -> Callable[[str], tuple[list[int], np.ndarray]]:
    """text -> (ids, offsets in code points) of a byte-level BPE file, with the
    marks added as single tokens."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)

    def run(text: str):
        e = t.encode(text, add_special_tokens=False)
        return e.ids, np.array(e.offsets, dtype=np.int64).reshape(-1, 2)

    return run


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """(rendered text, span of each turn's text in it)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def read_back(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(rendered)]


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token, whether its span lies in one of the sorted spans."""
    if len(spans) == 0 or len(offsets) == 0:
        return np.zeros(len(offsets), dtype=bool)
    at = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    own = spans[np.maximum(at, 0)]
    return (at >= 0) & (offsets[:, 1] <= own[:, 1]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(rendered: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """Text under the mask, unescaped; tokens of one split character share its span."""
    out = []
    lo = hi = None
    for a, b in offsets[mask].tolist():
        if lo is not None and a <= hi:
            hi = max(hi, b)
        else:
            if lo is not None:
                out.append(unescape(rendered[lo:hi]))
            lo, hi = a, b
    if lo is not None:
        out.append(unescape(rendered[lo:hi]))
    return "".join(out)


# ------------------------------------------------------------------ on a table

_PIECE = "conv_id long, block long, piece long, rendered string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def _pieces(path: str, trained: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        key, turns, size, piece, out = None, [], 0, 0, []

        def flush():
            nonlocal turns, size, piece
            if not turns:
                return
            text, spans = render(turns)
            ids, offsets = encode(text)
            keep = np.array([r in trained for r, _ in turns], dtype=bool)
            mask = loss_mask(offsets, spans[keep])
            out.append({
                "conv_id": key[0], "block": key[1], "piece": piece, "rendered": text, "token_ids": ids,
                "token_starts": offsets[:, 0].tolist(), "token_ends": offsets[:, 1].tolist(), "loss_mask": mask.tolist(),
            })
            piece += 1
            turns, size = [], 0

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "block", "role", "text")]
            for conv, block, role, text in zip(*cols, strict=True):
                if (conv, block) != key:
                    flush()
                    key, piece = (conv, block), 0
                turns.append((role, text))
                size += len(text)
                if size >= PIECE_CHARS:
                    flush()
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)
                    out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)

    return run


_PIECE_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("piece", pa.int64()), ("rendered", pa.string()),
    ("token_ids", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int32())), ("token_ends", pa.list_(pa.int32())),
    ("loss_mask", pa.list_(pa.bool_())),
])


def format_conversations(turns: DataFrame, tokenizer: str, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Rendered text, token ids, token spans and loss mask of each conversation
    (one row per piece, nearly always one)."""
    block = F.floor(F.col("turn") / F.lit(TURNS_PER_BLOCK))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(block, F.lit(-(1 << 62))).cast("long").alias("block"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return rows.select("conv_id", "block", "role", "text").mapInArrow(_pieces(tokenizer, trained), _PIECE)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
_DIGEST_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64()),
])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, now, started = None, None, False

    def row():
        return {"conv_id": key, "turns_sha256": now["turns"].hexdigest(), "loss_sha256": now["loss"].hexdigest(),
                **{c: now[c] for c in ("n_turns", "loss_chars", "formatted_chars", "n_tokens", "n_loss_tokens")}}

    for batch in batches:
        out = []
        names = ("conv_id", "rendered", "token_starts", "token_ends", "loss_mask")
        for conv, text, starts, ends, mask in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            if not started or conv != key:
                if started:
                    out.append(row())
                key, started = conv, True
                now = {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n_turns": 0, "loss_chars": 0,
                       "formatted_chars": 0, "n_tokens": 0, "n_loss_tokens": 0}
            for role, body in read_back(text):
                now["turns"].update(f"{role}\n{body}\n".encode())
                now["n_turns"] += 1
            m = np.array(mask, dtype=bool)
            spans = np.stack([np.array(starts, np.int64), np.array(ends, np.int64)], axis=1).reshape(-1, 2)
            under = masked_text(text, spans, m)
            now["loss"].update(under.encode())
            now["loss_chars"] += len(under)
            now["formatted_chars"] += len(text)
            now["n_tokens"] += len(m)
            now["n_loss_tokens"] += int(m.sum())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST_ARROW)
    if started:
        yield pa.RecordBatch.from_pylist([row()], schema=_DIGEST_ARROW)


def digests(pieces: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted output, per conversation."""
    rows = pieces.select("conv_id", "block", "piece", "rendered", "token_starts", "token_ends", "loss_mask")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")
    return rows.select("conv_id", "rendered", "token_starts", "token_ends", "loss_mask").mapInArrow(_digest, _DIGEST)


# What must come back from the formatted output, straight from the table; the
# length of the output from the template's marks and the escapes' number.
_ANY = "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)).replace("'", "''")


def _escaped_sql(col: str) -> str:
    return f"(length({col}) + length({col}) - length(replace({col}, chr(92), '')) + len(regexp_extract_all({col}, '{_ANY}')))"


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, COUNT(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM({len(START) + len(SEP) + len(END)} + {_escaped_sql("role")} + {_escaped_sql("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
