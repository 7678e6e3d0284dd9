"""Conversation prefix trie by composable monoid fingerprints.

Every conversation c is rebuilt: the first h turns of its base conversation
(c - c % 20), h = crc32(c) % 4, then its own turns after the first h. Each
distinct sequence of first d rebuilt turns is a node of a trie.

1. A turn's fingerprint is a 64-bit hash t of (role, text). A sequence has the
   element (length, sum of t_i * B**i) modulo 2**64; elements form a monoid:
   (k, x) * (l, y) = (k + l, x + y * B**k). Turns are range-sorted by
   conversation and turn; each slice makes its prefix sums, the slices' totals
   are composed, so a conversation of any length is spread over tasks.
2. A rebuilt prefix is composed from the base's prefix and a difference of two of
   the conversation's own prefixes, shifted by a power of B. No rebuilt text is
   made: a row is (conversation, depth, fingerprint, turn reference).
3. Rows are grouped by (depth, fingerprint). All members of a group must have one
   parent fingerprint and one turn hash, and all turns of one hash one role and
   text: then, by induction over the depth, equal fingerprints are equal
   sequences. A violation starts again with another seed.
4. Subtree figures need no walk over the tree. A node is owned by its smallest
   member; the nodes that a conversation owns are the lower end of its path. So
   with W a path's running words, a node's subtree holds, for each member but the
   smallest, all words that member owns, and for the smallest those from the node
   down: sums over the members of a node, taken by a second grouping.
5. Ends of a node are listed in ascending order over range slices as chunks of
   text, and the chunks run through one SHA-256.

A conversation, a first turn, a parent or a group of copies may hold a third of
all rows: prefix sums are by slice, joins by conversation or parent are salted by
depth blocks or by hash, groups are aggregated before they are moved.

Defined cases: null role or text is empty; rows without conv_id are no
conversation and are left out; turns of one number are ordered by role, then by
the SHA-256 of the text; repeated rows are turns of their own; an empty table has
no node, not even a root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sitewise.session import checkpoint, shared_path

GROUP = 20  # conversations of one base
HEADS = 4  # heads have fewer turns than this
DEPTHS = 1 << 16  # rows of a conversation that one join key holds
SALTS = 1 << 10  # of a parent's children
CHUNK = 1 << 16  # bytes of a list of ends
WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# ------------------------------------------------------------------ fingerprint algebra


def power(n: np.ndarray, base: int = _BASE) -> np.ndarray:
    """base ** n modulo 2**64 by repeated squaring; negative n by the inverse."""
    n = np.asarray(n, np.int64)
    out = np.ones(len(n), _U)
    left = np.abs(n).astype(_U)
    b = np.where(n < 0, _U(pow(base, -1, 1 << 64)), _U(base))
    while left.any():
        out = np.where(left & _U(1) == 1, out * b, out)
        b = b * b
        left = left >> _U(1)
    return out


def _long(x) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _u(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(_U)


@F.pandas_udf(LongType())
def compose(x: pd.Series, y: pd.Series, k: pd.Series) -> pd.Series:
    """x + y * B**k."""
    return pd.Series(_long(_u(x) + _u(y) * power(k.to_numpy(np.int64))))


@F.pandas_udf(LongType())
def suffix(x: pd.Series, p: pd.Series, q: pd.Series, k: pd.Series) -> pd.Series:
    """x + (p - q) * B**k: a head followed by what p has beyond q."""
    return pd.Series(_long(_u(x) + (_u(p) - _u(q)) * power(k.to_numpy(np.int64))))


_PREFIX = "conv_id long, place long, sum long, t long, words long, run long"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position, prefix sum and running words of each turn inside its slice; rows
    come sorted by conversation and turn."""
    conv, place, total, run = None, 0, _U(0), 0
    for batch in batches:
        c, t, w = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("conv_id", "t", "words"))
        if len(c) == 0:
            continue
        first = np.concatenate([[True], c[1:] != c[:-1]])
        begin = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        goes_on = conv is not None and c[0] == conv
        before = np.zeros(len(begin), np.int64)
        before[0] = place if goes_on else 0
        pos = np.arange(len(c)) - begin[group] + 1 + before[group]
        x = np.cumsum(t.view(_U) * power(pos), dtype=_U)
        x = x - (x[begin] - t.view(_U)[begin] * power(pos[begin]))[group]
        y = np.cumsum(w)
        y = y - (y[begin] - w[begin])[group]
        if goes_on:
            x[group == 0] += total
            y[group == 0] += run
        conv, place, total, run = c[-1], int(pos[-1]), x[-1], int(y[-1])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c, pos, _long(x), t, w, y)], names=["conv_id", "place", "sum", "t", "words", "run"])


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Composes the totals of a conversation's slices, in order: what stands
    before each slice. One row per slice that the conversation begins before."""
    conv, place, total, run = None, 0, _U(0), 0
    for rows in batches:
        out = []
        for c, s, n, x, w in rows[["conv_id", "slice", "place", "sum", "run"]].itertuples(index=False):
            if c != conv:
                conv, place, total, run = c, 0, _U(0), 0
            if place:
                out.append((s, c, place, int(_long(np.array([total], _U))[0]), run))
            total = total + np.array([x], np.int64).view(_U)[0] * power(np.array([place]))[0]
            place, run = place + n, run + w
        yield pd.DataFrame(out, columns=["slice", "conv_id", "o_place", "o_sum", "o_run"])


def turn_prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """(conv_id, pos, sum, t, words, run) of every turn: 1-based position, prefix
    fingerprint, turn hash, words of the turn and running words."""
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    keys = turns.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), turn_hash(seed).alias("t"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    path = shared_path(spark, "trie-turns")
    cut = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t", "words")
    cut.mapInArrow(_prefixes, _PREFIX).withColumn("slice", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    # conversations of several slices: two slices' rows at least, so no more than there are slices
    parts = cut.groupBy("conv_id", "slice").agg(F.max_by(F.struct("place", "sum", "run"), "place").alias("end"))
    several = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ends = parts.join(several, "conv_id", "left_semi").select("conv_id", "slice", "end.*")
    ends = ends.repartition("conv_id").sortWithinPartitions("conv_id", "slice")
    before = checkpoint(ends.mapInPandas(_offsets, "slice int, conv_id long, o_place long, o_sum long, o_run long"))
    out = cut.join(before, ["slice", "conv_id"], "left")
    place = F.coalesce("o_place", F.lit(0))
    return out.select(
        "conv_id", (place + F.col("place")).alias("pos"),
        F.when(F.col("o_place").isNull(), F.col("sum")).otherwise(
            compose(F.coalesce("o_sum", F.lit(0)), F.col("sum"), place)).alias("sum"),
        "t", "words", (F.coalesce("o_run", F.lit(0)) + F.col("run")).alias("run"))


def turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role"), F.col("text"))


def _one_text_each(turns: DataFrame, seed: int) -> bool:
    """Whether all turns of one hash have one role and one text."""
    pair = F.struct("role", "text")
    seen = turns.groupBy(turn_hash(seed).alias("t")).agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"))
    return seen.where("lo <> hi").isEmpty()


# ------------------------------------------------------------------ rebuilt conversations


def _head_turns() -> Column:
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")


def _salted(table: DataFrame, depth: str) -> DataFrame:
    """One row per block of DEPTHS depths, up to the row's own."""
    return table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(depth) / DEPTHS))))


def _block(depth: str) -> Column:
    return F.floor(F.col(depth) / DEPTHS)


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows). Conversations: conv_id, depth, all_words and the
    fingerprint ``s`` of the whole rebuilt sequence. Rows: one for each turn of a
    rebuilt conversation, with the fingerprints of the prefix (s) and of its
    parent (p), the turn's hash and words and the running words."""
    spark = turns.sparkSession
    head = [F.max(F.when(F.col("pos") == i, F.struct("sum", "t", "words", "run"))).alias(f"h{i}") for i in range(1, HEADS)]
    mine = _head_turns()
    h = F.when(F.col("pos") == mine, F.struct("sum", "run"))
    own = turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max_by(F.struct("sum", "run"), "pos").alias("all"), F.max(h).alias("cut"), *head)
    own = own.withColumn("h", mine)
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[f"h{i}" for i in range(1, HEADS)])
    own = own.select("conv_id", "h", "n", "all", "cut", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    got = own.join(bases, "base", "left")
    k = F.least(F.col("h").cast("long"), F.coalesce("base_n", F.lit(0)))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("run"))
    got = got.withColumn("k", k)
    at = zero
    for i in range(1, HEADS):
        at = F.when(F.col("k") == i, F.struct(F.col(f"h{i}.sum").alias("sum"), F.col(f"h{i}.run").alias("run"))).otherwise(at)
    rest = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    got = got.withColumns({"head": at, "cut": F.when(F.col("n") <= F.col("h"), F.col("all")).otherwise(F.coalesce("cut", zero)), "rest": rest})
    got = got.select(
        "conv_id", "h", "k", "head", "cut", *[f"h{i}" for i in range(1, HEADS)], (F.col("k") + F.col("rest")).alias("depth"),
        (F.col("head.run") + F.col("all.run") - F.col("cut.run")).alias("all_words"),
        suffix(F.col("head.sum"), F.col("all.sum"), F.col("cut.sum"), F.col("k") - F.col("h")).alias("s"), "n")
    path = shared_path(spark, "trie-conversations")
    got.write.parquet(path)
    got = spark.read.parquet(path)

    tail = turns.withColumn("block", _block("pos")).join(
        _salted(got.select("conv_id", "h", "k", "head", "cut", "n", "all_words"), "n"), ["conv_id", "block"]).where("pos > h")
    tail = tail.select(
        "conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("d"),
        suffix(F.col("head.sum"), F.col("sum"), F.col("cut.sum"), F.col("k") - F.col("h")).alias("s"),
        "t", "words", (F.col("head.run") + F.col("run") - F.col("cut.run")).alias("run"), "all_words")
    front = got.select("conv_id", "k", "all_words", F.posexplode(F.array(*[f"h{i}" for i in range(1, HEADS)])).alias("i", "turn"))
    front = front.where("i < k").select(
        "conv_id", (F.col("i") + 1).cast("long").alias("d"), F.col("turn.sum").alias("s"), F.col("turn.t").alias("t"),
        F.col("turn.words").alias("words"), F.col("turn.run").alias("run"), "all_words")
    root = got.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("d", "s", "t", "words", "run")], "all_words")
    # the parent's fingerprint is the prefix without its last turn: s - t * B**d
    rows = tail.unionByName(front).unionByName(root)
    rows = rows.withColumn("p", suffix(F.col("s"), F.lit(0).cast("long"), F.col("t"), F.col("d")))
    path = shared_path(spark, "trie-rows")
    rows.write.parquet(path)
    return got.select("conv_id", "depth", "all_words", "s"), spark.read.parquet(path)


# ------------------------------------------------------------------ ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends of each node as comma-joined text, in chunks of CHUNK bytes; rows
    come sorted by node and conversation."""
    held: list = [None, None, 0]  # node, first end, bytes
    parts: list[str] = []

    def flush():
        return (*held[0], held[1], ",".join(parts))

    for batch in batches:
        out = []
        for d, s, c in zip(*(batch.column(x).to_pylist() for x in ("d", "s", "conv_id")), strict=True):
            if held[0] != (d, s) or held[2] >= CHUNK:
                if parts:
                    out.append(flush())
                held[0], held[1], held[2] = (d, s), c, 0
                parts.clear()
            parts.append(str(c))
            held[2] += len(parts[-1]) + 1
        if out:
            yield _chunk_batch(out)
    if parts:
        yield _chunk_batch([flush()])


def _chunk_batch(rows) -> pa.RecordBatch:
    d, s, c, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(c, pa.int64()), pa.array(x, pa.string())], names=["d", "s", "first", "chunk"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each node; one chunk in memory at a time."""
    node, sha = None, None
    for batch in batches:
        out = []
        for d, s, x in zip(*(batch.column(c).to_pylist() for c in ("d", "s", "chunk")), strict=True):
            if node == (d, s):
                sha.update(b"," + x.encode())
                continue
            if node is not None:
                out.append((*node, sha.hexdigest()))
            node, sha = (d, s), hashlib.sha256(x.encode())
        if out:
            yield _digest_batch(out)
    if node is not None:
        yield _digest_batch([(*node, sha.hexdigest())])


def _digest_batch(rows) -> pa.RecordBatch:
    d, s, x = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.string())], names=["d", "s", "ends_sha256"])


def end_digests(convs: DataFrame) -> DataFrame:
    """(d, s, ends_sha256) of the nodes where a conversation ends."""
    ends = convs.select(F.col("depth").alias("d"), "s", "conv_id")
    ends = ends.repartitionByRange("d", "s", "conv_id").sortWithinPartitions("d", "s", "conv_id")
    chunks = ends.mapInArrow(_chunks, "d long, s long, first long, chunk string")
    chunks = chunks.repartition("d", "s").sortWithinPartitions("d", "s", "first")
    return chunks.mapInArrow(_digests, "d long, s long, ends_sha256 string")


# ------------------------------------------------------------------ trie


def prefix_trie(conversations: DataFrame, seed: int = 1) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    while not _one_text_each(turns, seed):
        seed += 1
    prefixes = checkpoint(turn_prefixes(turns, seed))
    convs, rows = rebuilt(prefixes, turns)

    nodes = rows.groupBy("d", "s").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("all_words").alias("sum_words"),
        F.min("words").alias("words"), F.min("run").alias("run"), F.min("p").alias("p"), F.max("p").alias("p_hi"),
        F.min("t").alias("t"), F.max("t").alias("t_hi"))
    path = shared_path(spark, "trie-nodes")
    nodes.write.parquet(path)
    nodes = spark.read.parquet(path)
    if not nodes.where("p <> p_hi or t <> t_hi").isEmpty():
        return prefix_trie(conversations, seed + 1)

    # the top of each conversation's own nodes, and the words that stand above it
    tops = nodes.groupBy("conv_id").agg(F.min_by(F.struct("d", "p", (F.col("run") - F.col("words")).alias("above")), "d").alias("top"))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))
    tops = checkpoint(tops.select("conv_id", F.col("top.d").alias("top"), F.col("top.p").alias("p"), F.col("top.above").alias("above"), salt.alias("salt")))
    # children that hang on another conversation's node: counted by parent and salt, then by parent
    kids = checkpoint(tops.where("top > 0").groupBy((F.col("top") - 1).alias("d"), F.col("p").alias("s"), "salt").agg(F.count(F.lit(1)).alias("kids")))
    parents = kids.join(nodes.select("d", "s", F.col("conv_id").alias("parent")), ["d", "s"]).drop("kids")
    up = tops.withColumns({"d": F.col("top") - 1, "s": F.col("p")}).join(parents, ["d", "s", "salt"], "left")
    up = up.select("conv_id", "top", "above", "parent")

    # what each conversation owns: words, and the leaf at its end if no other node hangs there
    kids = kids.groupBy("d", "s").agg(F.sum("kids").alias("kids"))
    owner = convs.join(up, "conv_id", "left").withColumn("owned", F.when(F.col("top").isNull(), 0).otherwise(F.col("all_words") - F.col("above")))
    with_kids = kids.select(F.col("d").alias("depth"), "s", F.lit(1).alias("inner"))
    owner = owner.join(with_kids, ["depth", "s"], "left")
    leaf = F.when(F.col("top").isNotNull() & F.col("inner").isNull(), 1).otherwise(0).cast("long")
    owner = checkpoint(owner.select("conv_id", "depth", "all_words", "top", "parent", "owned", leaf.alias("leaf")))

    share = _salted(owner.where("owned > 0 or leaf > 0").select("conv_id", "owned", "leaf", "depth"), "depth").drop("depth")
    sums = rows.select("conv_id", "d", "s", _block("d").alias("block")).join(share, ["conv_id", "block"]).groupBy("d", "s").agg(
        F.sum("owned").alias("owned_all"), F.sum("leaf").alias("n_leaves"))
    own = _salted(owner.select("conv_id", "depth", "all_words", "top", "parent", "owned"), "depth")
    out = nodes.withColumn("block", _block("d")).join(own, ["conv_id", "block"]).join(sums, ["d", "s"], "left").join(kids, ["d", "s"], "left")
    out = out.join(end_digests(convs), ["d", "s"], "left")
    above = F.col("run") - F.col("words")
    below = F.coalesce("owned_all", F.lit(0)) - F.col("owned") + F.col("all_words") - above
    return out.select(
        "conv_id", F.col("d").alias("depth"),
        F.when(F.col("d") == 0, F.lit(None)).when(F.col("d") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).cast("long").alias("parent_conv_id"),
        "n_convs", ((F.col("depth") > F.col("d")).cast("long") + F.coalesce("kids", F.lit(0))).alias("n_children"),
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.col("sum_words") - F.col("n_convs") * above - below).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


# Rebuilt sequences as lists of turns; every prefix is a node.
ORACLE = r"""
WITH RECURSIVE step AS (
  SELECT n, 0 AS i, n AS v FROM (SELECT unnest(range(256))::BIGINT AS n)
  UNION ALL SELECT n, i + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE i < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM step WHERE i = 8),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(turn ORDER BY pos) AS turns FROM o GROUP BY 1),
b AS (SELECT conv_id, turns, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM l),
h AS (SELECT conv_id, turns, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a & 255, x) + 1)::INT])), 4294967295) % 4 AS INT) AS h FROM b, tab),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(x.turns, 1, h.h), []), coalesce(list_slice(h.turns, h.h + 1, len(h.turns)), [])) AS turns
  FROM h LEFT JOIN l x ON x.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r),
p AS (SELECT conv_id, CAST(d AS BIGINT) AS d, list_slice(turns, 1, d) AS path, len(turns) = d AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM m),
n AS (SELECT path, d, min(conv_id) AS c, CAST(COUNT(*) AS BIGINT) AS n, min(w) AS w,
    sha256(coalesce(string_agg(CAST(CASE WHEN ends THEN conv_id END AS VARCHAR), ',' ORDER BY conv_id), '')) AS e FROM p GROUP BY 1, 2),
up AS (SELECT k.path, k.d, k.c, q.path AS top, q.c AS top_c FROM n k JOIN n q ON q.d = k.d - 1 AND q.path = list_slice(k.path, 1, k.d - 1)),
kids AS (SELECT top AS path, CAST(COUNT(*) AS BIGINT) AS kids FROM up GROUP BY 1),
a AS (SELECT k.path, k.n, k.w, kids.kids IS NULL AS leaf, unnest(range(0, k.d + 1)) AS i FROM n k LEFT JOIN kids ON kids.path = k.path),
s AS (SELECT list_slice(path, 1, i) AS path, CAST(sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS BIGINT) AS leaves, CAST(sum((n - 1) * w) AS BIGINT) AS saved FROM a GROUP BY 1)
SELECT n.c AS conv_id, n.d AS depth, up.top_c AS parent_conv_id, n.n AS n_convs, coalesce(kids.kids, 0) AS n_children, s.leaves AS n_leaves,
  s.saved AS saved_tokens, n.e AS ends_sha256
FROM n JOIN s ON s.path = n.path LEFT JOIN up ON up.path = n.path LEFT JOIN kids ON kids.path = n.path
"""
