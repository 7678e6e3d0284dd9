"""N-gram Jaccard join: grouped prefix join on word shingles.

A document's set holds the 64-bit hashes of its distinct shingles of ``SIZE``
words (A-Z lower-cased; with fewer words the whole sequence is one shingle).
Two documents link when 100 * |A & B| >= PERCENT * |A | B|.

1. Shingles are ordered from rare to frequent by a frequency sketch of fixed
   size (``SLOTS`` counters over all documents), ties by hash. The order only
   decides how many candidates there are, never which links are found.
2. A set's prefix are its first n - ceil(0.8 n) + 1 shingles: two sets that
   link share a prefix shingle. Documents with equal prefix and size form one
   group; inside it equal sets form one member.
3. Groups that share a prefix shingle are candidates if size and position allow
   enough common shingles. First each group meets the pivots (smallest group)
   of its shingles' lists; links found this way are joined to components. Then
   the lists are gone through again and all candidates of different components
   are paired, so a large family of copies is not paired with itself, and no
   link between components is missed.
4. Candidate groups are expanded to their members, members filtered by a parity
   bitmap (a lower bound of the symmetric difference), and verified on the
   whole texts.

Defined cases: null and empty texts and texts without words have the empty set
and link with nothing; rows without doc_id are no part of a component (null);
rows that share a doc_id count as one document; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.llm.gate import gate, passes
from sitewise.llm.textbytes import LEAN, mix, text_chunks, words
from sitewise.session import checkpoint, shared_path

SIZE, PERCENT = 5, 80
SLOTS = 1 << 22  # counters of the sketch
BLOCKS = 256  # of the sketch
PARITY = 16  # 64-bit words of the parity bitmap
PIVOTS = 2  # pivots a group meets in the first pass
PAIR_BLOCK = 512
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    h, n, _ = words(buf, offsets)
    out = []
    if len(h) >= size:
        g = h[: len(h) - size + 1].copy()
        for j in range(1, size):
            g = g * _MUL + h[j : len(h) - size + 1 + j]
        g = mix(g)
    end = 0
    for c in n.tolist():
        begin, end = end, end + c
        if c >= size:
            s = np.sort(g[begin : end - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            x = h[begin:end]
            whole = x[:1] + _U(c)
            for j in range(1, c):
                whole = whole * _MUL + x[j : j + 1]
            out.append(mix(whole + _U(1)))
        else:
            out.append(np.empty(0, _U))
    return out


def needed(n1, n2, percent: int = PERCENT):
    """Least number of common shingles of linked sets of these sizes."""
    return (percent * (n1 + n2) + 99 + percent) // (100 + percent)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: Python objects of one slice at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


# ------------------------------------------------------------------ sketch


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.uint32)
    shift = _U(64 - (SLOTS.bit_length() - 1))
    for batch in batches:
        for _, buf, offsets in text_chunks(batch.column("text"), LEAN):
            sets = shingles(buf, offsets)
            if sets:
                slot = (np.concatenate(sets) >> shift).astype(np.int64)
                np.add.at(total, slot, 1)
    part = SLOTS // BLOCKS
    rows = [(i, zlib.compress(total[i * part : (i + 1) * part].tobytes(), 1)) for i in range(BLOCKS)] if total.any() else []
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "part"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.uint32)
            sums[i] = np.minimum(sums[i].astype(np.uint64) + x, 0xFFFFFFFF).astype(np.uint32) if i in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "part"])


def frequency_sketch(rows: DataFrame) -> np.ndarray:
    """Counters of the documents' shingles: SLOTS numbers, whatever the input."""
    kind = "block int, part binary"
    got = rows.select("text").mapInArrow(_sketch, kind).repartition("block").mapInArrow(_add_blocks, kind).collect()
    out = np.zeros(SLOTS, np.uint32)
    part = SLOTS // BLOCKS
    for r in got:
        out[r["block"] * part : (r["block"] + 1) * part] = np.frombuffer(zlib.decompress(bytes(r["part"])), np.uint32)
    return out


# ------------------------------------------------------------------ sets and groups

_SETS = "doc_id long, n int, sig1 long, sig2 long, psig long, prefix binary, parity array<long>"
_SETS_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int32()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("psig", pa.int64()),
    ("prefix", pa.binary()), ("parity", pa.list_(pa.int64())),
])


def parity(s: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of shingles falls on i."""
    bits = np.bincount((s & _U(PARITY * 64 - 1)).astype(np.int64), minlength=PARITY * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = counts.value
        shift = _U(64 - (SLOTS.bit_length() - 1))
        for batch in _slices(batches):
            out = {c: [] for c in _SETS_ARROW.names}
            docs = batch.column("doc_id").to_pylist()
            at = 0
            for _, buf, offsets in text_chunks(batch.column("text"), LEAN):
                for s in shingles(buf, offsets):
                    n = len(s)
                    out["doc_id"].append(docs[at])
                    at += 1
                    out["n"].append(n)
                    if n == 0:
                        for c in ("sig1", "sig2", "psig"):
                            out[c].append(0)
                        out["prefix"].append(b"")
                        out["parity"].append([0] * PARITY)
                        continue
                    order = np.argsort(sketch[(s >> shift).astype(np.int64)], kind="stable")
                    prefix = s[order[: prefix_length(n)]]
                    sums = [s.sum(), mix(s + _MUL).sum(), mix(prefix + _U(5)).sum()]
                    for c, v in zip(("sig1", "sig2", "psig"), mix(np.array(sums, dtype=_U)).view(np.int64).tolist(), strict=True):
                        out[c].append(v)
                    out["prefix"].append(prefix.tobytes())
                    out["parity"].append(parity(s).tolist())
            yield pa.RecordBatch.from_pydict(out, schema=_SETS_ARROW)

    return run


_POSTING = "token long, gid long, n int, pos int"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gid, n = batch.column("gid").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
        lists = [np.frombuffer(x, np.int64) for x in batch.column("prefix").to_pylist()]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        begin = np.cumsum(size) - size
        for a in range(0, len(lists), 1000):
            part = slice(a, a + 1000)
            sz = size[part]
            total = int(sz.sum())
            pos = np.arange(total) - np.repeat(begin[part] - begin[a], sz)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(lists[part])), pa.array(np.repeat(gid[part], sz)),
                pa.array(np.repeat(n[part], sz).astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "gid", "n", "pos"])


_SHARED = _POSTING + ", pivot long, pivot_n int, pivot_pos int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings, sorted by token and gid, of tokens that two groups or more
    have, each with the first posting of its token. One row is held over."""
    held = None  # last row of the batch before, and the first row of its token
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "gid", "n", "pos")]
        if held is not None:
            cols = [np.concatenate([[h], c]) for h, c in zip(held[0], cols, strict=True)]
        token = cols[0]
        if len(token) == 0:
            continue
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        run = np.flatnonzero(first)[np.cumsum(first) - 1]
        pivot = [c[run].copy() for c in cols[1:]]
        begun = held is not None and held[2]
        if held is not None:
            same = run == 0
            for p, v in zip(pivot, held[1], strict=True):
                p[same] = v
        size = np.diff(np.append(np.flatnonzero(first), len(token)))
        many = np.repeat(size > 1, size)
        if begun:
            many[run == 0] = True
        held = (tuple(c[-1] for c in cols), tuple(p[-1] for p in pivot), bool(many[-1]))
        keep = many[:-1]
        if keep.any():
            yield _shared_batch([c[:-1][keep] for c in [*cols, *pivot]])
    if held is not None and held[2]:
        yield _shared_batch([np.array([v]) for v in (*held[0], *held[1])])


def _shared_batch(cols) -> pa.RecordBatch:
    kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32)
    names = ["token", "gid", "n", "pos", "pivot", "pivot_n", "pivot_pos"]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds, strict=True)], names=names)


def _can_link(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Size and position filter at a common token."""
    most = F.least(n1 - p1, n2 - p2)
    least = F.floor((F.lit(PERCENT) * (n1 + n2) + 99 + PERCENT) / F.lit(100 + PERCENT))
    return (100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)) & (most >= least)


_PAIR = "g1 long, g2 long"


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups of different components in each token's list, after the
    size and position filters. Rows come sorted by token and size; a list is
    gone through in blocks against the rows that its sizes reach."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "gid", "n", "pos", "comp", "mixed")]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        token = cols[0]
        if len(token) == 0:
            continue
        last = int(np.flatnonzero(token == token[-1])[0])
        yield from _cross_lists([c[:last] for c in cols])
        held = [c[last:] for c in cols]
    if held is not None:
        yield from _cross_lists(held)


def _cross_lists(cols) -> Iterator[pa.RecordBatch]:
    token = cols[0]
    if len(token) == 0:
        return
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    out1, out2, size = [], [], 0
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        gid, n, pos, comp, mixed = (c[a:b] for c in cols[1:])
        if not mixed.any() and (comp == comp[0]).all():
            continue
        for i in range(0, b - a, PAIR_BLOCK):
            rows = slice(i, i + PAIR_BLOCK)
            reach = int(np.searchsorted(n, n[rows][-1] * 100 // PERCENT, side="right"))
            for j in range(i, reach, PAIR_BLOCK):
                x, y = np.arange(i, min(i + PAIR_BLOCK, b - a))[:, None], np.arange(j, min(j + PAIR_BLOCK, reach))[None, :]
                ok = (x < y) & ((comp[x] != comp[y]) | mixed[x] | mixed[y]) & (100 * n[x].astype(np.int64) >= PERCENT * n[y].astype(np.int64))
                ok &= np.minimum(n[x] - pos[x], n[y] - pos[y]) >= needed(n[x].astype(np.int64), n[y].astype(np.int64))
                p, q = np.nonzero(ok)
                if len(p):
                    g, h = gid[i + p], gid[j + q]
                    out1.append(np.minimum(g, h))
                    out2.append(np.maximum(g, h))
                    size += len(p)
                if size > 100_000:
                    yield _pairs(out1, out2)
                    out1, out2, size = [], [], 0
    if size:
        yield _pairs(out1, out2)


def _pairs(out1, out2) -> pa.RecordBatch:
    g = np.unique(np.stack([np.concatenate(out1), np.concatenate(out2)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(g[:, 0]), pa.array(g[:, 1])], names=["g1", "g2"])


# ------------------------------------------------------------------ verification


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = lambda t: shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    last, s = None, None
    for batch in _slices(batches):
        keep_a, keep_b = [], []
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            if last != ta:
                last, s = ta, one(ta)
            t = one(tb)
            both = len(s) + len(t) - len(np.union1d(s, t))
            if len(s) and 100 * both >= PERCENT * (len(s) + len(t) - both):
                keep_a.append(a)
                keep_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts link. Only texts that the gate of
    the pairs' ids lets through are moved."""
    ids = checkpoint(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    some = rows.where(passes(rows, F.xxhash64("doc_id"), gate(ids.select(F.xxhash64("id").alias("h")), "h")))
    some = some.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text").distinct()
    path = shared_path(rows.sparkSession, "join-texts")
    some.write.parquet(path)
    some = rows.sparkSession.read.parquet(path)
    both = pairs.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return checkpoint(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long").distinct())


def expand(pairs: DataFrame, members: DataFrame, which) -> DataFrame:
    """Member pairs of group pairs, filtered by size-exact parity bounds."""
    one = members.select(F.col("gid").alias("g1"), F.col("rep").alias("r1"), F.col("n").alias("n1"), F.col("parity").alias("b1"), F.col("comp").alias("c1"))
    two = members.select(F.col("gid").alias("g2"), F.col("rep").alias("r2"), F.col("n").alias("n2"), F.col("parity").alias("b2"), F.col("comp").alias("c2"))
    out = pairs.join(one, "g1").join(two, "g2").where(which)
    least = F.floor((F.lit(PERCENT) * (F.col("n1") + F.col("n2")) + 99 + PERCENT) / F.lit(100 + PERCENT))
    differ = F.aggregate(F.zip_with("b1", "b2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    out = out.where(differ <= F.col("n1") + F.col("n2") - 2 * least)
    return out.select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b")).where("a < b").distinct()


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every id in edges (a, b): comp is the smallest id reached.

    Alternating large and small stars: each round hangs neighbours on the
    smallest of a neighbourhood until nothing changes."""
    e = checkpoint(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("x")), F.struct(F.col("v").alias("x")))).alias("s"), "m").select(F.col("s.x").alias("u"), F.col("m").alias("v"))
        after = checkpoint(small.where("u <> v").distinct())
        # a star forest maps to itself: done when every id hangs on one root that hangs on none
        roots = after.select(F.col("v").alias("root")).distinct()
        left = after.join(roots, F.col("u") == F.col("root"), "left_semi").limit(1).count()
        many = after.groupBy("u").count().where("count > 1").limit(1).count()
        e = after
        if not left and not many:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


# ------------------------------------------------------------------ join


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("id").alias("rep"), F.col("comp").alias("_c"))
    return members.drop("comp").join(found, "rep", "left").withColumn("comp", F.coalesce("_c", "rep")).drop("_c")


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = spark.sparkContext.broadcast(frequency_sketch(rows))
    path = shared_path(spark, "join-sets")
    rows.mapInArrow(_sets(counts), _SETS).write.parquet(path)
    sets = spark.read.parquet(path)
    real = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    members = checkpoint(real.groupBy("psig", "n", "sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.first("parity").alias("parity")))
    groups = real.groupBy("psig", "n").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix"))
    names = members.groupBy("psig", "n").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("size"))
    # groups of fewer than 4 shingles hold equal sets only
    lists = groups.where("n >= 4").select("gid", "n", "prefix").mapInArrow(_postings, _POSTING)
    lists = lists.repartition("token").sortWithinPartitions("token", "gid").mapInArrow(_shared, _SHARED)
    path = shared_path(spark, "join-lists")
    lists.write.parquet(path)
    lists = spark.read.parquet(path)

    members = checkpoint(members.join(names, ["psig", "n"]).select("gid", "rep", "n", "sig1", "sig2", "parity", "size", F.col("rep").alias("comp")))
    met = lists.where((F.col("gid") != F.col("pivot")) & _can_link(F.col("n"), F.col("pos"), F.col("pivot_n"), F.col("pivot_pos")))
    met = met.groupBy(F.col("gid").alias("g2"), F.col("pivot").alias("g1")).agg(F.count(F.lit(1)).alias("common"))
    best = F.row_number().over(Window.partitionBy("g2").orderBy(F.desc("common"), "g1"))
    met = met.withColumn("_k", best).where(F.col("_k") <= PIVOTS).select("g1", "g2")
    leader = (F.col("r1") == F.col("g1")) | (F.col("r2") == F.col("g2"))
    own = members.where("size > 1").select(F.col("gid").alias("g1"), F.col("gid").alias("g2")).distinct()
    links = verified(rows, checkpoint(expand(met.unionByName(own), members, leader)))
    found = components(links)

    members = checkpoint(_with_components(members, found))
    shown = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    shown = shown.select("gid", F.col("lo").alias("comp"), (F.col("lo") != F.col("hi")).alias("mixed"))
    mixed = shown.where("mixed").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    crossed = lists.select("token", "gid", "n", "pos").join(shown, "gid")
    # lists of one component need no second look: a family of copies is not dealt out by its shingles
    open_lists = crossed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("mixed").alias("mixed"))
    open_lists = open_lists.where("lo <> hi or mixed").select("token")
    crossed = crossed.join(open_lists, "token", "left_semi")
    crossed = crossed.repartition("token").sortWithinPartitions("token", "n", "gid").mapInArrow(_cross, _PAIR).distinct()
    more = checkpoint(expand(crossed.unionByName(mixed), members, F.col("c1") != F.col("c2")))
    if not more.isEmpty():
        links = links.union(verified(rows, more))
        found = components(links)
    members = _with_components(members, found)

    keys = ["n", "sig1", "sig2"]
    out = sets.select("doc_id", *keys).join(members.select(*keys, F.col("comp")), keys, "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "doc_id")).cast("long")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), comp.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: that with the smallest doc_id; rows that
    share this id are all kept, as are rows without an id. All columns stay."""
    found = link_documents(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


# All pairs that share a shingle, and what is reached over their links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(seen) AS c FROM r GROUP BY 1) m ON m.id = w.doc_id
"""
