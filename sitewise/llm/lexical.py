"""Ranked lexical search with bag deduplication.

Every document is ranked for each item of a query table by a BM25-like score in
64-bit integers (k1 = 0.8, b = 3/4 scaled by 100 and 1000):

    m     = 100 - 75 + (75 * n * N) div L
    score = sum over the item's terms, repeats included, of
            w * ((1000000000 * tf) div (1000 * tf + 8 * m)),
    w     = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))

1. One pass over the whole texts counts each document's terms and keeps those
   of the item vocabulary as a packed tf vector. The vocabulary is sent in
   blocks of ``VOCABULARY`` terms; matches by hash are verified on the bytes.
2. Documents with the same m and the same vector score alike on every item:
   they form one class, found by hash and verified by grouping on the vector.
   Document frequencies come from the classes and their sizes.
3. Classes are scored once against all items, in blocks of ``POSTINGS`` item
   terms; each task keeps the ``limit`` best classes of an item, a class ranked
   by score, then by its smallest doc_id. The first ``limit`` documents of an
   item lie in its first ``limit`` classes, so nothing else is expanded.
4. Members of the chosen classes are ranked by score, then by ascending doc_id.

Nothing is quadratic in a group of copies: a third of all rows with one text is
one class, of which at most ``limit`` members are listed.

Defined cases: a null text has no terms and counts for neither N nor L; rows that
share a doc_id are documents of their own; a null doc_id ranks behind all others
of its score; items that share an item_id are one item with the terms of all of
them; an item without terms, or whose terms no document holds, has no rows; an
empty table of documents or items gives an empty result; extra columns of either
table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.quantiles import ordered_prefix, row_index
from sitewise.llm.gate import gate, passes
from sitewise.llm.textbytes import byte_tables, text_chunks, words
from sitewise.session import checkpoint, shared_path

VOCABULARY = 1 << 18  # item terms sent to the tasks at once
POSTINGS = 1 << 18  # item terms scored at once
CELLS = 1 << 20  # scores (class, item) held at once

# Terms are runs of letters, digits and all bytes from 0x80 on; A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLES = byte_tables(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


# ------------------------------------------------------------------ vectors


class Vocabulary:
    """Terms of one block, sorted by hash, with their bytes for verification."""

    def __init__(self, terms: list[tuple[int, str]]):
        raw = [t.encode() for _, t in terms]
        size = np.array([len(r) for r in raw], np.int64)
        h, n, _ = words(np.frombuffer(b" ".join(raw), np.uint8), np.array([0, int(size.sum()) + max(len(raw) - 1, 0)]), _TABLES)
        if int(n.sum()) != len(raw):
            raise ValueError("a term that is not one term")
        order = np.argsort(h, kind="stable")
        self.hash, self.size = h[order], size[order]
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of one hash")
        self.id = np.array([i for i, _ in terms], np.int32)[order]
        self.bytes = np.frombuffer(b"".join(raw[i] for i in order.tolist()), np.uint8)
        self.begin = np.cumsum(self.size) - self.size

    def find(self, buf: np.ndarray, starts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of the words that are terms, their term ids)."""
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == h)
        at = at[hit]
        # compare the bytes of every hit with those of its term
        size = self.size[at]
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        own = np.repeat(starts[hit], size) + inner
        same = own < len(buf)
        same[same] = _FOLD[buf[own[same]]] == self.bytes[(np.repeat(self.begin[at], size) + inner)[same]]
        good = np.bincount(np.repeat(np.arange(len(hit)), size), weights=~same, minlength=len(hit)) == 0
        # a longer word of the same hash ends elsewhere
        end = starts[hit] + size
        inside = end < len(buf)
        nxt = np.zeros(len(hit), bool)
        nxt[inside] = ~_TABLES[1][buf[end[inside]]]
        # the next text may begin right behind the word
        good &= ~nxt | np.isin(end, starts)
        return hit[good], self.id[at[good]]


_VECTORS = "doc_id long, n long, vector binary"


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, buf, offsets in text_chunks(batch.column("text")):
                h, n, starts = words(buf, offsets, _TABLES)
                hit, term = vocabulary.find(buf, starts, h) if len(vocabulary.hash) else (np.empty(0, np.int64), np.empty(0, np.int32))
                doc = np.repeat(np.arange(len(n)), n)[hit]
                key, tf = np.unique(doc.astype(np.int64) << 32 | term, return_counts=True)
                pair = np.stack([(key & 0xFFFFFFFF).astype("<i4"), tf.astype("<i4")], axis=1)
                edge = np.searchsorted(key >> 32, np.arange(len(n) + 1))
                raw = [pair[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), pa.array(n.astype(np.int64)), pa.array(raw, pa.binary())], names=["doc_id", "n", "vector"])

    return run


def tf_vectors(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, n, vector) of every row: number of terms, and (term id, tf) pairs
    of the terms in ``terms`` (term_id, term), packed as 32-bit integers by id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = terms.count()
    blocks = []
    for a in range(0, max(size, 1), VOCABULARY):
        part = [tuple(r) for r in terms.where((F.col("term_id") >= a) & (F.col("term_id") < a + VOCABULARY)).collect()]
        blocks.append(spark.sparkContext.broadcast(Vocabulary(part)))
    if len(blocks) == 1:
        return rows.mapInArrow(_vectors(blocks[0]), _VECTORS)
    # several blocks: each gives its part of a row's vector, joined in order of the blocks
    path = shared_path(spark, "search-rows")
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    keyed = spark.read.parquet(path)
    out = keyed.select("row", "doc_id")
    for i, block in enumerate(blocks):
        part = keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_vectors(block), _VECTORS)
        out = out.join(part.select(F.col("doc_id").alias("row"), F.col("n"), F.col("vector").alias(f"v{i}")).drop(*([] if i == 0 else ["n"])), "row")
    return out.select("doc_id", "n", F.concat(*[f"v{i}" for i in range(len(blocks))]).alias("vector"))


# ------------------------------------------------------------------ classes


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, summed over the classes of a batch."""
    for batch in batches:
        raw = batch.column("vector").to_pylist()
        term = np.frombuffer(b"".join(raw), "<i4")[::2]
        weight = np.repeat(batch.column("size").to_numpy(zero_copy_only=False), [len(x) // 8 for x in raw])
        ids, at = np.unique(term, return_inverse=True)
        df = np.zeros(len(ids), np.int64)
        np.add.at(df, at, weight)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(df)], names=["term_id", "df"])


class Postings:
    """Items of one block: for each term of theirs the items that hold it, how
    often, and the term's weight."""

    def __init__(self, rows: pa.Table):
        item, term, times, weight = (rows.column(c).to_numpy().astype(np.int64) for c in ("item", "term_id", "times", "weight"))
        self.item, at = np.unique(item, return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.term, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(term))
        self.at, self.times = at[order], times[order]
        self.weight = weight[order][first]


def _best(rows: list[np.ndarray], limit: int) -> list[np.ndarray]:
    """The first ``limit`` rows of each item: (item, score, no_id, doc, class)."""
    item, score, none, doc, _ = rows
    order = np.lexsort((doc, none, -score, item))
    rows = [r[order] for r in rows]
    if len(order):
        first = np.concatenate([[True], rows[0][1:] != rows[0][:-1]])
        rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        rows = [r[rank < limit] for r in rows]
    return rows


_SCORES = "item long, score long, doc_id long, class_id long"


def _scores(shared, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        n_items = len(p.item)
        held = [np.empty(0, np.int64) for _ in range(5)]
        floor = np.zeros(n_items, np.int64)  # score of the last held class of a full item
        step = max(1, CELLS // n_items)
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                raw = batch.column("vector").to_pylist()
                pair = np.frombuffer(b"".join(raw), "<i4").reshape(-1, 2).astype(np.int64)
                row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
                at = np.minimum(np.searchsorted(p.term, pair[:, 0]), len(p.term) - 1)
                ours = p.term[at] == pair[:, 0]
                at, row, tf = at[ours], row[ours], pair[ours, 1]
                m = batch.column("m").to_numpy(zero_copy_only=False)[row]
                impact = p.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                n = p.first[at + 1] - p.first[at]
                post = np.arange(int(n.sum())) + np.repeat(p.first[at] - np.cumsum(n) + n, n)
                total = np.zeros(len(raw) * n_items, np.int64)
                np.add.at(total, np.repeat(row, n) * n_items + p.at[post], np.repeat(impact, n) * p.times[post])
                total = total.reshape(len(raw), n_items)
                row, item = np.nonzero((total > 0) & (total >= floor))
                if not len(row):
                    continue
                doc, ids = batch.column("doc_id"), batch.column("class_id").to_numpy(zero_copy_only=False)
                none = np.asarray(doc.is_null().to_numpy(zero_copy_only=False)).astype(np.int64)
                doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
                new = [item.astype(np.int64), total[row, item], none[row], doc[row], ids[row]]
                held = _best([np.concatenate(x) for x in zip(held, new, strict=True)], limit)
                full = np.flatnonzero(np.bincount(held[0], minlength=n_items) == limit)
                last = np.searchsorted(held[0], full, side="right") - 1
                floor[full] = held[1][last]
        yield pa.RecordBatch.from_arrays([
            pa.array(p.item[held[0]]), pa.array(held[1]), pa.array(held[3], pa.int64(), mask=held[2] == 1), pa.array(held[4])],
            names=["item", "score", "doc_id", "class_id"])

    return run


# ------------------------------------------------------------------ search


def _entries(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, term_id, times), (term_id, term), (item, item_id, block): ids are
    dense; a block of items has POSTINGS entries or one item."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    found = checkpoint(found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")))
    terms = checkpoint(row_index(found.select("term").distinct(), "term").select(F.col("_pos").alias("term_id"), "term"))
    sized = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    sized = sized.withColumns({"none": F.col("item_id").isNull(), "name": F.coalesce(F.col("item_id").cast("string"), F.lit(""))})
    numbered = row_index(sized, ["none", "name"]).withColumnRenamed("_pos", "item")
    names = ordered_prefix(numbered, "item", weight="size").select(
        "item", F.col("item_id").alias("name"), F.floor((F.col("_cum") - F.col("size")) / POSTINGS).cast("int").alias("block"))
    names = checkpoint(names)
    entries = found.join(terms, "term").join(names, F.col("item_id").eqNullSafe(F.col("name")))
    return entries.select("item", "block", "term_id", "times"), terms, names.withColumnRenamed("name", "item_id")


def _first(df: DataFrame, by: list[str], limit: int, *order) -> DataFrame:
    """The first rows of each group, with their rank; Spark drops the others of a
    task before it moves them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)


def search(docs: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the ``limit`` best documents of each item."""
    spark = docs.sparkSession
    entries, terms, names = _entries(items)

    path = shared_path(spark, "search-vectors")
    tf_vectors(docs, terms).where("n > 0").write.parquet(path)
    vectors = spark.read.parquet(path)
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()

    held = vectors.where(F.length("vector") > 0).withColumn("m", F.expr(f"25L + (75L * n * {n_docs}L) div {n_terms}L"))
    held = held.select("doc_id", "m", "vector", F.xxhash64("m", "vector").alias("hash"))
    same = ["hash", "m", "vector"]
    path = shared_path(spark, "search-classes")
    classes = held.groupBy(*same).agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("doc_id"))
    classes.withColumn("class_id", F.monotonically_increasing_id()).write.parquet(path)
    classes = spark.read.parquet(path)

    df = classes.select("vector", "size").mapInArrow(_frequencies, "term_id int, df long").groupBy("term_id").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighted = checkpoint(entries.join(df, "term_id").select("block", "item", "term_id", "times", weight.alias("weight")))
    best = None
    for b in [r[0] for r in weighted.select("block").distinct().collect()]:
        # POSTINGS rows of four numbers, or one item
        block = Postings(weighted.where(F.col("block") == b).select("item", "term_id", "times", "weight").toArrow())
        shared = spark.sparkContext.broadcast(block)
        got = classes.select("m", "vector", "doc_id", "class_id").mapInArrow(_scores(shared, limit), _SCORES)
        best = got if best is None else best.unionByName(got)
    if best is None:
        return names.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    by_doc = (F.desc("score"), F.asc_nulls_last("doc_id"))
    best = checkpoint(_first(best, ["item"], limit, *by_doc, F.asc("class_id")).select("item", "score", "class_id"))

    # members: the gate keeps rows of other classes out of the shuffle
    chosen = checkpoint(classes.join(best.select("class_id").distinct(), "class_id", "left_semi").select("class_id", *same))
    members = held.where(passes(held, F.col("hash"), gate(chosen, "hash")))
    members = _first(members, same, limit, F.asc_nulls_last("doc_id")).join(chosen, same).select("class_id", "doc_id")
    rows = _first(best.join(members, "class_id"), ["item"], limit, *by_doc, F.asc("class_id"))
    return rows.join(names.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


# The whole formula over an exploded term table.
ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
d AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM t WHERE len(w) > 0),
c AS (SELECT CAST(COUNT(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
tf AS (SELECT r, w, CAST(COUNT(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY 1, 2),
q AS (SELECT item_id, w, CAST(COUNT(*) AS BIGINT) AS k FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w
  FROM benchmark) GROUP BY 1, 2),
wt AS (SELECT w, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS wt
  FROM (SELECT w, COUNT(*) AS df FROM tf WHERE w IN (SELECT w FROM q) GROUP BY 1), c),
s AS (SELECT q.item_id, tf.r, CAST(sum(q.k * wt.wt * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * d.n * c.nd) // c.nt)))) AS BIGINT) AS score
  FROM q JOIN wt USING (w) JOIN tf USING (w) JOIN d ON d.r = tf.r, c GROUP BY 1, 2),
k AS (SELECT s.item_id, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id NULLS LAST) AS INTEGER) AS rank, d.doc_id, s.score
  FROM s JOIN d USING (r) WHERE s.score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
