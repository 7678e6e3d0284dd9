"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. In
each window of ``window`` words the smallest of its k-gram hashes is its
fingerprint (k = window // 2 + 1), so a window shared by a document and an item
has the same fingerprint on both sides and no shared span of ``window`` words
is missed. Document fingerprints are joined with those of the benchmark; each
hit is extended to the windows it stands for, and these are joined on their
words, so a hash collision never counts.

An item of fewer words is one window of its own length; such lengths are looked
up only when the benchmark has them.

Defined cases: null and empty texts have no words and no hits; equal rows give
equal results; a row is known by its doc_id and text, so repeated or null ids
do not mix texts; an item without words is ignored; a null item_id counts for
hits but is not listed; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.llm.tables import fresh, match
from sitewise.session import checkpoint

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


KEY = ["doc_id", "_row"]


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def _indexes(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also when a lambda uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def fingerprints(w: Column, window: int) -> Column:
    """The fingerprint of every window of an array of words."""
    k = window // 2 + 1
    span = window - k + 1

    def grams(h):
        return F.transform(_indexes(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def least(g):
        at = (lambda i: F.least(*[F.get(g, i + j) for j in range(span)])) if span > 1 else (lambda i: F.get(g, i))
        return F.transform(_indexes(F.size(g) - (span - 1)), at)

    return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _let(grams(h), least))


def _windows(w: Column, length: int) -> Column:
    """(start, length, text) of every window of an array of words."""
    return F.transform(_indexes(F.size(w) - (length - 1)), lambda i: F.struct(
        i.alias("s"), F.lit(length).alias("n"), F.array_join(F.slice(w, i + 1, length), " ").alias("t")))


def _windows_of(length: int):
    return lambda w: _windows(w, length)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct (doc_id, text): n_words, hit spans (word positions,
    end exclusive), n_hit, items (sorted as strings) and contaminated."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    long_items = items.where(F.size("_w") >= window)
    # window texts of the benchmark and the items that hold them
    texts = long_items.select("item_id", F.explode(_let(F.col("_w"), lambda w: _windows(w, window))).alias("x")).select(
        "item_id", F.col("x.t").alias("_t"), F.col("x.n").alias("_n"))
    short = items.where(F.size("_w") < window).select("item_id", F.array_join("_w", " ").alias("_t"), F.size("_w").alias("_n"))
    lengths = [r["_n"] for r in short.select("_n").distinct().orderBy("_n").collect()]  # fewer than window values
    texts = texts.unionByName(short).distinct()
    prints = long_items.select(F.explode(fingerprints(F.col("_w"), window)).alias("_p")).distinct().withColumn("_in", F.lit(True))

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows = rows.select("doc_id", _row_key(F.col("_text")).alias("_row"), "_text")
    seen = rows.select(*KEY, _let(words(F.col("_text")), lambda w: F.struct(
        F.size(w).alias("n"), F.array_distinct(fingerprints(w, window)).alias("m"))).alias("x"))
    # the added null keeps a row for each document through the join
    seen = seen.select(*KEY, F.col("x.n").alias("n_words"), F.explode(
        F.concat(F.col("x.m"), F.array(F.lit(None).cast("long")))).alias("_p"))
    seen = seen.join(prints, "_p", "left").where(F.col("_in") | F.col("_p").isNull())
    found = checkpoint(seen.groupBy("doc_id", "_row", "n_words").agg(F.collect_set("_p").alias("_found")))

    key = found.where(F.size("_found") > 0).select("doc_id", "_row", "_found")
    some = match(rows, key, KEY, "inner")
    spans = some.select(*KEY, F.explode(_let(words(F.col("_text")), lambda w: _let(fingerprints(w, window), lambda m: F.filter(
        _windows(w, window), lambda x: F.array_contains(F.col("_found"), F.get(m, x["s"])))))).alias("x"))
    for n in lengths:
        spans = spans.unionByName(rows.select(*KEY, F.explode(_let(words(F.col("_text")), _windows_of(n))).alias("x")))
    spans = spans.select("doc_id", "_row", F.col("x.s").alias("_s"), F.col("x.n").alias("_n"), F.col("x.t").alias("_t"))
    hit = spans.join(texts.select("_t", "_n").distinct(), ["_t", "_n"], "left_semi")
    per = checkpoint(hit.groupBy("doc_id", "_row").agg(
        F.sort_array(F.collect_set(F.struct("_s", (F.col("_s") + F.col("_n")).alias("_e")))).alias("_spans"),
        F.collect_set(F.struct("_t", "_n")).alias("_texts")))
    names = per.select("doc_id", "_row", F.explode("_texts").alias("x")).select("doc_id", "_row", "x.*").join(texts, ["_t", "_n"])
    names = names.groupBy("doc_id", "_row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["_e"] - F.greatest(x["_s"], a["upto"]))).alias("n"),
                              F.greatest(a["upto"], x["_e"]).alias("upto")))
    per = per.select("doc_id", "_row", "_spans", covered["n"].cast("long").alias("_hit"))
    out = match(match(found.drop("_found"), per, KEY), names, KEY)
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "_row", F.col("n_words").cast("long").alias("n_words"), F.col("_spans").alias("spans"),
        F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.col("_hit").isNotNull().alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, window)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    found = found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", digest)
    cols = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    left = docs.select("doc_id", _row_key(F.col("text")).alias("_row"))
    return match(left, found.select(*KEY, *cols), KEY).select("doc_id", *cols)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a shared window; all columns are kept."""
    row = fresh(docs, "_row")
    found = hits(docs, benchmark, window).where("contaminated").select("doc_id", F.col("_row").alias(row))
    return match(docs.withColumn(row, _row_key(F.col("text"))), found, ["doc_id", row], "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(it.items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(it.items, ','), '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN it USING (doc_id)
"""
