"""Secret scan: candidate strings scored by a random forest.

Candidates are runs of at least ``LEAST`` characters of ``[A-Za-z0-9+/_-]``
that hold a digit, are all capitals or mix cases inside, and the values that are
assigned to a key name (password, token, ..), whatever their length and signs:
quoted ones up to the quote, others up to white space, less closing signs. Runs
inside such a value stay candidates of their own. The forest removes false
positives; its features are

* length, shares of digits, capitals, small letters and signs, entropy, number
  of distinct characters,
* character transitions: mean log probability of the candidate's bytes after one
  another, and the least of them, under transitions counted over all texts,
* dictionary coverage: share of its letters inside frequent corpus words,
* path: the document's source, hashed,
* neighbouring words: the two before and the one after, hashed, and whether an
  assignment sign stands right before.

It is trained on labelled findings (doc_id, start, end, secret), at most
``FIT_ROWS`` of them, the smallest hashes first (a documented bound). Counts
cover all texts; what is sent to the tasks has a fixed size.

Defined cases: null and empty texts have no candidates; a null source is the
empty path; findings with a null label are not used; without findings of both
kinds the probability is null and every candidate stays a finding; repeated
rows give repeated findings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.textbytes import LETTER_TABLES, hash_word, mix_int, text_chunks, words
from sitewise.session import shared_path

LEAST = 12
FIT_ROWS = 10000
TREES, DEPTH, SEED = 40, 8, 7
DICTIONARY = 1 << 16
PATH_SLOTS, WORD_SLOTS = 8, 16
BLOCKS = 64
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
_WORD = re.compile("[A-Za-z\x80-\U0010ffff]+")
_ASSIGN = re.compile(r"""(?:=>|[=:])\s*["']?\Z""")
KEY_NAMES = r"(?:password|passwd|passphrase|pwd|secret|token|(?:api|access|private|secret)[_-]?key)"
_KEY = re.compile(rf"""(?i){KEY_NAMES}["']?\s*+(?::=|=>|[=:])\s*+""")
_VALUE = re.compile(r"""(?s)"((?:[^"\\\n]|\\.)++)"|'((?:[^'\\\n]|\\.)++)'|["']?(\S++)""")
_CLOSING = ",;)]}>\"'"


def _runs(text: str) -> Iterator[tuple[int, int]]:
    for m in _RUN.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) or s.isupper() or any(c.isalpha() for c in s) and not (s.islower() or s[1:].islower()):
            yield m.span()


def _values(text: str) -> Iterator[tuple[int, int]]:
    stop = 0
    for key in _KEY.finditer(text):
        if key.end() < stop:  # inside the value before
            continue
        m = _VALUE.match(text, key.end())
        if m is None:
            continue
        start, stop = m.span(m.lastindex)
        end = stop
        while m.lastindex == 3 and end > start and text[end - 1] in _CLOSING:
            end -= 1
        if end > start:
            yield start, end


def candidates(text: str) -> list[tuple[int, int]]:
    return sorted({*_runs(text), *_values(text)})


# ------------------------------------------------------------------ corpus counts


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte pairs and letter words of all texts, by block of hash."""
    pairs = np.zeros(65536, np.int64)
    for batch in batches:
        hs = []
        for _, buf, offsets in text_chunks(batch.column("text")):
            two = buf[:-1].astype(np.int64) * 256 + buf[1:]
            inside = np.ones(len(two), bool)
            edge = offsets[1:-1] - 1
            inside[edge[(edge >= 0) & (edge < len(two))]] = False
            pairs += np.bincount(two[inside], minlength=65536)
            hs.append(words(buf, offsets, LETTER_TABLES)[0].view(np.int64))
        h, n = np.unique(np.concatenate(hs) if hs else np.empty(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), pa.array(h), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])
    at = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(pairs[at])], names=["kind", "key", "n"])


class Corpus:
    """Log transition probabilities (256 x 256) and the dictionary's hashes."""

    def __init__(self, pairs: np.ndarray, dictionary: np.ndarray):
        self.log = np.log((pairs + 0.1) / (pairs.sum(axis=1, keepdims=True) + 25.6))
        self.dictionary = dictionary


def corpus_of(docs: DataFrame, most: int = DICTIONARY) -> Corpus:
    """Counts over all texts; at most 65,536 byte pairs and ``most`` words are kept."""
    path = shared_path(docs.sparkSession, "secret-counts")
    docs.select("text").mapInArrow(_transitions, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    pairs = np.zeros(65536)
    for r in counts.where("kind = 1").collect():
        pairs[r["key"]] = r["n"]
    step = F.floor(F.log2("n") * 32).cast("int")
    sizes = counts.where("kind = 0").groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("v")).orderBy(F.desc("s")).collect()
    total, cut = 0, 1 << 20
    for r in sizes:  # at most 32 * 64 rows
        if total + r["v"] > most:
            break
        total, cut = total + r["v"], r["s"]
    top = counts.where((F.col("kind") == 0) & (step >= cut)).select("key").toArrow()
    return Corpus(pairs.reshape(256, 256), np.sort(top.column("key").to_numpy()))


# ------------------------------------------------------------------ features

SHAPE = ["length", "digits", "capitals", "small", "signs", "entropy", "distinct", "mean_transition", "least_transition", "coverage", "assigned"]
WIDTH = len(SHAPE) + PATH_SLOTS + 3 * WORD_SLOTS


def _coverage(s: str, dictionary: np.ndarray) -> float:
    """Share of the letters inside dictionary words of 3 to 12 letters."""
    runs = [m[0].lower() for m in re.finditer("[A-Za-z]{3,}", s)]
    letters = sum(c.isalpha() for c in s)
    if not runs or len(dictionary) == 0:
        return 0.0
    spots = [(i, a, b) for i, r in enumerate(runs) for a in range(len(r)) for b in range(a + 3, min(len(r), a + 12) + 1)]
    raw = " ".join(runs[i][a:b] for i, a, b in spots).encode()
    h = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), LETTER_TABLES)[0].view(np.int64)
    at = np.minimum(np.searchsorted(dictionary, h), len(dictionary) - 1)
    covered = set()
    for (i, a, b), ok in zip(spots, (dictionary[at] == h).tolist(), strict=True):
        if ok:
            covered.update((i, j) for j in range(a, b))
    return len(covered) / letters


def _slot(word: str, slots: int) -> int:
    return mix_int(hash_word(word)) % slots if word.split() else 0


def features(text: str, start: int, end: int, path: str, corpus: Corpus) -> list[float]:
    s = text[start:end]
    n = len(s)
    raw = np.frombuffer(s.encode(), np.uint8)
    steps = corpus.log[raw[:-1], raw[1:]]
    count = Counter(s)
    left, right = text[max(0, start - 80) : start], text[end : end + 40]
    before = [m[0] for m in _WORD.finditer(left)][-2:]
    after = _WORD.search(right)
    out = [
        float(n), sum(c.isdigit() for c in s) / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n,
        sum(not c.isalnum() for c in s) / n, -sum(v / n * math.log2(v / n) for v in count.values()), float(len(count)),
        float(steps.mean()) if n > 1 else 0.0, float(steps.min()) if n > 1 else 0.0, _coverage(s, corpus.dictionary), float(bool(_ASSIGN.search(left))),
    ]
    for word, slots in (("".join(path.split()), PATH_SLOTS), (before[-1] if before else "", WORD_SLOTS),
                        (before[-2] if len(before) > 1 else "", WORD_SLOTS), (after[0] if after else "", WORD_SLOTS)):
        one = [0.0] * slots
        if word:
            one[_slot(word, slots)] = 1.0
        out += one
    return out


_CANDIDATE = "doc_id long, start long, end long, candidate string, left string, features array<double>"
_CANDIDATE_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("candidate", pa.string()), ("left", pa.string()),
    ("features", pa.list_(pa.float64()))])


def _scan(corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = corpus.value
        for batch in batches:
            out = []
            for doc, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "source")), strict=True):
                for a, b in candidates(text):
                    out.append({"doc_id": doc, "start": a, "end": b, "candidate": text[a:b], "left": text[max(0, a - 24) : a],
                                "features": features(text, a, b, path, known)})
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_pylist(out, schema=_CANDIDATE_ARROW)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_CANDIDATE_ARROW)

    return run


def scan(docs: DataFrame) -> DataFrame:
    """Candidates of all texts with their features, as a table in the shared folder."""
    spark = docs.sparkSession
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(source, F.lit("")).alias("source"))
    corpus = spark.sparkContext.broadcast(corpus_of(rows))
    path = shared_path(spark, "secret-candidates")
    rows.mapInArrow(_scan(corpus), _CANDIDATE).write.parquet(path)
    return spark.read.parquet(path)


def classify(found: DataFrame, findings: DataFrame, rows: int = FIT_ROWS, level: float = 0.5) -> DataFrame:
    """doc_id, start, end, value_sha256, probability and is_secret of each candidate."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    shown = ["doc_id", "start", "end", F.sha2(F.col("candidate").cast("binary"), 256).alias("value_sha256")]
    known = findings.where(F.col("secret").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", "start", "end", F.col("secret").cast("double").alias("label")).distinct()
    known = known.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "end", "label").limit(rows)
    # at most `rows` rows of four numbers
    train = found.join(F.broadcast(known), ["doc_id", "start", "end"]).select("label", array_to_vector("features").alias("x"))
    path = shared_path(found.sparkSession, "secret-labelled")
    train.write.parquet(path)
    train = found.sparkSession.read.parquet(path)
    if train.select("label").distinct().count() < 2:
        return found.select(*shown, F.lit(None).cast("double").alias("probability"), F.lit(True).alias("is_secret"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    model = forest.fit(train)
    out = model.transform(found.withColumn("x", array_to_vector("features")))
    p = F.get(vector_to_array("probability"), 1)
    return out.withColumn("probability", p).select(*shown, "probability", (F.col("probability") >= level).alias("is_secret"))


# Forms that issuers give their keys, and key names that are
# followed by a secret; benign forms are digits alone and written words, not
# after a key name. Short values need a digit and a letter.
ISSUED = r"^AKIA[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_live_[A-Za-z0-9]{16,}$|^xox[abp]-[A-Za-z0-9-]{10,}$"
NAMED = rf"(?i){KEY_NAMES}[\"']?\s*(:=|=>|[=:])\s*[\"']?$"
_PART = "([A-Z]?[a-z]{2,}([A-Z][a-z]{2,})*|[A-Z]+|[a-z])"
BENIGN = rf"^[0-9+/_-]+$|^{_PART}([-_/+]+{_PART})*$"
VALUE = r"^(?=.*[0-9]).{%d,}$|^(?=.*[0-9])(?=.*[A-Za-z]).{6,}$" % LEAST


def label_by_form(found: DataFrame) -> DataFrame:
    """Labelled findings from forms that leave no doubt; others stay unlabelled."""
    named = F.col("left").rlike(NAMED)
    secret = F.when(F.col("candidate").rlike(ISSUED) | (named & F.col("candidate").rlike(VALUE)), 1).when(
        ~named & F.col("candidate").rlike(BENIGN), 0)
    return found.select("doc_id", "start", "end", secret.alias("secret"))
