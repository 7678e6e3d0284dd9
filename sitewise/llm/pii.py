"""Personal data and information-theoretic sanitisation.

Protected entities are found by patterns (email, ip, card, phone). A term
discloses part of an entity: with document frequencies over the whole corpus,

    disclosure(t, e) = PMI(e; t) / IC(e) = 1 - log p(e | t) / log p(e)

is the share of the entity's information that the term gives away. p(e, t)
counts the documents in which t stands within ``CONTEXT`` words of e. Every
entity and every neighbour counts, also those of a single text: addresses and
numbers seldom stand in more than one, and a word that stands nowhere else
leads to them (of an entity in one of N documents, a neighbour that stands in n
discloses 1 - log n / log N). What chance explains discloses nothing: with a
term's n_t documents drawn at random, n_et or more of them hold e with a
probability of at most exp(-n_t KL(n_et / n_t || p(e))); from ``CHANCE`` on the
disclosure is at most 0 (a word of one text beside an entity of one text needs
more than 1 / CHANCE documents). In a document that holds the entity, every
occurrence of a term with a disclosure of ``GENERALISE`` or more is generalised
(its text becomes a label), of ``REMOVE`` or more removed. Spans of entities
stay as they are and are replaced by the label of their kind.

No step pairs all texts of an entity with all its terms: pairs with equal counts
are weighed once, and a text is matched by the (entity, term) it holds itself.

Terms are runs of letters, A-Z lower-cased. Positions are code points.

Defined cases: null and empty texts have no spans; an entity that every
document holds carries no information and is not disclosed; equal texts under
one doc_id have equal results; a term that overlaps an entity's span is left.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.llm.gate import Gate, gate, passes
from sitewise.llm.tables import fresh, match
from sitewise.llm.textbytes import LEAN, LETTER_TABLES, TEXTS, mix, text_chunks, text_parts, words
from sitewise.session import checkpoint

CONTEXT = 8
CHANCE = 0.05
GENERALISE, REMOVE = 0.8, 0.95
KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")
SLICE = 1 << 18  # words counted at a time
LABEL = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "generalise": "<TERM>", "remove": ""}

# The patterns are those of the contract in a form that takes linear time: a
# match begins where its run of characters begins, and runs are not given back.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile("[A-Za-z\x80-\U0010ffff]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def fold(term: str) -> str:
    return term.translate(_FOLD)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of personal data, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def term_spans(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the terms."""
    spans = [m.span() for m in _TERM.finditer(text)]
    return [a for a, _ in spans], [b for _, b in spans]


def context(text: str, terms: tuple[list[int], list[int]], start: int, end: int, n: int = CONTEXT) -> set[str]:
    """Terms within n words of a span, however far away; of a term that reaches
    into the span, the part outside."""
    starts, ends = terms
    left, right = bisect_left(starts, start), bisect_right(ends, end)
    near = [text[starts[i] : min(ends[i], start)] for i in range(max(0, left - n), left)]
    near += [text[max(starts[i], end) : ends[i]] for i in range(right, min(right + n, len(ends)))]
    return {fold(t) for t in near}


def name(text: str, kind: str, start: int, end: int) -> str:
    return f"{kind}:{fold(text[start:end])}"


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "doc_id long, _row long, n_email long, n_ip long, n_card long, n_phone long, base string, near array<struct<entity:string,terms:array<string>>>"
_FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("_row", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()),
    ("near", pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))),
])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_parts(batches, TEXTS):
        out = {c: [] for c in _FOUND_ARROW.names}
        for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_row", "text")), strict=True):
            spans = entities(text)
            out["doc_id"].append(doc)
            out["_row"].append(row)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in spans))
            out["base"].append(shown(spans))
            near: dict[str, set[str]] = {}
            terms = term_spans(text) if spans else ([], [])
            for k, a, b in spans:
                near.setdefault(name(text, k, a, b), set()).update(context(text, terms, a, b))
            out["near"].append([{"entity": e, "terms": sorted(t)} for e, t in near.items()])
        yield pa.RecordBatch.from_pydict(out, schema=_FOUND_ARROW)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_row"), text.alias("text"))


def term_hashes(terms: list[str]) -> np.ndarray:
    raw = " ".join(terms).encode()
    return words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), LETTER_TABLES)[0].view(np.int64)


def _hash_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = batch.column("term").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array(term_hashes(terms), pa.int64())], names=["term", "h"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): texts of a slice that hold the word, for all words."""
    for batch in batches:
        found, held = [], 0
        for _, buf, offsets in text_chunks(batch.column("text"), LEAN):
            h, n, _ = words(buf, offsets, LETTER_TABLES)
            h = h.view(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            found.append(h[first])
            held += len(found[-1])
            if held >= SLICE:
                yield _tally(found)
                found, held = [], 0
        yield _tally(found)


def _tally(found: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])


def revealing_terms(rows: DataFrame, found: DataFrame, support: int = 1, least: float = GENERALISE) -> DataFrame | None:
    """(entity, term, disclosure) of the pairs at or over a disclosure of ``least``;
    None when no entity has a neighbour. ``support`` is the least number of
    distinct texts of an entity and of a pair; 1 leaves none out."""
    near = found.where(F.size("near") > 0).groupBy("_row").agg(F.count(F.lit(1)).alias("copies"), F.first("near").alias("near"))
    near = near.select("_row", "copies", F.explode("near").alias("x")).select("copies", "x.*")
    freq = near.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).drop("texts")
    pairs = near.select("entity", "copies", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.sum("copies").alias("n_et"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).drop("texts")
    pairs = checkpoint(pairs.join(freq, "entity"))
    if pairs.isEmpty():
        return None
    terms = checkpoint(pairs.select("term").distinct().mapInArrow(_hash_terms, "term string, h long"))
    counts = rows.select("text").mapInArrow(_term_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n_t"))
    total = found.count()
    if total < 2:
        return None
    # a common word is the neighbour of many entities: equal counts are weighed once
    alike = ["term", "n_e", "n_et"]
    share = F.least(F.lit(1.0), F.col("n_et") / F.col("n_t"))
    p = F.col("n_e") / F.lit(float(total))
    disclosure = 1 - F.log(share) / F.log(p)
    gain = F.col("n_t") * (share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0))
    proven = (share > p) & (gain > -math.log(CHANCE))
    disclosure = F.when(F.col("n_e") < total, F.when(proven, disclosure).otherwise(F.least(disclosure, F.lit(0.0))))
    weighed = pairs.select(*alike).distinct().join(terms.join(counts, "h"), "term").select(*alike, disclosure.alias("disclosure"))
    weighed = checkpoint(weighed.where(F.col("disclosure") >= least))
    key = F.xxhash64(*alike)
    pairs = pairs.where(passes(pairs, key, gate(weighed.select(key.alias("k")), "k")))
    return checkpoint(pairs.join(weighed, alike).select("entity", "term", "disclosure"))


def _entity_hash(entity: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(entity.encode(), digest_size=8).digest(), "little"))


def _hash_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = term_hashes(batch.column("term").to_pylist())
        e = np.array([_entity_hash(x) for x in batch.column("entity").to_pylist()], np.uint64)
        k = mix(h.view(np.uint64) ^ e).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int64())], names=["h", "k"])


def _standing(term_bits, pair_bits):
    """(_row, entity, term): entities of a text and the terms in it that may
    disclose them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        revealing, paired = Gate(term_bits.value).test, Gate(pair_bits.value).test
        for batch in text_parts(batches, TEXTS):
            out = {"_row": [], "entity": [], "term": []}
            for row, text in zip(*(batch.column(c).to_pylist() for c in ("_row", "text")), strict=True):
                held = {name(text, *s) for s in entities(text)}
                terms = list({fold(m[0]) for m in _TERM.finditer(text)}) if held else []
                h = term_hashes(terms)
                keep = np.flatnonzero(revealing(h))
                h = h[keep].view(np.uint64)
                for e in held:
                    hit = keep[paired(mix(h ^ _entity_hash(e)).view(np.int64))].tolist()
                    out["_row"] += [row] * len(hit)
                    out["entity"] += [e] * len(hit)
                    out["term"] += [terms[i] for i in hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["_row"], pa.int64()), pa.array(out["entity"], pa.string()), pa.array(out["term"], pa.string())], names=list(out))

    return run


def _added(remove: float):
    """Spans of a document's revealing terms, outside its entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_parts(batches, TEXTS):
            out = []
            for row, text, terms in zip(*(batch.column(c).to_pylist() for c in ("_row", "text", "terms")), strict=True):
                level = {t["term"]: t["disclosure"] for t in terms}
                taken = []  # spans of entities, those that overlap as one
                for _, a, b in sorted(entities(text), key=lambda s: s[1:]):
                    if taken and a < taken[-1][1]:
                        taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
                    else:
                        taken.append((a, b))
                i, spans = 0, []
                for m in _TERM.finditer(text):
                    d = level.get(fold(m[0]))
                    if d is None:
                        continue
                    while i < len(taken) and taken[i][1] <= m.start():
                        i += 1
                    if i < len(taken) and taken[i][0] < m.end():
                        continue
                    spans.append(("remove" if d >= remove else "generalise", *m.span()))
                spans.sort(key=lambda s: (ADDED.index(s[0]), s[1]))
                out.append((row, shown(spans)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in out], pa.int64()), pa.array([s for _, s in out], pa.string())], names=["_row", "added"])

    return run


def spans(docs: DataFrame, support: int = 1, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of docs: doc_id, _row (hash of the text), counts by kind,
    base spans and spans added by the method, as text."""
    rows = _keyed(docs)
    found = checkpoint(rows.mapInArrow(_find, _FOUND))
    out = found.drop("near")
    pairs = revealing_terms(rows, found, support, generalise)
    if pairs is None:
        return out.withColumn("added", F.lit(""))
    send = rows.sparkSession.sparkContext.broadcast
    keys = checkpoint(pairs.select("entity", "term").mapInArrow(_hash_pairs, "h long, k long"))
    held = rows.where(passes(rows, F.col("_row"), gate(found.where(F.size("near") > 0), "_row"))).select("_row", "text").mapInArrow(
        _standing(send(gate(keys, "h").bits), send(gate(keys, "k").bits)), "_row long, entity string, term string")
    held = held.distinct().join(pairs, ["entity", "term"]).groupBy("_row", "term").agg(F.max("disclosure").alias("disclosure"))
    held = checkpoint(held.groupBy("_row").agg(F.collect_list(F.struct("term", "disclosure")).alias("terms")))
    some = rows.where(passes(rows, F.col("_row"), gate(held, "_row"))).select("_row", "text").dropDuplicates(["_row"])
    added = some.join(held, "_row").select("_row", "text", "terms").mapInArrow(_added(remove), "_row long, added string")
    return out.join(added, "_row", "left").withColumn("added", F.coalesce("added", F.lit("")))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans, and all spans of each document."""
    both = F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("base", "added")])
    return spans(docs).select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), both.alias("spans"))


def rewrite(text: str, listed: str) -> str:
    """The text with every listed span replaced by its label."""
    todo = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in listed.split(",") if x))
    out, at = [], 0
    for a, b, k in todo:
        if a >= at:
            out += [text[at:a], LABEL[k]]
            at = -b
        else:
            at = max(at, -b)  # inside or over a span that is gone already
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the spans of their texts generalised or removed and n_chars, if
    present, renewed; all rows and columns are kept, a null text stays null.

    Only texts that have spans pass the gate into the join; all others go on
    as they are without being moved."""
    row, may, listed = (fresh(docs, c) for c in ("_row", "_may", "_spans"))
    found = spans(docs).where((F.col("base") != "") | (F.col("added") != ""))
    found = checkpoint(found.select(
        F.col("_row").alias(row), F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("base", "added")]).alias(listed)).distinct())
    keyed = docs.withColumn(row, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    keyed = keyed.withColumn(may, passes(docs, F.col(row), gate(found, row)))

    @F.pandas_udf("string")
    def rewritten(t, s):
        return t.combine(s, lambda x, y: rewrite(x, y) if isinstance(x, str) and isinstance(y, str) else x)

    hit = match(keyed.where(F.col(may)), found, [row]).withColumn(
        "text", F.when(F.col(listed).isNull(), F.col("text")).otherwise(rewritten("text", listed)))
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        hit = hit.withColumn("n_chars", F.when(F.col(listed).isNull(), F.col("n_chars")).otherwise(size))
    return keyed.where(~F.col(may)).select(*docs.columns).unionByName(hit.select(*docs.columns))
