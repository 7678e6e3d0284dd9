"""Ranked search, conversation trie and merge automaton against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import automaton, lexical, prefix_trie
from sitewise.llm.queries import QUERIES
from sitewise.llm.tables import tokenizer

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ ranked search


def plain_search(docs, items, limit=10):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    terms = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(TERM.findall(low(t)))
    out = []
    for i, q in asked.items():
        scores = []
        for d, c in terms:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in q.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:limit])]
    return out


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: tuple((v is None, v or 0) for v in r))


def by_none(found):
    return sorted(found, key=lambda r: tuple((v is None, v or 0) for v in r))


RANKED = ("item_id", "rank", "doc_id", "score")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "one two two THREE nothing-here", 1), (2, None, 1), (3, "", 1), (4, "wort5 Wort6 é", 1), (1, "row", 1), (None, "word id ten", 1),
         (7, "10 0 example org a b c", 1)], "item_id long, text string, score int")


def test_search_on_edge_rows(spark, edge, items, empty, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    want = by_none(plain_search(docs, [(r[0], r[1]) for r in items.collect()]))
    assert rows(lexical.search(edge, items), *RANKED) == want
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(edge, items.where("item_id = -5")).count() == 0
    assert lexical.search(edge, items.where("item_id in (2, 3)")).count() == 0
    # vocabulary and items in several blocks, scores in small steps
    monkeypatch.setattr(lexical, "VOCABULARY", 3)
    monkeypatch.setattr(lexical, "POSTINGS", 4)
    monkeypatch.setattr(lexical, "CELLS", 2)
    assert rows(lexical.search(edge, items), *RANKED) == want


def test_search_with_many_copies(spark, items):
    docs = [(i, "one two three" if i % 3 else f"one wort{i % 7} row {i}") for i in range(300, 0, -1)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = by_none(plain_search(docs, [(r[0], r[1]) for r in items.collect()]))
    assert rows(lexical.search(df, items), *RANKED) == want


def test_vocabulary_verifies_bytes():
    v = lexical.Vocabulary([(0, "ab"), (1, "abc"), (2, "é")])
    buf = np.frombuffer("AB abc abcd éx é".encode(), np.uint8)
    h, n, starts = lexical.words(buf, np.array([0, len(buf)]), lexical._TABLES)
    hit, term = v.find(buf, starts, h)
    assert list(zip(hit.tolist(), term.tolist(), strict=True)) == [(0, 0), (1, 1), (4, 2)]
    # a word whose hash is forged to a term's is turned down
    assert len(v.find(buf, starts, np.full(len(h), v.hash[0]))[0]) == 1


# ------------------------------------------------------------------ trie


def plain_trie(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            text = text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(math.fmod(c, 20)), [])
        rebuilt[c] = tuple(base[:h] + mine[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        words = len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * words
            leaves[k[:d]] += kids[k] == 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return by_none(out)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def trie_rows(found):
    return rows(found, *NODE)


def made_up(seed, n=120):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(-25, n):
        if rng.random() < 0.2:
            continue
        for t in range(int(rng.integers(1, 9))):
            out.append((c, t if t else None, ["user", "assistant"][t % 2], " ".join(rng.choice(["a", "b", "c d"], 2)) if rng.random() < 0.9 else None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_on_made_up_conversations(spark, seed):
    turns = made_up(seed)
    got = prefix_trie.prefix_trie(spark.createDataFrame(turns, TURNS).repartition(5))
    assert trie_rows(got) == plain_trie(turns)


def test_trie_cases(spark, monkeypatch):
    turns = [(None, 0, "user", "lost"), (40, None, None, None), (40, 1, "user", " two words "), (40, 1, "user", " two words "), (41, 0, "user", "x")]
    turns += [(60 + i, t, "user", f"turn {t}") for i in range(20) for t in range(12)]  # copies
    turns += [(200, t, "user", f"long {t % 3}") for t in range(700)] + [(201, t, "user", f"long {t % 3}") for t in range(690)]
    turns += [(300 + i, 0, "user", "") for i in range(50)]  # many children of few nodes
    df = spark.createDataFrame(turns, TURNS).withColumns({"d": F.lit(1), "slice": F.lit("x"), "s": F.lit(2.0)})
    want = plain_trie(turns)
    assert trie_rows(prefix_trie.prefix_trie(df)) == want
    assert prefix_trie.prefix_trie(df.where("conv_id = -1")).count() == 0
    # blocks of few rows, chunks of few bytes
    monkeypatch.setattr(prefix_trie, "DEPTHS", 64)
    monkeypatch.setattr(prefix_trie, "SALTS", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 5)
    assert trie_rows(prefix_trie.prefix_trie(df)) == want


def test_trie_starts_again_on_a_collision(spark, monkeypatch):
    turns = made_up(3, 40)
    true_hash = prefix_trie.turn_hash
    monkeypatch.setattr(prefix_trie, "turn_hash", lambda seed: F.lit(5).cast("long") if seed == 1 else true_hash(seed))
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(turns, TURNS))) == plain_trie(turns)


def test_fingerprints_compose():
    rng = np.random.default_rng(4)
    t = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    place = np.arange(1, 51)
    whole = np.cumsum(t * prefix_trie.power(place), dtype=np.uint64)
    for a in (1, 7, 33):
        right = np.cumsum(t[a:] * prefix_trie.power(np.arange(1, 51 - a)), dtype=np.uint64)
        assert whole[a - 1] + right[-1] * prefix_trie.power(np.array([a]))[0] == whole[-1]
    back = prefix_trie.power(np.array([-9])) * prefix_trie.power(np.array([9]))
    assert back[0] == 1


# ------------------------------------------------------------------ merge automaton


@pytest.fixture(scope="module")
def compiled():
    return automaton.compile_automaton(tokenizer("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


TEXTS = [
    "", " ", "a" * 1000, "ab" * 700, "hello <|endoftext|>world<|endoftext|>", "<|endoftext|>", "<|endoftext", "x՘y 1՘", " \n\n  tab\t",
    "it's we'll I'M 'S \x1c\x1d a\x85 \x0b\x0c", "\U0001f642é 漢字 123४५", "e" * 5001 + " " + "the" * 300,
    "\x1c \x1f\x7f'   x", "\x00\x01﻿", "é" * 400, "don't  stop", " a  b",
]


def test_automaton_equals_library(compiled, library):
    enc = automaton.Encoder(compiled)
    got = list(enc.encode_batch(TEXTS))
    want = [e.ids for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert got == want
    assert [compiled.decode(i) for i in got] == [library.decode(i, skip_special_tokens=False) for i in want] == TEXTS


def test_automaton_equals_library_on_random_strings(compiled, library):
    rng = np.random.default_rng(11)
    alphabet = list("abcdehilnorst   ''.,\n19") + ["é", "ß", "б", "中", "\U0001f600", "�"]
    texts = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 60, 3000)]
    texts += ["".join(chr(c) for c in rng.integers(32, 0x3000, 40)) for _ in range(300)]
    got = list(automaton.Encoder(compiled).encode_batch(texts))
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_gadgets_equal_merging_in_order():
    """Small vocabularies: the accepted token sequence is what merging in order of rank makes."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        labels, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            u, v = rng.integers(0, len(labels), 2)
            if labels[u] + labels[v] not in labels:
                merges.append((int(u), int(v), len(labels)))
                labels.append(labels[u] + labels[v])
        g = automaton.Gadgets(len(labels), [0, 1, 2])
        live = {(u, v): w for u, v, w in merges}
        for m in merges:
            g.merge(*m)
        for _ in range(60):
            word = [int(x) for x in rng.integers(0, 3, int(rng.integers(1, 14)))]
            seq = list(word)
            for u, v, w in merges:
                i = 0
                while i < len(seq) - 1:
                    if seq[i] == u and seq[i + 1] == v:
                        seq[i : i + 2] = [w]
                    i += 1
            # all label sequences of the word that the automaton accepts
            text = "".join(labels[x] for x in word)
            paths = [((), 0, 0)]
            found = []
            while paths:
                path, at, state = paths.pop()
                if at == len(text):
                    found.append(list(path))
                    continue
                for i, s in enumerate(labels):
                    if g.column_of[i] >= 0 and text.startswith(s, at) and g.arcs[state, g.column_of[i]]:
                        paths.append(((*path, i), at + len(s), g.state_of[i]))
            assert found == [seq], (merges, word, live)


def test_bpe_query_and_edges(spark, edge, empty, compiled, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in edge.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert rows(automaton.encode_digests(edge, compiled), *names) == by_none(want)
    assert automaton.encode_digests(empty, compiled).count() == 0
    full = automaton.encode_documents(edge, compiled).collect()
    assert all(list(r["token_ids"]) == library.encode(r["decoded"], add_special_tokens=False).ids for r in full)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lib = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in docs}
    got = {r["doc_id"]: r["ids_sha256"] for r in QUERIES["op13_bpe"](spark, SF).collect()}
    assert got == {d: sha(",".join(map(str, ids))) for d, ids in lib.items()}


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        automaton.compile_automaton(tokenizer("word_bpe_49k.json"))
