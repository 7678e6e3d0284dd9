"""Chat masks, pieces, personal data, secrets."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewise.llm import chat, pieces, pii, secrets_forest
from sitewise.llm.tables import tokenizer

BPE = tokenizer("byte_bpe_50k.json")
MODEL = tokenizer("piece_bpe_32k.model")
BITS = ["\\", "<", "|", "im_end", "|>", "<|im_end|>", "<|im_start|>", "</s>", "[INST]", "[/INST]", "\n", " ", "é", "\U0001f642", "a", "<<SYS>>", "<s>"]
PARTS = st.lists(st.sampled_from(BITS), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(PARTS)
def test_escape_is_reversible_and_hides_control_strings(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


@pytest.fixture(scope="module")
def encode():
    return chat.encoder(BPE)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), PARTS), min_size=1, max_size=6))
def test_mask_is_the_assistant_text(encode, turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    _, offsets = encode(text)
    keep = np.array([r == "assistant" for r, _ in turns])
    mask = chat.loss_mask(offsets, spans[keep])
    assert chat.masked_text(text, offsets, mask) == "".join(t for r, t in turns if r == "assistant")


def test_pieces_of_a_conversation_encode_as_the_whole(encode):
    turns = [("user", " a\n"), ("assistant", "\nb c"), ("user", ""), ("assistant", "d")]
    whole, _ = encode(chat.render(turns)[0])
    parts = [i for t in turns for i in encode(chat.render([t])[0])[0]]
    assert whole == parts


def test_conversations_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "x"),
            (3, 0, "assistant", "x" * 300000)] + [(4, i, "assistant", str(i)) for i in range(700)]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, block int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(turns, BPE)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert got[3]["loss_chars"] == 300000
    assert got[4]["loss_sha256"] == hashlib.sha256("".join(map(str, range(700))).encode()).hexdigest()
    none = turns.where("conv_id = 77")
    assert chat.digests(chat.format_conversations(none, BPE)).count() == 0


@pytest.fixture(scope="module")
def merge():
    return pieces.MergeEncoder(MODEL)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the", " ", "  ", "\n", "ing", "▁", "é", ";\r", "\t", "0x", "<s>", "aaaa"]), max_size=25).map("".join))
def test_pieces_equal_the_library(merge, text):
    text = text.encode("utf-8", "ignore").decode()
    texts = [text, "", text[::-1], text + " the"]
    got = list(merge.encode_batch(texts))
    assert got == [merge.lib.encode(t) + [merge.eos] for t in texts]
    assert merge.show(got[0]) == " ".join(map(str, got[0]))


def test_agendas_of_short_and_long_chunks_agree(merge, monkeypatch):
    rng = random.Random(5)
    chunks = ["".join(rng.choices("▁abeinorst0é中\U0001f642", k=rng.randint(1, 60))) for _ in range(300)] + ["a" * 5000, "中" * 200, "\n"]
    side = merge.merge(chunks)
    monkeypatch.setattr(pieces, "SHORT", 0)
    heap = merge.merge(chunks)
    assert all(np.array_equal(x, y) for x, y in zip(side, heap, strict=True))
    merge.check(chunks[-3:], *merge.merge(chunks[-3:]))
    ids, count = merge.merge(["ab", "cd"])
    with pytest.raises(ValueError, match="differs"):
        merge.check(["ab", "ce"], ids, count)


def test_pieces_on_tables(edge, empty, docs, merge):
    got = sorted(pieces.encode_documents(edge, MODEL).collect(), key=str)
    want = sorted(((r["doc_id"], merge.lib.encode(r["text"] or "") + [2], merge.lib.decode(merge.lib.encode(r["text"] or ""))) for r in edge.collect()), key=str)
    assert sorted((r["doc_id"], r["token_ids"], r["decoded"]) for r in got if r["doc_id"]) == sorted(w for w in want if w[0])
    assert len(got) == len(want)
    assert pieces.encode_digests(empty, MODEL).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pieces.encode_digests(docs, MODEL).collect():
        ids = merge.lib.encode(texts[r["doc_id"]]) + [2]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(merge.lib.decode(ids).encode()).hexdigest()


# ------------------------------------------------------------------ personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_entities(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def passes(d):
        odd, even = d[-1::-2], d[-2::-2]
        return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and passes(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "@", "b-c", "1", "25", "300", "4111 1111 1111 1111", " ", "-", "+1", "(555)", "é", "..", "10.0.0.1", "x@y.z", "٣"]), max_size=22).map("".join))
def test_entities_equal_the_patterns(text):
    assert pii.entities(text) == plain_entities(text)


def test_patterns_take_linear_time():
    for text in ("a" * 300000, "1" * 300000, "1." * 100000, "a." * 100000 + "@", "+1" + " " * 200000):
        pii.entities(text)


def test_disclosing_terms(spark):
    random.seed(3)
    filler = [f"{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}{'qrstuvwx'[i // 64 % 8]}" for i in range(400)]
    rows = []
    for i in range(200):
        rows.append((i, " ".join(random.sample(filler, 30))))
    for i in range(200, 206):
        rows.append((i, " ".join(random.sample(filler, 20)) + f" zorblatt writes to jo@secret.example.org about {random.choice(filler)} the zorblatt"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert all(got[i] == "" for i in range(200))
    for i in range(200, 206):
        assert got[i].startswith("email:") and got[i].count("remove:") >= 2
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("zorblatt" not in clean[i] and "<EMAIL>" in clean[i] for i in range(200, 206))
    assert all(clean[i] == rows[i][1] for i in range(200))


def test_disclosure_against_brute_force(spark):
    rows = [(i, f"alpha{'x' * (i % 3)} met bob@host.example.org beta gamma") for i in range(4)] + [(i, "beta gamma delta") for i in range(4, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = pii._keyed(docs)
    found = keyed.mapInArrow(pii._find, pii._FOUND)
    got = {r["term"]: r["disclosure"] for r in pii.revealing_terms(keyed, found, support=2, least=-9.0).collect()}
    assert set(got) == {"met", "beta", "gamma"} | ({"alpha"} & set(got))
    assert got["met"] == pytest.approx(1.0)
    assert got["beta"] == pytest.approx(1 - np.log(4 / 9) / np.log(4 / 9), abs=1e-9)


def test_an_entity_of_one_text_is_disclosed_by_its_rare_neighbours(spark):
    """Definition by brute force over texts that hold each entity once."""
    random.seed(8)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(120):
        text = random.choices(vocabulary, weights=[1 / (j + 1) ** 2 for j in range(60)], k=30)
        if i % 4 == 0:
            text[15:15] = [f"p{i}@mail.example.org", *(["+1 (555) 010-20" + str(i)] if i % 8 == 0 else [])]
        if i % 10 == 0:
            text.append(f"only{'abcdefghijkl'[i // 10]}")
            text.insert(17, f"only{'abcdefghijkl'[i // 10]}")
        rows.append((i, " ".join(text)))
    rows += [(500 + i, rows[0][1]) for i in range(3)]  # exact copies
    n, terms_of, near, n_e, n_t = len(rows), {}, {}, Counter(), Counter()
    for i, t in rows:
        terms_of[i] = {w.lower() for w in re.findall("[A-Za-z]+", t)}
        near[i] = {}
        for k, a, b in plain_entities(t):
            words = re.findall("[A-Za-z]+", t[:a])[-8:] + re.findall("[A-Za-z]+", t[b:])[:8]
            near[i].setdefault((k, t[a:b]), set()).update(words)
        n_e.update(near[i].keys())
        n_t.update(terms_of[i])
    n_et = Counter((e, w) for i in near for e, ws in near[i].items() for w in ws)
    shares = {p: 1 - np.log(c / n_t[p[1]]) / np.log(n_e[p[0]] / n) for p, c in n_et.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = 0
    for r in pii.report(docs).collect():
        text = dict(rows)[r["doc_id"]]
        base = plain_entities(text)
        want = [("email", a, b) for k, a, b in base if k == "email"] + [("phone", a, b) for k, a, b in base if k == "phone"]
        added = []
        for m in re.finditer("[A-Za-z]+", text):
            level = max((shares.get((e, m[0]), 0) for e in near[r["doc_id"]]), default=0)
            if level >= 0.8 and not any(a < m.end() and b > m.start() for _, a, b in base):
                added.append(("remove" if level >= 0.95 else "generalise", *m.span()))
        some += len(added)
        assert r["spans"] == pii.shown(want + sorted(added)), r["doc_id"]
    assert some > 20


def test_neighbours_are_found_at_any_distance(spark):
    far = "one two three four five six seven eight nine " + "12 34 . " * 100
    text = "0 " * 300 + far + "jo@mail.example.org" + " 5 -" * 300 + " ten"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    near = pii._keyed(docs).mapInArrow(pii._find, pii._FOUND).first()["near"]
    assert set(near[0]["terms"]) == {"two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"}
    for t in ("a éb@c.org d", "a b@c.orgé d", "+1 555 123 4567x y"):
        (_, a, b), *_ = pii.entities(t)
        want = [m for side in (t[:a], t[b:]) for m in re.findall("[A-Za-z\x80-\U0010ffff]+", side)]
        assert pii.context(t, pii.term_spans(t), a, b) == set(want)


def test_an_entity_of_all_documents_is_not_disclosed(spark):
    rows = [(i, f"{'even' if i % 2 else 'odd'} jo@mail.example.org here") for i in range(40)] + [(40, "here and here jo@mail.example.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["spans"].startswith("email:") and "," not in r["spans"] for r in pii.report(docs).collect())


def test_pii_edges(edge, empty):
    rows = pii.report(edge).collect()
    assert len(rows) == edge.count()
    hit = [r for r in rows if r["doc_id"] == 10][0]
    assert (hit["n_email"], hit["n_ip"], hit["n_phone"]) == (1, 1, 1)
    out = pii.sanitise(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    text = out.where("doc_id = 10").first()
    assert text["text"].startswith("mail me: <EMAIL> or <PHONE>, <IP>") and text["n_chars"] == len(text["text"])
    assert pii.report(empty).count() == 0 and pii.sanitise(empty).count() == 0


# ------------------------------------------------------------------ secrets


def test_secrets_are_told_from_lookalikes(spark):
    random.seed(5)
    key = lambda: "AKIA" + "".join(random.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows = []
    for i in range(120):
        rows.append((i, f"some words here {key()} and more words", "src1"))
        rows.append((1000 + i, f"call number {random.randrange(10**15, 10**16)} THEWORDSAREHERE and more", "src2"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets_forest.scan(docs)
    labels = secrets_forest.label_by_form(found).where("doc_id % 2 = 0")
    out = secrets_forest.classify(found, labels).where("doc_id % 2 = 1").collect()
    right = sum(r["is_secret"] == (r["doc_id"] < 1000) for r in out)
    assert len(out) >= 180 and right / len(out) > 0.97


@pytest.mark.parametrize("text, secret", [
    ("key sk_live_AbCdEfGhIjKlMnOpQr here", "sk_live_AbCdEfGhIjKlMnOpQr"),
    ("raw AbCd/EfGh+IjKl-MnOp_Qr here", "AbCd/EfGh+IjKl-MnOp_Qr"),
    ("password=p.a!s$s@w=1 next", "p.a!s$s@w=1"),
    ("PASSWORD: x", "x"),
    ('{"api_key": "two words, 7", "b": 1}', "two words, 7"),
    ("token = 'it\\'s' and", "it\\'s"),
    ("secret: password: hunter2, then", "hunter2"),
    ('pwd="open', "open"),
    ("passwd := päss", "päss"),
])
def test_secret_is_a_candidate(text, secret):
    assert secret in [text[a:b] for a, b in secrets_forest.candidates(text)]


def test_candidates_take_linear_time():
    for text in ("token=" * 50000, "token " + " " * 300000, 'token="' * 40000, "token = '" + "a" * 300000, "Ab-" * 100000):
        secrets_forest.candidates(text)


def test_short_passwords_are_found(spark):
    random.seed(6)
    sign = lambda n: "".join(random.choice("abcdefgh2345678!$@.") for _ in range(n))
    rows = []
    for i in range(120):
        rows.append((i, f"log in with password={sign(9)}a1 and go on", "src1"))
        rows.append((1000 + i, f"call number {random.randrange(10**15, 10**16)} THEWORDSAREHERE and more", "src2"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets_forest.scan(docs)
    assert found.where("doc_id < 1000").select("doc_id").distinct().count() == 120
    labels = secrets_forest.label_by_form(found).where("doc_id % 2 = 0")
    out = secrets_forest.classify(found, labels).where("doc_id % 2 = 1 and end - start = 11 and doc_id < 1000").collect()
    assert len(out) == 60 and all(r["is_secret"] for r in out)


def test_secrets_edges(edge, empty, spark):
    found = secrets_forest.scan(edge)
    out = secrets_forest.classify(found, secrets_forest.label_by_form(found))
    assert out.where("is_secret and probability is null").count() == out.count()
    none = secrets_forest.scan(empty)
    assert secrets_forest.classify(none, secrets_forest.label_by_form(none)).count() == 0
    assert secrets_forest.scan(spark.createDataFrame([(1, "abcDEF123456789")], "doc_id long, text string")).count() == 1


# ------------------------------------------------------------------ memory of a batch


@pytest.mark.parametrize("full", [True, False])
def test_a_batch_takes_the_memory_of_a_part(full):
    rng = random.Random(3)
    some = ["".join(rng.choices("abcdeinorsté", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(some, k=300)) + f" x{i}@example.org" for i in range(2000)]
    batch = pa.record_batch({"doc_id": range(2000), "_row": range(2000), "text": texts})
    del texts
    pieces.worker_encoder(MODEL)
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in pieces._rows(MODEL, full)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000
    assert peak < 24e6
