"""N-gram join, decontamination, language model, quality, pipeline."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sitewise.llm import decontaminate, gate, hmm, ngram_join, ordinal, textbytes
from sitewise.llm.textbytes import text_chunks, words

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return (text or "").encode().translate(FOLD).split()


def test_word_hashes_do_not_depend_on_their_place():
    texts = ["a bb  ccc", "", "É Ab", None, "ab", "ccc\x0bbb\x1fa"]
    want = [plain_words(t) for t in texts]
    for size in (1, 4, 1000):
        got = []
        for _, buf, off in text_chunks(pa.array(texts), size):
            h, n, _ = words(buf, off)
            got += np.split(h, np.cumsum(n)[:-1])
        assert [len(g) for g in got] == [len(w) for w in want]
        seen = {}
        for g, w in zip(got, want, strict=True):
            for x, y in zip(g.tolist(), w, strict=True):
                assert seen.setdefault(y, x) == x
        assert len(set(seen.values())) == len(seen)


def test_gate_lets_every_key_through(spark):
    keys = spark.range(1000).selectExpr("id * 7919 - 3000000 as k")
    g = gate.gate(keys, "k")
    assert g.test(np.arange(1000) * 7919 - 3000000).all()
    assert g.test(np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 10000)).mean() < 0.01
    df = spark.range(1000).selectExpr("id * 7919 - 3000000 as k")
    assert df.where(gate.passes(df, df["k"], g)).count() == 1000
    assert not gate.gate(keys.where("k = 1"), "k").test(np.arange(10)).any()


# ------------------------------------------------------------------ n-gram join


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = plain_words(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in sets}


def families(seed):
    """Copies with few and many changes, shared passages, chains, short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5)))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([3, 6, 9, 14, 40, 120]))]
        if rng.random() < 0.5:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.randint(1, 9)):
            rows.append(list(base))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                base = list(base)
                base[rng.randrange(len(base))] = word()
    for i in range(30):  # texts that are little more than the passage
        rows.append(passage + [f"x{i % 4}"] * rng.randint(1, 4))
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_all_pairs(spark, seed):
    rows = families(seed)
    want = plain_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("shift", [-1, -60])
def test_components_of_negative_ids(spark, shift):
    """Ids around and below zero: no id is a mark of its group."""
    rows = [(i + shift if shift < -1 else -1 - i, t) for i, t in families(4)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(rows)


def test_join_edges(edge, empty):
    got = ngram_join.link_documents(edge).collect()
    assert len(got) == edge.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == by[2] == by[3] == {(8, 1)}
    assert by[4] == {(0, 4)} and by[5] == {(0, 5)} and by[6] == {(0, 6)} and by[7] == {(1, 7)}
    assert {c for _, c in by[8] | by[9]} == {8}
    assert by[None] == {(4, None), (0, None)}
    kept = ngram_join.keep_first(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "8", "10", "None", "None"])
    assert ngram_join.link_documents(empty).count() == 0


def test_no_pair_is_made_inside_a_large_family(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 190 - i % 7], f"q{i}", *base[190 - i % 7 :]])) for i in range(600)]
    sizes = []
    real = ngram_join.verified
    ngram_join.verified = lambda r, p: (sizes.append(p.count()), real(r, p))[1]
    try:
        got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        ngram_join.verified = real
    assert {r["component_id"] for r in got} == {0}
    assert sum(sizes) < 3 * 600


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 200), (300, 299), (299, 298)]
    got = {r["id"]: r["comp"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in [*range(41), 200]} == {0} and {got[100 + i] for i in range(30)} == {100} and {got[i] for i in (298, 299, 300)} == {298}


# ------------------------------------------------------------------ decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, bench):
    items = [(i, WORD.findall((t or "").encode().translate(FOLD).decode())) for i, t in bench]
    windows = defaultdict(set)
    for i, w in items:
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    lengths = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").encode().translate(FOLD).decode())
        hit, names = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[x]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def test_hits_against_every_window(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "cc", "É", "é", "9", "x-y"])
    bench = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 12, 25])))) for i in range(12)] + [(50, ""), (51, None), (50, "a A, a.")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            item = rng.choice(bench)[1] or ""
            w[rng.randint(0, len(w)) : 0] = item.upper().split()[rng.choice([0, 0, 1]) :]
        docs.append((i, " ".join(w)))
    docs += [(3, "a b"), (None, "a " * 30), (99, None)]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(plain_hits(docs, bench), key=str)


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    out = decontaminate.drop_contaminated(edge, bench)
    assert out.columns == edge.columns
    assert sorted({r["doc_id"] for r in out.collect()}, key=str) == sorted([4, 5, 6, 7, 8, 9, 10, None], key=str)
    assert decontaminate.contamination(edge, bench).count() == edge.count()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(edge, bench.where("item_id = 2")).where("contaminated").count() == 0


# ------------------------------------------------------------------ language model


def test_base_is_exact_and_model_beats_it_on_held_out_texts(docs):
    got = {r["doc_id"]: r for r in hmm.train_and_score(docs).collect()}
    tokens = {r["doc_id"]: [*plain_words(r["text"]), None] for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(x for d, t in tokens.items() if not held[d] for x in t)
    n, v = sum(c.values()), len(c)
    for d, t in tokens.items():
        want = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)
        assert got[d]["base_score"] == pytest.approx(want, rel=1e-9)
        assert (got[d]["held_out"], got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (held[d], len(t), sum(c[x] > 0 for x in t), n)
    out = [d for d in tokens if held[d]]
    assert sum(got[d]["score"] for d in out) > sum(got[d]["base_score"] for d in out)


def small_model(k=3, symbols=300):
    rng = np.random.default_rng(1)
    emit, move, start = rng.random((symbols, k)), rng.random((k, k)), rng.random(k)
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def test_forward_against_all_paths():
    m = small_model()
    rng = np.random.default_rng(2)
    n = np.array([1, 5, 3, 5])
    sym = rng.integers(0, 300, n.sum()).astype(np.int32)
    got = hmm.forward(m, sym, n)
    for i, part in enumerate(np.split(sym, np.cumsum(n)[:-1])):
        total = 0.0
        for path in np.ndindex(*[3] * len(part)):
            p = m.start[path[0]] * m.emit[part[0], path[0]]
            for a, b, s in zip(path, path[1:], part[1:], strict=False):
                p *= m.move[a, b] * m.emit[s, b]
            total += p
        assert got[i] == pytest.approx(math.log10(total))
    assert hmm.forward(m, np.array([], np.int32), np.array([], np.int64)).shape == (0,)


def test_rounds_raise_the_likelihood():
    m = small_model(symbols=20)
    rng = np.random.default_rng(3)
    n = np.array([4, 30, 17])
    sym = rng.integers(0, 20, n.sum()).astype(np.int32)
    runs = hmm.runs_of(sym, n)
    before = hmm.expected_counts(m, *runs)
    assert before[0].sum() == pytest.approx(n.sum(), rel=1e-4) and before[2].sum() == pytest.approx(len(n), rel=1e-4)
    assert before[1].sum() == pytest.approx((n - 1).sum(), rel=1e-4)
    after = hmm.Model(before[2] / before[2].sum(), before[1] / before[1].sum(axis=1, keepdims=True), before[0] / before[0].sum(axis=0))
    assert hmm.expected_counts(after, *runs)[3] > before[3]
    assert hmm.forward(m, sym, n).sum() == pytest.approx(before[3] / math.log(10), rel=1e-4)


def test_words_of_a_class_share_its_probability():
    v = hmm.Vocabulary(10, 5, np.array([1, 5, 9]), np.array([3, 1, 2]), np.array([5]), np.ones(hmm.CLASSES))
    sym = v.symbol(np.array([5, 9, 7]), np.array([0, 3, 255], np.int32))
    assert sym.tolist() == [1 + hmm.CLASSES, 4, 256]


def test_language_model_edges(edge, empty):
    rows = hmm.train_and_score(edge).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {1}
    assert hmm.train_and_score(empty).count() == 0
    alone = hmm.train_and_score(edge.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert all(r["score"] == r["base_score"] and r["train_tokens"] == 0 for r in alone)


# ------------------------------------------------------------------ quality


def test_gradient_of_the_ordinal_fit_and_order_of_thresholds():
    rng = np.random.default_rng(0)
    slots = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(600)]
    truth = np.where(np.arange(50) < 10, -1.5, 0.3)
    score = np.array([truth[s].sum() for s in slots])
    grades = np.digitize(score + rng.logistic(size=600) * 0.3, [-2.0, 0.5])
    m = ordinal.fit(slots, grades, 3, l2=0.1)
    assert (np.diff(m.thresholds) > 0).all()
    tails = m.tails(m.score(slots))
    assert (np.diff(tails, axis=1) <= 0).all()
    assert (np.round(tails.sum(axis=1)) == grades).mean() > 0.8


def test_selection_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ratings = ordinal.ratings_of(spark.read.parquet(f"{sf}/labels.parquet"))
    model = ordinal.fit_documents(docs, ratings.where("doc_id % 4 <> 1"), 3)
    held = docs.join(ratings.where("doc_id % 4 = 1"), "doc_id").select("doc_id", "text", "grade")
    rows = ordinal.score_documents(held, model, 2, 0.6).collect()
    good = [r["selected"] for r in rows if r["grade"] == 2]
    bad = [r["selected"] for r in rows if r["grade"] < 2]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, None, 1), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = ordinal.fit_documents(edge, ordinal.ratings_of(labels), 3)
    out = ordinal.score_documents(edge, model, 2)
    assert out.count() == edge.count() and out.where("tail_probability is null").count() == 0
    assert ordinal.select_documents(edge, None, 2).columns == edge.columns
    assert ordinal.fit_documents(edge, ordinal.ratings_of(labels.where("doc_id = -5")), 3) is None
    assert ordinal.score_documents(edge, None, 2).where("selected").count() == edge.count()
    assert ordinal.score_documents(empty, model, 2).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_against_its_operators_on_plain_rows(spark, docs):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    model = ordinal.fit_documents(docs, ordinal.ratings_of(spark.read.parquet(f"{sf}/labels.parquet")), 3)
    kept = {r["doc_id"] for r in ordinal.score_documents(docs, model, 2, cp.LEVEL).where("selected").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    comp = plain_components(sorted(texts.items()))
    texts = {d: t for d, t in texts.items() if comp[d][1] == d}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {h[0]: texts[h[0]] for h in plain_hits(sorted(texts.items()), bench) if not h[5]}
    out = {r["doc_id"]: r for r in cp.run(spark, sf).collect()}
    assert set(out) == set(texts)
    from sitewise.llm import pii

    for d, r in out.items():
        if not pii.entities(texts[d]):
            assert r["decoded"] == texts[d]
        else:
            assert not pii.entities(r["decoded"])


def test_pipeline_stages_keep_the_columns_and_take_edges(spark, edge, empty):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_copies", "benchmark_passages", "personal_data", "tokens"]
    for rows in (edge, empty):
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, rows, "/root/testdata/sf0.001").columns == rows.columns
        assert cp.STAGES[-1][1](spark, rows, "/root/testdata/sf0.001").count() == rows.count()


@pytest.mark.parametrize("step", [ngram_join._sketch, ordinal._slots])
def test_a_batch_takes_the_memory_of_a_chunk(step, monkeypatch):
    """Workers keep what they once took, so a large batch must not raise it."""
    monkeypatch.setattr(textbytes, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    monkeypatch.setattr(ngram_join, "SLOTS", 1 << 12)
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 500, 300)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "grade": pa.array([0] * len(texts), pa.int32())})
    assert batch.nbytes > 2_000_000
    tracemalloc.start()
    rows = sum(b.num_rows for b in step([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 13_000_000
