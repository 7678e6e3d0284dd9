"""Sharding and fingerprints."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewise.llm import sharding, winnowing

TREE = sharding.uniform_tree(2, 2, 4)


def test_every_row_once_and_slots_without_gaps(edge):
    rows = sharding.shard_documents(edge, TREE, sharding.grow(TREE, 1, 0, 16)).collect()
    assert len(rows) == edge.count()
    by = defaultdict(list)
    shards = defaultdict(set)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        shards[r["doc_id"]].add(r["shard"])
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(len(s) == 1 for s in shards.values())
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in edge.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == want


def test_growth_moves_rows_into_the_new_shard_only(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    tree = TREE
    for shard, rack in ((16, 0), (17, 0), (18, 1)):
        more = sharding.grow(tree, 1, rack, shard)
        moved = sharding.assign(sharding.assign(keys, "doc_id", tree, "old"), "doc_id", more, "new").where("old <> new")
        assert [r["new"] for r in moved.select("new").distinct().collect()] == [shard]
        share = moved.count() / 20000
        assert abs(share - 1 / len(more)) < 0.01
        tree = more


def test_weights_and_confined_movement(spark):
    keys = spark.range(20000).withColumnRenamed("id", "doc_id")
    heavy = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in TREE]
    both = sharding.assign(sharding.assign(keys, "doc_id", TREE, "old"), "doc_id", heavy, "new")
    got = {r["new"]: r["count"] for r in both.groupBy("new").count().collect()}
    assert abs(got[5] / 20000 - 3 / 18) < 0.015
    # shard 5 is in region 0, rack 1: nothing moves inside the other region, or out of the changed rack
    assert both.where("old <> new and old >= 8 and new >= 8").count() == 0
    assert both.where("old between 4 and 7 and new not between 4 and 7").count() == 0


def test_sharding_empty(empty):
    assert sharding.shard_documents(empty, TREE).count() == 0


def slow_winnow(text, k, w):
    g = winnowing.grams(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), k) >> np.uint64(32)
    kept = set()
    for i in range(max(1, len(g) - w + 1)):
        win = g[i : i + w].tolist()
        j = max(x for x in range(len(win)) if win[x] == min(win))
        kept.add(i + j)
    return sorted(kept), [int(g[i]) for i in sorted(kept)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé ", min_size=1, max_size=80), st.integers(1, 13), st.integers(1, 9))
def test_winnowing_against_every_window(text, k, w):
    h, p = winnowing.winnow(text, k, w)
    want_p, want_h = slow_winnow(text, k, w)
    assert p.tolist() == want_p and h.tolist() == want_h
    a, b = winnowing.decode(winnowing.encode(h, p))
    assert a.tolist() == h.tolist() and b.tolist() == p.tolist()


@settings(max_examples=40, deadline=None)
@given(st.text("abcdef", max_size=60), st.text("abcdef", min_size=16, max_size=30), st.text("ghij", max_size=60))
def test_shared_span_is_never_missed(left, span, right):
    k, w = 8, 9  # guarantee: 16 characters
    a, _ = winnowing.winnow(left + span, k, w)
    b, _ = winnowing.winnow(span + right, k, w)
    assert set(a.tolist()) & set(b.tolist())


def test_grams_are_equal_for_equal_runs():
    a = winnowing.grams(np.arange(40, dtype=np.uint32), 12)
    b = winnowing.grams(np.arange(5, 40, dtype=np.uint32), 12)
    assert (a[5:] == b).all()


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_edited_copies_follow_descending_ids(spark, docs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r for r in winnowing.edited_copies(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["fingerprint"] == winnowing.encode(*winnowing.winnow(t))
        assert got[d]["near_next"] == winnowing.likeness(*(np.unique(winnowing.winnow(x)[0]) for x in (t, nxt)))


def test_edited_copies_edges(edge, empty):
    rows = winnowing.edited_copies(edge).collect()
    assert len(rows) == edge.count()
    same = {r["fingerprint"] for r in rows if r["doc_id"] == 3}
    assert len(same) == 1
    assert all(r["fingerprint"] == "" for r in rows if r["n_chars"] == 0)
    assert winnowing.edited_copies(empty).count() == 0
    one = winnowing.edited_copies(edge.where("doc_id = 7")).collect()
    assert one[0]["near_next"] == 1.0
    assert winnowing.fingerprints(edge).where("fingerprint is null").count() == 0
