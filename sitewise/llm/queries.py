"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewise.llm import automaton, chat, decontaminate, hmm, lexical, ngram_join, ordinal, pieces, pii, prefix_trie, secrets_forest, sharding, winnowing
from sitewise.llm.tables import read, tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark, sf_dir):
    """16 shards: 2 regions of 2 racks of 4 shards; growth adds one to a rack."""
    tree = sharding.uniform_tree(2, 2, 4)
    return sharding.shard_documents(read(spark, sf_dir, "documents"), tree, sharding.grow(tree, 1, 0, 16))


ORACLES["op1_sharding"] = sharding.ORACLE


@query
def op2_fingerprints(spark, sf_dir):
    return winnowing.edited_copies(read(spark, sf_dir, "documents"))


@query
def op3_chat(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns.unionByName(extra), tokenizer("byte_bpe_50k.json"))
    return chat.digests(out).drop("n_tokens", "n_loss_tokens")


ORACLES["op3_chat"] = chat.ORACLE


@query
def op4_pii(spark, sf_dir):
    return pii.report(read(spark, sf_dir, "documents"))


@query
def op5_ngram_join(spark, sf_dir):
    return ngram_join.link_documents(read(spark, sf_dir, "documents"))


ORACLES["op5_ngram_join"] = ngram_join.ORACLE


@query
def op6_decontaminate(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLES["op6_decontaminate"] = decontaminate.ORACLE


@query
def op7_sentencepiece(spark, sf_dir):
    return pieces.encode_digests(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query
def op8_hmm(spark, sf_dir):
    return hmm.train_and_score(read(spark, sf_dir, "documents"))


@query
def op9_secrets(spark, sf_dir):
    found = secrets_forest.scan(read(spark, sf_dir, "documents"))
    return secrets_forest.classify(found, secrets_forest.label_by_form(found))


@query
def op10_quality(spark, sf_dir):
    """Grade 2 (good and not toxic) is wanted with probability 0.6 or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit_documents(docs, ordinal.ratings_of(read(spark, sf_dir, "labels")), levels=3)
    return ordinal.score_documents(docs, model, keep_grade=2, level=0.6).drop("text")


@query
def op11_lexical_search(spark, sf_dir):
    """The 10 best documents of each benchmark item."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10)


ORACLES["op11_lexical_search"] = lexical.ORACLE


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = prefix_trie.ORACLE


@query
def op13_bpe(spark, sf_dir):
    compiled = automaton.compile_automaton(tokenizer("byte_bpe_50k.json"))
    return automaton.encode_digests(read(spark, sf_dir, "documents"), compiled)
