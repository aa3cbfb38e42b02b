"""The registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    exact_dedup, hard_negatives, jaccard_join, katz, mixing, packing, permutation_index, prefix_trie, pseudonyms, sharding,
    simhash, toxicity, training_order,
)
from llm.common import shared_folder, table

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


NEIGHBOURS = 10


@query("op1_permutation_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", NEIGHBOURS)


@query("op2_exact_dedup", sql=r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


#: What share of the tokens each domain shall have.
TARGETS = {"good": 0.7, "poor": 0.2, "toxic": 0.1}


@query("op4_soft_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), domain, TARGETS)[0]


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~out), label_col="toxic")
    return toxicity.scored(docs, model, threshold=0.7).select("doc_id", out.alias("held_out"), "score", "predicted")


PSEUDONYM_KEY = "for tests; keep the real one secret"


@query("op6_pseudonyms")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, PSEUDONYM_KEY, reversible=False).drop("text")


#: Public vocabulary files; their folder is that of the installed package, on every machine.
VOCABULARY = dict(vocabulary=public_tokenizers.path("byte_bpe_50k.json"),
                  ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
END_ID = 2
SEQUENCE = 1024


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), end_id=END_ID, capacity=SEQUENCE, with_ids=True, in_halves=True,
                                  **VOCABULARY)
    placed = packing.pack(pieces.drop("ids_crc32"), SEQUENCE, in_halves="ids")
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")  # of the ids as they came to their sequence


@query("op8_katz_backoff")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), folds=10, fold=0)
    model = katz.fit(docs.where(~out))
    return katz.scored(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


RECORDS = 4096


@query("op9_training_order")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_order.token_sequences(table(spark, sf_dir, "documents"), ["doc_id"], "text", SEQUENCE, END_ID, **VOCABULARY)
    laid = training_order.ordered(rows, ["doc_id", "piece"], key="epoch 0")
    return training_order.write_shards(laid, shared_folder(spark, "token-shards"), SEQUENCE, RECORDS)


SHARDS = 16


@query("op10_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS, "doc_id", seed=10)
    text = F.coalesce("text", F.lit(""))  # as it came to its shard
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                         F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation c takes its first h turns from conversation c - c % 20, with h = crc32(c) % 4."""
    conv = F.col("conv")
    return prefix_trie.branched(turns, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3)


@query("op11_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(rebuilt(prefix_trie.numbered(prefix_trie.digested(table(spark, sf_dir, "conversations")))))


@query("op12_hard_negatives")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mined(rows, F.expr("id % 50 = 0"), positives=5, negatives=3, lowest=50, highest=95, scale=256)


@query("op13_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"), width=3, radius=2, seed=42)
