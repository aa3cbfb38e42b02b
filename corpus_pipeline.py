"""From raw documents to packed training sequences: each stage reads what the one before has written.

Stages keep all columns of the documents; the last returns the pieces of the token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from llm.common import bounded, saved, table
from llm.queries import END_ID, SEQUENCE, VOCABULARY

#: Share of the tokens that documents of each quality shall have; documents are repeated for it, none is dropped.
QUALITY = {"good": 0.85, "poor": 0.15}


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.7, learnt from the labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels), threshold=0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    bounded(spark)
    return exact_dedup.drop_exact(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more that with the smallest doc_id."""
    bounded(spark)
    return jaccard_join.drop_near(docs, width=5, num=80, den=100)


def balanced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the qualities' expected tokens are in the ratio of ``QUALITY``; each stays at least once."""
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    mixture = mixing.mixed(docs, table(spark, sf_dir, "labels"), domain, QUALITY, least=1.0)[1]
    return mixing.resampled(docs, mixture)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most ``SEQUENCE`` tokens."""
    bounded(spark)
    return packing.pack(packing.token_pieces(docs, end_id=END_ID, capacity=SEQUENCE, **VOCABULARY), SEQUENCE)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("near duplicates", dissimilar), ("mixing", balanced), ("packing", packed)]

#: A trained classifier, tokenisers and packing have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
