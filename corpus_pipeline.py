"""The training-data pipeline: quality, language, line dedup, near-dedup, packing.

Each stage calls one operator of ``scanloom.llm`` and works on all that the stage before it kept:

1. ``quality``: documents that the classifier, learned from ``labels``, scores below 0.5 go.
2. ``language``: documents without an identified language (score below 0.5, or no letter) go.
3. ``line_dedup``: lines held by several documents stay in the first of them; texts are rewritten.
4. ``near_dedup``: of each group of near copies (five words, similarity 0.8) the first one stays.
5. ``packing``: what is left is tokenised and cut into sequences of 4096 tokens.

Null and empty texts, repeated rows and empty tables are defined by the operators. Documents with a
null id are never near copies to be dropped. Extra columns of the input do not pass stage 1.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.llm import language, line_dedup, minhash, packing, quality
from scanloom.llm.common import read_table, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    learned = quality.with_statistics(docs.filter(~quality.held_out("doc_id", 3, 1)))
    model = quality.fit(learned.join(labels, "doc_id"), "quality")
    return quality.keep_good(docs, model)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = language.learn(docs.filter(~quality.held_out("doc_id", 4, 2)), path)
    return language.keep_identified(docs.select(*COLUMNS), model, path)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(docs, words=5, num=80, den=100)
    copies = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(copies, "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

# Learned models and tokenisers cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
