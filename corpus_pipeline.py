"""From raw documents to packed sequences: toxic documents go, then copies, then near copies; the rest is mixed and packed.

Each stage is a function of (spark, docs, sf_dir) over all rows that its predecessor kept, and all but the last return
the columns of documents. Rules for odd rows are those of the operators (see quillmill.llm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.exact_dedup import keep_one
from quillmill.llm.mixing import mix
from quillmill.llm.ngram_join import ngram_join
from quillmill.llm.packing import pack, token_counter
from quillmill.llm.q_mixing import KEEP, TARGETS
from quillmill.llm.q_packing import tokenizer_path
from quillmill.llm.shared import Scratch, rows_that_stay, table
from quillmill.llm.toxicity import ToxicityModel, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the classifier learns from the labels of documents in ``docs``."""
    return without_toxic(docs, ToxicityModel.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    return keep_one(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram similarity of 0.8 and more the one with the smallest doc_id."""
    decided = ngram_join(docs).select("doc_id", "sha", "kept")
    return rows_that_stay(docs, decided, Scratch(spark, "near-dedup-rows"), "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens, as packing counts them, meet the targets by source, language and topic."""
    _, _, stays = mix(docs, TARGETS, KEEP, tokens=token_counter(tokenizer_path()))
    return docs.filter(stays)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids, a row for each piece."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Training, hashing to bands and encoding aren't expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what lies between stages is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
