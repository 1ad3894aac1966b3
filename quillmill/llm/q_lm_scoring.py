"""Query op6_lm_scoring: log10 probabilities of all documents, learnt from nine tenths of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lm_scoring import score_texts
from .shared import crc_of_id, table


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, crc_of_id(F.col("doc_id")) % 10 == 0)


QUERIES = {"op6_lm_scoring": op6_lm_scoring}

#: Training a hidden Markov model isn't expressible in SQL; the tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
