"""Query op9_ngram_join: near copies among all documents, by sets of five words."""

from pyspark.sql import DataFrame, SparkSession

from .ngram_join import ngram_join
from .shared import table


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("sha")


QUERIES = {"op9_ngram_join": op9_ngram_join}

#: Joining all pairs of sets in SQL is too slow on whole tables; the tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
