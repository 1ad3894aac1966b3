"""Query op2_toxicity: a score for every document, learnt from four fifths of the labels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table
from .toxicity import ToxicityModel, held_out


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ToxicityModel.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out(F.col("id")))
    scored = model.scores(docs, F.col("text"), [F.col("doc_id")], "doc_id long")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {"op2_toxicity": op2_toxicity}

#: Training a network isn't expressible in SQL; the tests measure held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
