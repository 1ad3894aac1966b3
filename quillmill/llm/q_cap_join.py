"""Query op10_cap_join: links and components among all embeddings."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cap_join import cap_join
from .shared import table


def op10_cap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cap_join(table(spark, sf_dir, "embeddings"))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


QUERIES = {"op10_cap_join": op10_cap_join}

#: Reachability over all pairs of vectors is too slow in SQL on whole tables; the tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
