"""Query op8_html_extraction: the main text of every page."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_wrappers import extract
from .shared import table


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op8_html_extraction": op8_html_extraction}

#: Wrapper inference isn't expressible in SQL; the tests hold it against pages whose text is known.
ORACLE_SQL: dict[str, str] = {}
