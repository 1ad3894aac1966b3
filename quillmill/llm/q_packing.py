"""Query op1_packing: all documents in sequences of at most 2048 ids."""

from pyspark.sql import DataFrame, SparkSession

from .packing import pack
from .shared import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op1_packing": op1_packing}

#: Encoding a text isn't expressible in SQL.
ORACLE_SQL: dict[str, str] = {}
