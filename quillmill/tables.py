"""Reading the driver's Parquet tables, and cutting the lineage of tables that several outputs share."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own checkpoint folder.

    Only a session in local mode that names none gets one of its own.
    """
    context = spark.sparkContext
    if not (held := context._jsc.sc().getCheckpointDir()).isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or "/tmp/checkpoints")
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` computed once, in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
