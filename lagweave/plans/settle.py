"""Small intermediate tables, written to the shared folder so that later steps start from a short plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or else the context's; only a local master, as in tests, gets one made here."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.gettempdir() + "/lagweave"
    return named.rstrip("/")


def settle(table: DataFrame) -> DataFrame:
    """The rows of a table, computed once and read back from the shared folder."""
    path = f"{shared_folder(table.sparkSession)}/table-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
