"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans import settle as settle_module


def shared_folder(spark: SparkSession) -> str:
    """The library's shared folder, which checkpoints are written to as well."""
    named = settle_module.shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(frame: DataFrame) -> DataFrame:
    """Compute a frame once and keep its rows in the shared folder, so that lost executors don't change them."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def plain(frame: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The frame with its columns called c0, c1, ... by position, and the new name of an old one.

    Steps that add columns of their own do so beside these, so that no name can clash or hold a dot.
    """
    names = {name: f"c{i}" for i, name in enumerate(frame.columns)}
    return frame.toDF(*names.values()), names.__getitem__
