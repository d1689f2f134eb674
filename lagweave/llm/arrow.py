"""Running a function of text batches over a DataFrame, in Arrow batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged

#: Rows and bytes in a batch that Spark hands to Python, where the session has its defaults.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, unless the session already does."""
    for key, value, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, str(2**31 - 1))):
        if spark.conf.get(key, default) in (default, f"{default}b", f"{default}B"):
            spark.conf.set(key, str(value))


def map_texts(docs: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str, columns: list[str | Column], slice_bytes: int = ragged.SLICE_BYTES) -> DataFrame:
    """Apply ``function`` to slices of the given columns, of which one is called text.

    One pass without a shuffle. A slice has at most ``slice_bytes`` of text or is one
    row, so memory follows the longest text and not the partition.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, limit=slice_bytes):
                out = function(part)
                if isinstance(out, pa.Table):
                    yield from out.to_batches()
                elif out is not None:
                    yield out

    return docs.select(*columns).mapInArrow(run, schema)


def fold_texts(docs: DataFrame, start: Callable[[], object], add: Callable[[object, pa.Array], None], finish: Callable[[object], pa.RecordBatch | None], schema: str, text_column: str = "text", slice_bytes: int = ragged.SLICE_BYTES) -> DataFrame:
    """One state a partition: made by ``start``, changed by ``add`` for each slice of texts, given out once by ``finish``.

    One pass without a shuffle, for sums of bounded size over texts of any number.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for part in ragged.slices(batch, 0, slice_bytes):
                add(state, part.column(0))
        out = finish(state)
        if out is not None:
            yield out

    return docs.select(F.col(f"`{text_column}`").alias("text")).mapInArrow(run, schema)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int, bytes_of: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``keys``, cut only between runs of equal keys, in batches that reach about ``limit`` rows (or bytes of a column) where runs do.

    Keys are integers without nulls.
    """
    pending: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pending.append(batch)
        size += int(pc.sum(pc.binary_length(batch.column(bytes_of))).as_py() or 0) if bytes_of else batch.num_rows
        if size < limit:
            continue
        whole = pa.Table.from_batches(pending).combine_chunks().to_batches()[0] if len(pending) > 1 else batch
        change = changes(whole, keys)
        cut = int(change[-1])
        if cut:
            yield whole.slice(0, cut)
            whole = whole.slice(cut)
        pending = [whole]
        size = int(pc.sum(pc.binary_length(whole.column(bytes_of))).as_py() or 0) if bytes_of else whole.num_rows
    if pending:
        yield pa.Table.from_batches(pending).combine_chunks().to_batches()[0]


def changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The first row of each run of equal keys."""
    first = np.zeros(batch.num_rows, bool)
    first[:1] = True
    for key in keys:
        value = batch.column(key).to_numpy(zero_copy_only=False)
        first[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(first)


def filter_texts(docs: DataFrame, keeps: Callable[[pa.Array], np.ndarray], text_column: str = "text", slice_bytes: int = ragged.SLICE_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, whose texts ``keeps`` is true for. One pass without a shuffle."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, at, slice_bytes):
                yield part.filter(pa.array(keeps(part.column(at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_of_id(column: str) -> Column:
    """crc32 of an id written in decimal."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
