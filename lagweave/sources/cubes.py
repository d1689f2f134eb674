"""A data source of statistical cubes: one partition a series, bounded attempts, and failures as columns.

The documents of a request are given with it, or fetched by the executors through an opener
that the caller brings, a picklable function of (address, seconds) that returns bytes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .cases import CaseError, CubeSeries

SCHEMA = "name string, dataset string, address string, json string, attempts int, error string"


@dataclass(frozen=True)
class Service:
    """Where cubes are, and how they are opened: so many attempts at each, with waits that double."""

    root: str
    opener: Callable[[str, float], bytes]
    attempts: int = 3
    wait: float = 0.5
    timeout: float = 120.0


class _Series(InputPartition):
    def __init__(self, name: str, dataset: str, address: str):
        super().__init__(name)
        self.name, self.dataset, self.address = name, dataset, address


def _attempt(service: Service, address: str) -> tuple[str | None, int, str | None]:
    """(document, attempts, error): one of document and error is None. What isn't a JSON object is an error that no further attempt mends."""
    error = None
    for attempt in range(1, service.attempts + 1):
        try:
            raw = service.opener(address, service.timeout)
        except OSError as e:  # of the network or the store
            error = f"{type(e).__name__}: {e}"
            if attempt < service.attempts:
                time.sleep(service.wait * 2 ** (attempt - 1))
            continue
        try:
            text = raw.decode("utf-8")
            return (text, attempt, None) if isinstance(json.loads(text), dict) else (None, attempt, "not a JSON object")
        except ValueError as e:
            return None, attempt, f"not JSON: {e}"
    return None, service.attempts, error


def fetched(spark: SparkSession, series: list[CubeSeries], service: Service, start: str, end: str) -> DataFrame:
    """(name, dataset, address, json, attempts, error) of every series: either a document or the last attempt's error. No failure ends the job."""
    if service.attempts < 1:
        raise ValueError("attempts must be positive")
    asked = [_Series(s.name, s.dataset, s.url(service.root, start, end)) for s in series]

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return asked

        def read(self, partition: _Series) -> Iterator[tuple]:
            yield (partition.name, partition.dataset, partition.address, *_attempt(service, partition.address))

    class Cubes(DataSource):
        @classmethod
        def name(cls) -> str:
            return "cubes"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Cubes)
    return spark.read.format("cubes").load()


def documents(spark: SparkSession, series: list[CubeSeries], given: dict[str, object], start: str, end: str, service: Service | None = None) -> DataFrame:
    """(name, dataset, json) of every series: given under its name or else its dataset, or fetched, once.

    A given document is an object, or its text. The first series by name without a document is an error.
    """
    here, rest = [], []
    for s in series:
        found = given.get(s.name, given.get(s.dataset))
        if found is None:
            rest.append(s)
        else:
            here.append((s.name, s.dataset, found if isinstance(found, str) else json.dumps(found)))
    for name, _, text in here:
        try:
            whole = isinstance(json.loads(text), dict)
        except ValueError as e:
            raise CaseError("invalid_cube", f"{name}: not JSON: {e}", name) from e
        if not whole:
            raise CaseError("invalid_cube", f"{name}: not a JSON object", name)
    rows = spark.createDataFrame(here, "name string, dataset string, json string")
    if not rest:
        return rows
    if service is None:
        raise CaseError("missing_cube", f"no document is given for {rest[0].name}, and no service", rest[0].name)
    from ..plans.settle import settle

    opened = settle(fetched(spark, rest, service, start, end))
    bad = opened.where("error is not null").orderBy("name").select("name", "error", "attempts").first()
    if bad is not None:
        raise CaseError("unreachable_cube", f"{bad['name']}: {bad['error']} ({bad['attempts']} attempts)", bad["name"])
    return rows.unionByName(opened.select(*rows.columns))


def updated(docs: DataFrame) -> dict[str, str]:
    """When each series' document says it was updated; empty where it doesn't."""
    return {r["name"]: r["u"] or "" for r in docs.select("name", F.get_json_object("json", "$.updated").alias("u")).collect()}  # one row a series
