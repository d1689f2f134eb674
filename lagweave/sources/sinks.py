"""Writers: tables as CSV with ten decimals, summaries as Markdown, selections as JSON, and canonical snapshots."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fixed10
from .panel import month_label


def printable(table: DataFrame) -> DataFrame:
    """Columns as text: figures with ten decimals, lists joined by semicolons, NULL empty."""
    out = []
    for f in table.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        text = fixed10(c.cast("double")) if kind in ("double", "float") else F.array_join(c.cast("array<string>"), ";") if kind.startswith("array") else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(f.name))
    return table.select(*out)


def write_csv(table: DataFrame, folder: str) -> None:
    """A folder of CSV files with a header."""
    printable(table).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def markdown(table: DataFrame, title: str, limit: int = 1000) -> str:
    """A report of a small table, which must have at most ``limit`` rows."""
    rows = printable(table).take(limit + 1)
    if len(rows) > limit:
        raise ValueError("a report is for small tables")
    lines = [f"# {title}", "", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in rows), ""])


def write_selection(path: str, cell: dict) -> None:
    """A frozen selection, for a test that is still to come; baseline_only where validation doesn't beat persistence."""
    mode = "baseline_only" if cell["validation_mae"] >= cell["persistence_mae"] else "model"
    Path(path).write_text(json.dumps(cell | {"mode": mode, "test_evaluated": False}, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def snapshot_csv(panel: DataFrame, variables: list[str]) -> str:
    """The canonical text of one monthly series: a header, then a line for each month."""
    wide = panel.groupBy("t").pivot("signal", variables).agg(F.first("value"))
    lines = wide.select("t", F.concat_ws(",", month_label(F.col("t")), *[fixed10(f"`{v}`") for v in variables]).alias("line")).orderBy("t")
    return "\n".join(["date," + ",".join(variables), *(r["line"] for r in lines.collect()), ""])


def snapshot_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
