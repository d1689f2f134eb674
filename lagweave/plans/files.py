"""Report files of sweeps, searches, tests and cases: small tables as CSV, summaries as Markdown, settings as JSON.

Equal results give equal bytes: rows are ordered, figures have ten decimals, lines end with
a newline. Tables are reports of at most ``MOST_ROWS`` rows; large ones go through
``sinks.write_csv``.
"""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import cases, sinks
from ..sources.panel import month_label

MOST_ROWS = 100_000


def _names(joined: str) -> list[str]:
    return [x for x in joined.split(";") if x]


def own_columns(table: DataFrame) -> list[str]:
    """A report's columns: those of its frame. The series is the report's subject."""
    return [c for c in table.columns if c != "series_id"]


def page(title: str, table: DataFrame, order: list[str | Column], notes: list[str]) -> str:
    """A Markdown page of a small frame, followed by paragraphs; empty ones are left out."""
    body = sinks.markdown(table.orderBy(*order).select(*own_columns(table)), title)
    return body + "".join(f"\n{note}\n" for note in notes if note)


def csv_text(table: DataFrame, columns: tuple[str, ...] | list[str], order: list[str | Column]) -> str:
    """A header and a line for each row, in order; figures have ten decimals, arrays of figures too, booleans are lower case."""
    shown = []
    for c in columns:
        kind = table.schema[c].dataType.simpleString()
        shown.append(F.transform(c, lambda x: F.format_string("%.10f", x)).alias(c) if kind == "array<double>" else F.col(c))
    rows = sinks.printable(table.orderBy(*order).select(*shown)).take(MOST_ROWS + 1)
    if len(rows) > MOST_ROWS:
        raise ValueError("a report is for small tables")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue()


def _put(folder: str, **files: str) -> list[Path]:
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = []
    for name, text in files.items():
        path = Path(folder) / name.replace("__", ".")
        path.write_bytes(text.encode("utf-8"))
        paths.append(path)
    return paths


def _one_series(*tables: DataFrame) -> None:
    for table in tables:
        if table.select("series_id").distinct().limit(2).count() > 1:
            raise ValueError("a report is about one series")


def _dated(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("date", month_label(F.col("t")))


def write_sweep(folder: str, config: cases.CaseConfig, metrics: DataFrame, predictions: DataFrame) -> list[Path]:
    """sweep_metrics.csv, sweep_predictions.csv and sweep_summary.md of one case's budget sweep."""
    _one_series(metrics, predictions)
    falling = [F.col("budget").desc()]
    named = metrics.withColumn("budget", F.format_string("%.2f", "budget"))
    shown = _dated(predictions).join(metrics.select("budget", "fit_status", "used_sources"), "budget").withColumn("budget", F.format_string("%.2f", "budget"))
    brief = named.select("series_id", *[c for c in own_columns(named) if not c.endswith("sources")])
    about = f"{config.case_name} predicts {config.target} from at most {config.max_selected_signals} of {len(config.candidate_signals)} signals and {config.lag_window} lags."
    return _put(
        folder, sweep_metrics__csv=csv_text(named, own_columns(named), falling),
        sweep_predictions__csv=csv_text(shown, ["budget", "date", "actual", "persistence", "predicted", "fit_status", "used_sources"], [*falling, "t"]),
        sweep_summary__md=page("Budgets and errors", brief, falling, [about, "Empty cells are figures of models that a budget doesn't have.", config.notes]),
    )


def write_search(folder: str, case: cases.AdaptiveCase, grid: DataFrame, best: DataFrame) -> list[Path]:
    """search_grid.csv and selection.json of one case's validation search: the chosen cell's columns, which ``cases.load_selection`` reads."""
    _one_series(grid, best)
    cell = best.first().asDict()
    record = {"case_name": case.case_name, "test_evaluated": False} | {cases.SELECTED.get(c, c): _names(v) if isinstance(v, str) and c.endswith("sources") else v for c, v in cell.items() if c != "series_id"}
    if cell["mode"] == "baseline_only":
        record["selected_sources"] = []
    rest = ["threshold", "lag_window", "cap"]
    return _put(folder, search_grid__csv=csv_text(grid, own_columns(grid), rest), selection__json=json.dumps(record, indent=2, sort_keys=True) + "\n")


def write_frozen_test(folder: str, case: cases.AdaptiveCase, metrics: DataFrame, predictions: DataFrame) -> list[Path]:
    """frozen_metrics.csv, frozen_predictions.csv and frozen_summary.md of one case's test."""
    _one_series(metrics, predictions)
    note = f"{case.case_name}: the cell was fixed before these rows were read, and not changed after the test."
    plain = metrics.drop("coefficients")
    return _put(
        folder, frozen_metrics__csv=csv_text(metrics, own_columns(metrics), ["lag_window"]), frozen_predictions__csv=csv_text(_dated(predictions), ["date", "actual", "persistence", "predicted"], ["t"]),
        frozen_summary__md=page("Test of a frozen cell", plain, ["lag_window"], [note]),
    )


def write_real_case(folder: str, config: cases.CaseConfig, frames: dict[str, DataFrame]) -> list[Path]:
    """Ranking, metrics, predictions, resources and summary of ``sweep.real_case``."""
    _one_series(*frames.values())
    made = [r["name"] for r in frames["metrics"].select("name").collect()]  # three at most
    order = F.when(F.col("name") == "persistence", 0).when(F.col("name") == "model", 1).otherwise(2)
    model = frames["model"].first()
    used = "; ".join(f"{k}: {v}" for k, v in model.asDict().items() if k not in ("series_id", "coefficients") and v) if model else "No source is kept."
    columns = ["date", "actual", "persistence", *[c for c in ("model", "seasonal") if c in made]]
    return _put(
        folder, ranking__csv=csv_text(frames["ranking"], ["rank", "source", "lag", "weight", "score", "sample_count", "selected"], ["rank"]), metrics__csv=csv_text(frames["metrics"], ["name", "mae", "rmse", "n"], [order]),
        predictions__csv=csv_text(_dated(frames["predictions"]), columns, ["t"]), resources__csv=csv_text(frames["resources"], ["budget", "threshold", "retained", "compute", "memory", "sources"], [F.col("budget").desc()]),
        summary__md=page(f"Forecasts of {config.target}", frames["metrics"], [order], [used, config.notes]),
    )


def write_case(folder: str, panel: DataFrame, settings: dict, sources: list[dict] | None = None, text: str | None = None) -> str:
    """data.csv of one panel, case.json and perhaps source_manifest.json and methodology.md, as ``cases.load_case`` and ``signal_metadata`` read them; gives the data's digest.

    settings: fields of a case; target and candidates must be signals of the panel. The
    digest is appended to the notes.
    """
    _one_series(panel)
    variables = [settings["target"], *settings["candidate_signals"]]
    data = sinks.snapshot_csv(panel, variables)
    digest = sinks.snapshot_hash(data)
    config = settings | {"csv": "data.csv", "date_column": "date", "notes": f"{settings.get('notes', '')} Data SHA-256: {digest}.".strip()}
    files = {"data__csv": data, "case__json": json.dumps(config, indent=2, sort_keys=True) + "\n"}
    if sources is not None:
        months = [line[:7] for line in data.splitlines()[1:]]
        covered = {"start": months[0], "end": months[-1], "months": len(months)} if months else None
        files["source_manifest__json"] = json.dumps({"coverage": covered, "sha256": digest, "series": sources}, indent=2, sort_keys=True) + "\n"
    if text is not None:
        files["methodology__md"] = text.rstrip("\n") + "\n"
    _put(folder, **files)
    return digest


def availability(panel: DataFrame, start: str, end: str) -> DataFrame:
    """Whether each signal has every month from start to end: (series_id, signal, months, expected, first, last, available)."""
    low, high = cases.month(start), cases.month(end)
    rows = panel.where(F.col("value").isNotNull() & F.col("t").between(low, high)).groupBy("series_id", "signal").agg(F.count_distinct("t").alias("months"), month_label(F.min("t")).alias("first"), month_label(F.max("t")).alias("last"))
    every = panel.select("series_id", "signal").distinct().join(rows, ["series_id", "signal"], "left")
    months = F.coalesce("months", F.lit(0))
    return every.select("series_id", "signal", months.alias("months"), F.lit(high - low + 1).alias("expected"), "first", "last", (months == high - low + 1).alias("available"))


def write_availability(folder: str, table: DataFrame) -> list[Path]:
    return _put(folder, availability__csv=csv_text(table, ["signal", "months", "expected", "first", "last", "available"], ["signal"]))


def write_panel(folder: str, panel: DataFrame, name: str = "series") -> list[Path]:
    """One panel's canonical CSV."""
    _one_series(panel)
    variables = sorted(r[0] for r in panel.select("signal").distinct().collect())
    return _put(folder, **{f"{name}__csv": sinks.snapshot_csv(panel, variables)})


def write_weights(folder: str, timed: DataFrame, name: str = "weights") -> list[Path]:
    """A trajectory's weights: a line for each step and source."""
    _one_series(timed)
    return _put(folder, **{f"{name}__csv": csv_text(timed.withColumn("date", month_label(F.col("step"))), ["date", "source", "target", "lag", "weight", "score", "sample_count"], ["step", "source"])})


def check_cutoff(expanding: DataFrame, step: int, sources: list[str], count: int | None = None) -> dict[str, float]:
    """The weights of the best sources at a step, which must be the given ones."""
    order = [F.round("score", 12).desc(), "source"]
    found = {r["source"]: r["weight"] for r in expanding.where(F.col("step") == step).orderBy(*order).limit(count or len(sources)).collect()}
    if {*found} != {*sources}:
        raise ValueError(f"the best sources are {', '.join(sorted(found))}")
    return found
