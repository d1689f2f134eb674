"""Case files: strict configurations, CSV panels, uploads, statistical cubes, and selection records.

Control data is small and read on the driver; observations are read by Spark. Nothing is
filled: a missing, repeated, malformed or infinite value is an error that names where it is.
"""

from __future__ import annotations

import base64
import csv
import hashlib
import io
import json
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.transforms import TRANSFORMS
from .panel import period_index


class CaseError(ValueError):
    """Input that breaks the contract. code names the rule, field the part of the input."""

    def __init__(self, code: str, message: str, where: str | None = None):
        super().__init__(message)
        self.code, self.message, self.where = code, message, where


class AxisError(CaseError):
    """A date axis with gaps or repeats; ``axis`` describes it as an audit does."""

    def __init__(self, code: str, message: str, where: str | None, axis: dict):
        super().__init__(code, message, where)
        self.axis = axis


@dataclass(frozen=True)
class CaseConfig:
    case_name: str
    csv: str
    date_column: str
    target: str
    candidate_signals: list[str]
    frequency: str
    lag_window: int
    train_end: str
    test_start: str
    max_selected_signals: int
    output_dir: str
    seasonal_period: int
    notes: str
    transform_declarations: dict[str, str] | None = None

    @property
    def variables(self) -> list[str]:
        """The target, then the candidates in order of name."""
        return [self.target, *sorted(self.candidate_signals)]

    def windows(self, spark: SparkSession) -> DataFrame:
        """(series_id, train_end, test_start) as the sweeps take it."""
        return window_table(spark, self.case_name, train_end=self.train_end, test_start=self.test_start)

    def check(self) -> None:
        month(self.train_end), month(self.test_start)
        rules = (
            (bool(self.case_name), "case_name", "a case needs a name"),
            (self.target not in self.candidate_signals, "target", "the target is a candidate"),
            (len({*self.candidate_signals}) == len(self.candidate_signals) > 0, "candidate_signals", "candidates must be unique and not empty"),
            (self.frequency == "monthly", "frequency", "only monthly cases are read"),
            (self.lag_window >= 1, "lag_window", "lag_window must be positive"),
            (1 <= self.max_selected_signals <= len(self.candidate_signals), "max_selected_signals", "the cap must be within the candidates"),
            (self.seasonal_period >= 0, "seasonal_period", "seasonal_period cannot be negative; 0 means none"),
            (self.train_end < self.test_start, "train_end", "training must end before the test"),
        )
        for ok, where, message in rules:
            if not ok:
                raise CaseError("invalid_config", message, where)
        if self.transform_declarations is not None:
            check_transforms(self.variables, self.transform_declarations)


@dataclass(frozen=True)
class AdaptiveCase:
    case_name: str
    csv: str
    date_column: str
    target: str
    candidate_signals: list[str]
    frequency: str
    train_start: str
    train_end: str
    validation_start: str
    validation_end: str
    test_start: str
    test_end: str
    relation_thresholds: list[float]
    lag_windows: list[int]
    max_selected_signals: list[int]
    output_dir: str
    notes: str
    transform_declarations: dict[str, str] | None = None

    @property
    def variables(self) -> list[str]:
        return [self.target, *sorted(self.candidate_signals)]

    def search_windows(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Training and validation windows, as ``sweep.validation_search`` takes them."""
        return window_table(spark, self.case_name, train_start=self.train_start, train_end=self.train_end), window_table(spark, self.case_name, validation_start=self.validation_start, validation_end=self.validation_end)

    def test_windows(self, spark: SparkSession) -> DataFrame:
        """The refit's window, training and validation together, and the test's."""
        return window_table(spark, self.case_name, train_start=self.train_start, train_end=self.validation_end, test_start=self.test_start, test_end=self.test_end)

    def check(self) -> None:
        ends = [self.train_start, self.train_end, self.validation_start, self.validation_end, self.test_start, self.test_end]
        [month(x) for x in ends]
        k = len(self.candidate_signals)
        rules = (
            (self.frequency == "monthly", "frequency", "only monthly cases are read"),
            (self.target not in self.candidate_signals, "target", "the target is a candidate"),
            (len({*self.candidate_signals}) == k > 0, "candidate_signals", "candidates must be unique and not empty"),
            (ends[0] <= ends[1] < ends[2] <= ends[3] < ends[4] <= ends[5], "train_start", "the windows must follow each other"),
            (bool(self.relation_thresholds) and all(0 <= x <= 1 for x in self.relation_thresholds), "relation_thresholds", "thresholds must be inside [0, 1]"),
            (bool(self.lag_windows) and all(x >= 1 for x in self.lag_windows), "lag_windows", "lag windows must be positive"),
            (bool(self.max_selected_signals) and all(1 <= x <= k for x in self.max_selected_signals), "max_selected_signals", "caps must be within the candidates"),
        )
        for ok, where, message in rules:
            if not ok:
                raise CaseError("invalid_config", message, where)
        if self.transform_declarations is not None:
            check_transforms(self.variables, self.transform_declarations)


@dataclass(frozen=True)
class FrozenSelection:
    mode: str
    threshold: float
    lag_window: int
    max_selected_signals: int
    selected_sources: list[str] = field(default_factory=list)
    test_evaluated: bool = False
    case_name: str = ""

    def cell(self, spark: SparkSession, case: AdaptiveCase) -> DataFrame:
        """The chosen cell of the case's series, as ``sweep.frozen_test`` takes it; the selection must be the case's own."""
        if self.case_name and self.case_name != case.case_name:
            raise CaseError("invalid_config", "the selection belongs to another case", "case_name")
        return spark.createDataFrame([(case.case_name, self.mode, self.lag_window, self.threshold, self.max_selected_signals)], "series_id string, mode string, lag_window int, threshold double, cap int")


_TYPES = {"str": str, "int": int, "list[str]": list, "list[float]": list, "list[int]": list, "dict[str, str] | None": dict, "float": float, "bool": bool}


def _strict(kind: type, given: dict, optional: tuple[str, ...] = ("transform_declarations",)):
    names = {f.name: f.type for f in fields(kind)}
    if unknown := sorted({*given} - {*names}):
        raise CaseError("invalid_config", f"unknown fields: {', '.join(unknown)}", unknown[0])
    if missing := sorted({*names} - {*given} - {*optional}):
        raise CaseError("invalid_config", f"missing fields: {', '.join(missing)}", missing[0])
    for name, value in given.items():
        want = _TYPES[str(names[name])]
        items = {"list[str]": str, "list[int]": int, "list[float]": (int, float)}.get(str(names[name]))
        ok = isinstance(value, (int, float) if want is float else want) and (want is bool or not isinstance(value, bool))
        if not ok or items and not all(isinstance(x, items) and not isinstance(x, bool) for x in value) or want is dict and not all(isinstance(x, str) for kv in value.items() for x in kv):
            raise CaseError("invalid_config", f"{name} has the wrong type", name)
    return kind(**given)


def load_case(path: str) -> CaseConfig:
    """A case's configuration; relative paths in it are relative to its folder."""
    config = _strict(CaseConfig, json.loads(Path(path).read_text(encoding="utf-8")))
    config.check()
    return CaseConfig(**{f.name: getattr(config, f.name) for f in fields(config)} | {k: str((Path(path).parent / getattr(config, k)).resolve()) for k in ("csv", "output_dir")})


def load_adaptive_case(path: str) -> AdaptiveCase:
    """As ``load_case`` for a case with validation windows and grids."""
    config = _strict(AdaptiveCase, json.loads(Path(path).read_text(encoding="utf-8")))
    config.check()
    return AdaptiveCase(**{f.name: getattr(config, f.name) for f in fields(config)} | {k: str((Path(path).parent / getattr(config, k)).resolve()) for k in ("csv", "output_dir")})


def window_table(spark: SparkSession, series_id: str, **months: str) -> DataFrame:
    """One row of month indexes: (series_id, train_end, ...)."""
    return spark.createDataFrame([(series_id, *map(month, months.values()))], ", ".join(["series_id string", *(f"{k} long" for k in months)]))


#: A selection's names of a cell's columns.
SELECTED = {"cap": "max_selected_signals", "used_sources": "selected_sources"}


def load_selection(path: str) -> FrozenSelection:
    """A frozen selection that hasn't been tested yet."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    chosen = FrozenSelection(**{f.name: given[f.name] for f in fields(FrozenSelection) if f.name in given})
    if given.get("test_evaluated") is not False:
        raise CaseError("already_evaluated", "the selection's test was evaluated before", "test_evaluated")
    if chosen.mode not in ("baseline_only", "model"):
        raise CaseError("invalid_config", "unknown mode", "mode")
    return chosen


def month(text: str) -> int:
    """The month index of YYYY-MM."""
    if len(text) != 7 or text[4] != "-" or not (text[:4] + text[5:]).isdigit() or not 1 <= int(text[5:]) <= 12:
        raise CaseError("invalid_month", f"{text!r} is not a month")
    return int(text[:4]) * 12 + int(text[5:])


def month_name(t: int) -> str:
    """YYYY-MM of a month index."""
    return f"{(t - 1) // 12:04d}-{(t - 1) % 12 + 1:02d}"


def axis_blocks(months: list[int]) -> dict:
    """The date axis of an audit: what is expected, present, missing and repeated."""
    seen = {*months}
    missing = [month_name(t) for t in range(min(seen), max(seen) + 1) if t not in seen] if seen else []
    repeated = [month_name(t) for t, n in sorted(Counter(months).items()) if n > 1]
    return {"continuous": not missing and not repeated, "expected_months": len(seen) + len(missing), "present": len(months), "missing_months": missing, "duplicate_months": repeated}


def month_axis(start: str, end: str) -> list[str]:
    return [f"{(t - 1) // 12:04d}-{(t - 1) % 12 + 1:02d}" for t in range(month(start), month(end) + 1)]


def check_transforms(variables: list[str], declared: dict[str, str]) -> dict[str, str]:
    """Each variable declared once, by a known transform; in the variables' order."""
    for where, names in (("missing", [v for v in variables if v not in declared]), ("unknown", sorted({*declared} - {*variables})), ("invalid", sorted(v for v in variables if declared.get(v) not in TRANSFORMS))):
        if names:
            raise CaseError("undeclared_transform", f"{where} transform declarations: {', '.join(names)}", names[0])
    return {v: declared[v] for v in variables}


def checked_panel(rows: DataFrame, date_column: str, variables: list[str], series_id: str, least: int = 0) -> DataFrame:
    """The long panel of a table of strings with a row for each month, after one pass of checks."""
    value = {v: F.expr(f"try_cast(trim(`{v}`) as double)") for v in variables}
    wrong = {v: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) for v, x in value.items()}
    bad = [F.count_if(x).alias(v) for v, x in wrong.items()] + [F.min(F.when(x, F.trim(F.col(f"`{date_column}`")))).alias(f"_at_{v}") for v, x in wrong.items()]
    t = period_index(F.trim(F.col(f"`{date_column}`")))
    found = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_if(t.isNull()).alias("_bad"), F.count_distinct(t).alias("_d"), F.min(t).alias("_a"), F.max(t).alias("_b"), *bad).first()
    if found["_bad"]:
        raise CaseError("invalid_month", f"{found['_bad']} dates are not months", date_column)
    for v in variables:
        if found[v]:
            raise CaseError("non_numeric", f"{found[v]} values of {v} are missing or not finite numbers, the first at {found['_at_' + v]}", v)
    if found["_n"] <= least:
        raise CaseError("too_short", f"{found['_n']} rows do not exceed the lags", date_column)
    if found["_d"] < found["_n"] or found["_b"] - found["_a"] + 1 != found["_d"]:
        present = [r[0] for r in rows.select(t.cast("long").alias("t")).orderBy("t").collect()]  # one uploaded or configured series of months
        axis = axis_blocks(present)
        if axis["duplicate_months"]:
            raise AxisError("duplicate_months", f"{found['_n'] - found['_d']} months are repeated, the first {axis['duplicate_months'][0]}", date_column, axis)
        raise AxisError("missing_months", f"{len(axis['missing_months'])} months are missing, the first {axis['missing_months'][0]}", date_column, axis)
    wide = rows.select(F.lit(series_id).alias("series_id"), t.cast("long").alias("t"), *[x.alias(v) for v, x in value.items()])
    return wide.unpivot(["series_id", "t"], variables, "signal", "value")


def read_case(spark: SparkSession, config: CaseConfig) -> DataFrame:
    """A case's panel; its CSV must have the configured columns and no others."""
    rows = spark.read.option("header", True).csv(config.csv)
    want = {config.date_column, *config.variables}
    if {*rows.columns} != want:
        raise CaseError("columns", f"columns differ: {', '.join(sorted({*rows.columns} ^ want))}", "csv")
    return checked_panel(rows, config.date_column, config.variables, config.case_name, config.lag_window)


def read_adaptive_case(spark: SparkSession, case: AdaptiveCase, start: str | None = None, end: str | None = None) -> DataFrame:
    """An adaptive case's panel, which must cover exactly its windows, or from ``start`` to ``end``."""
    rows = spark.read.option("header", True).csv(case.csv)
    want = {case.date_column, *case.variables}
    if {*rows.columns} != want:
        raise CaseError("columns", f"columns differ: {', '.join(sorted({*rows.columns} ^ want))}", "csv")
    panel = checked_panel(rows, case.date_column, case.variables, case.case_name, max(case.lag_windows))
    ends = panel.agg(F.min("t"), F.max("t")).first()
    if (ends[0], ends[1]) != (month(start or case.train_start), month(end or case.test_end)):
        raise CaseError("axis", f"the months must be {start or case.train_start} to {end or case.test_end}", case.date_column)
    return panel


def read_table(spark: SparkSession, csv_path: str, date_column: str = "date", variables: list[str] | None = None, start: str | None = None, end: str | None = None, series_id: str = "table") -> DataFrame:
    """The panel of some columns of a CSV (all but the date by default) between two months; what can't be read as a number is NULL."""
    rows = spark.read.option("header", True).csv(csv_path)
    names = [c for c in rows.columns if c != date_column] if variables is None else variables
    if missing := [c for c in (date_column, *names) if c not in rows.columns]:
        raise CaseError("missing_columns", f"missing columns: {', '.join(missing)}", missing[0])
    period = F.trim(F.col(f"`{date_column}`"))
    kept = rows.where(period.between(start or "0000-01", end or "9999-12"))
    wide = kept.select(F.lit(series_id).alias("series_id"), period_index(period).cast("long").alias("t"), *[F.expr(f"try_cast(trim(`{c}`) as double)").alias(c) for c in names])
    return wide.unpivot(["series_id", "t"], names, "signal", "value")


def read_frozen_forecast(spark: SparkSession, csv_path: str, budget: str = "1.00", rows: int | None = None) -> tuple[DataFrame, list[str]]:
    """(date, predicted) of one tier of a sweep's predictions, and the sources its model used, which must be the same on all rows."""
    own = spark.read.option("header", True).csv(csv_path).where(F.col("budget") == budget)
    found = own.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("used_sources").alias("lists"), F.min("used_sources").alias("sources")).first()
    if found["n"] == 0 or found["lists"] > 1 or rows is not None and found["n"] != rows:
        raise CaseError("forecast", f"{found['n']} rows with {found['lists']} lists of sources", "budget")
    return own.select("date", F.expr("try_cast(predicted as double)").alias("predicted")), [x for x in (found["sources"] or "").split(";") if x]


def scope(text: str) -> dict[str, str]:
    """The settings of ``k=v&k=v`` (URL-encoded) or ``k=v; k=v``; parts without = are left out."""
    if "&" in text:
        return dict(parse_qsl(text))
    parts = (x.split("=", 1) for x in text.split(";") if "=" in x)
    return {k.strip(): v.strip() for k, v in parts}


def manifest(case_path: str) -> dict | None:
    """The source manifest beside a case file; None where there is none or it isn't a JSON object."""
    path = Path(case_path).parent / "source_manifest.json"
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except (FileNotFoundError, json.JSONDecodeError):
        return None
    return found if isinstance(found, dict) else None


def signal_metadata(case_path: str) -> dict[str, dict]:
    """Unit, seasonal adjustment and perhaps coverage of each series that the manifest names."""
    found = manifest(case_path) or {}
    covered = {"coverage": found["coverage"]} if isinstance(found.get("coverage"), dict) else {}
    out = {}
    for item in found.get("series", []):
        if isinstance(item, dict) and "name" in item:
            known = scope(str(item.get("filters") or item.get("actual_scope") or ""))
            out[str(item["name"])] = {"unit": known.get("unit", "unknown"), "seasonal_adjustment": known.get("s_adj", "unknown"), **covered}
    return out


def file_sha256(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def read_upload(spark: SparkSession, csv_base64: str, date_column: str, variables: list[str], name: str = "upload") -> DataFrame:
    """The panel of a CSV text in base 64; columns that aren't asked for are ignored."""
    try:
        text = base64.b64decode(csv_base64, validate=True).decode("utf-8")
    except ValueError as e:
        raise CaseError("invalid_csv", f"not base 64 of UTF-8: {e}", "csv_base64") from e
    header, *lines = [r for r in csv.reader(io.StringIO(text)) if r] or [[]]
    if missing := [c for c in (date_column, *variables) if c not in header]:
        raise CaseError("missing_columns", f"missing columns: {', '.join(missing)}", missing[0])
    if not lines:
        raise CaseError("empty_csv", "there are no rows", "csv_base64")
    cells = [[r[i] if i < len(r) else None for i in range(len(header))] for r in lines]
    rows = spark.createDataFrame(cells, ", ".join(f"`{c}` string" for c in header))
    return checked_panel(rows, date_column, variables, name)


@dataclass(frozen=True)
class CubeSeries:
    """One series of a cube: a code for each dimension but time."""

    name: str
    dataset: str
    filters: tuple[tuple[str, str], ...]

    def url(self, root: str, start: str, end: str) -> str:
        """Where the service offers it; equal series have equal addresses."""
        return f"{root}/{self.dataset}?" + urlencode([("lang", "en"), *self.filters, ("sinceTimePeriod", start), ("untilTimePeriod", end)])


def check_series(series: list[CubeSeries]) -> list[CubeSeries]:
    """Series with names and datasets, each name once."""
    for s in series:
        if not s.name or not s.dataset:
            raise CaseError("invalid_series", "a series needs a name and a dataset", "series")
    if repeated := sorted(n for n, k in Counter(s.name for s in series).items() if k > 1):
        raise CaseError("duplicate_series", f"series are repeated: {', '.join(repeated)}", repeated[0])
    return series


def fetch_cube(series: CubeSeries, root: str, start: str, end: str, opener: Callable[[str, float], bytes], timeout: float = 120.0) -> str:
    """One series' document as text, by a driver-side ``opener`` of (address, seconds); what isn't a JSON object is an error."""
    raw = opener(series.url(root, start, end), timeout)
    try:
        if isinstance(json.loads(raw), dict):
            return raw.decode("utf-8")
    except ValueError as e:
        raise CaseError("invalid_cube", f"{series.name}: not JSON: {e}", series.name) from e
    raise CaseError("invalid_cube", f"{series.name}: not a JSON object", series.name)


def decode_cube(spark: SparkSession, cubes: DataFrame, series: list[CubeSeries]) -> DataFrame:
    """(name, period, value) of JSON-stat documents: (dataset, json), or (name, dataset, json) for documents of single series.

    Values lie in one flat list, or a sparse map, in row-major order of the dimensions. A
    dimension without a code must have a single category. Values that are missing stay NULL.
    """
    schema = "id array<string>, size array<int>, dimension map<string, struct<category: struct<index: map<string, int>>>>, value string"
    asked = spark.createDataFrame([(s.name, s.dataset, dict(s.filters)) for s in series], "name string, dataset string, codes map<string, string>")
    text = F.get_json_object("json", "$.value")
    key = "name" if "name" in cubes.columns else "dataset"
    doc = cubes.select(key, F.from_json("json", schema).alias("d"), text.alias("v")).select(key, "d.id", "d.size", "d.dimension", "v")
    flat = F.when(F.substring("v", 1, 1) == "[", F.from_json("v", "array<double>"))
    sparse = F.when(F.substring("v", 1, 1) == "{", F.from_json("v", "map<string, double>"))
    rows = doc.join(asked, key).withColumns({"flat": flat, "sparse": sparse})
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.element_at(F.col("size"), F.array_position("id", F.lit("time")).cast("int")) - 1)))
    place = """aggregate(sequence(0, size(id) - 1), 0L, (s, i) -> s * size[i] + case when id[i] = 'time' then k
        when codes[id[i]] is not null then coalesce(dimension[id[i]].category.index[codes[id[i]]], cast(raise_error(concat('no category ', codes[id[i]], ' in ', id[i])) as int))
        when size[i] = 1 then 0 else cast(raise_error(concat(name, ' leaves ', id[i], ' open')) as int) end)"""
    period = "map_keys(map_filter(dimension['time'].category.index, (p, i) -> i = k))[0]"
    rows = rows.withColumns({"at": F.expr(place), "period": F.expr(period)})
    return rows.select("name", "period", F.coalesce(F.expr("get(flat, int(at))"), F.expr("sparse[cast(at as string)]")).alias("value"))


def cube_panel(decoded: DataFrame, start: str, end: str, series_id: str = "snapshot") -> DataFrame:
    """The long panel of decoded series, each of which must have every month from start to end, and no other."""
    rows = decoded.select(F.lit(series_id).alias("series_id"), period_index(F.col("period")).cast("long").alias("t"), F.col("name").alias("signal"), "value")
    low, high = month(start), month(end)
    axis = rows.select("signal").distinct().withColumn("t", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long"))))
    gaps = axis.join(rows.where("value is not null"), ["signal", "t"], "left_anti")
    over = rows.where(F.col("value").isNotNull() & ~F.col("t").between(low, high)).select("signal", "t")
    bad = gaps.unionByName(over).orderBy("signal", "t").first()
    if bad is not None:
        raise CaseError("missing_months", f"{bad['signal']} does not cover {start} to {end}: {month_name(bad['t'])}", bad["signal"])
    return rows
