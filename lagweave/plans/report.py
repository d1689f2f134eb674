"""The report of one analysed case: audit, relations, evidence, and a narrative, as one document."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import evaluation, lifecycle, relations, selection, transforms
from ..sources import cases, cubes, sinks

SCHEMA_VERSION = "report.v1"
#: States and reason codes of the report.
STATES = ("birth", "strengthening", "stable", "decaying", "dead")
REASONS = {
    "selected": "passes every check",
    "below_fdr_corrected_effect": "its effect is within what chance gives in so many comparisons",
    "insufficient_stability": "its strength, sign or lag changes too much",
    "excess_relationship_uncertainty": "its weight varies too much",
    "insufficient_sample_support": "it rests on too few rows",
}


@dataclass(frozen=True)
class AnalysisInput:
    name: str
    panel: DataFrame
    target: str
    candidates: list[str]
    declared: dict[str, str]
    train_end: str
    lag_window: int
    source: str = "case"
    metadata: dict[str, dict] = field(default_factory=dict)
    provenance: dict | None = None
    test_start: str | None = None

    @property
    def variables(self) -> list[str]:
        return [self.target, *sorted(self.candidates)]


def audit(given: AnalysisInput) -> dict:
    """Axis, signals and transform verdicts, by training rows alone. Signals that persist there though they are declared none are rejected."""
    declared = cases.check_transforms(given.variables, given.declared)
    months = [r["t"] for r in given.panel.where(F.col("signal") == given.target).select("t").orderBy("t").collect()]  # one series of months
    train = given.panel.where(F.col("t") <= cases.month(given.train_end))
    acf = {r["signal"]: r for r in transforms.diagnostics(train).collect()}
    counts = {r["signal"]: r for r in given.panel.groupBy("signal").agg(F.count("value").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).collect()}
    signals, verdicts = [], []
    for v in given.variables:
        known, about = counts[v], given.metadata.get(v, {})
        found = acf.get(v)
        shared = {"lag1_acf": found["lag1_acf"] if found else None, "highly_persistent_risk": bool(found and found["highly_persistent"])}
        coverage = about.get("coverage", {"start": cases.month_name(known["a"]), "end": cases.month_name(known["b"]), "months": known["n"]})
        signals.append({"signal": v, "sample_count": known["n"], "unit": about.get("unit", "unknown"), "seasonal_adjustment": about.get("seasonal_adjustment", "unknown"), "coverage": coverage} | shared)
        verdicts.append({"signal": v, "declared": declared[v]} | shared | {"verdict": "rejected" if declared[v] == "none" and shared["highly_persistent_risk"] else "accepted"})
    blocks = {"transform_diagnostics": verdicts, "data_audit": {"date_axis": cases.axis_blocks(months), "signals": signals, "candidate_pool_available": bool(given.candidates)}}
    if bad := [v["signal"] for v in verdicts if v["verdict"] == "rejected"]:
        raise Rejected("persistent_level", f"{', '.join(bad)} need a transform", bad[0], blocks)
    return blocks


class Rejected(cases.CaseError):
    """An audit that ends the analysis; it keeps the blocks made so far."""

    def __init__(self, code: str, message: str, where: str | None, blocks: dict):
        super().__init__(code, message, where)
        self.blocks = blocks


#: The longest window, what it is longer than the lags by at least, the spacing of steps, and rows beyond the lags that a trajectory needs.
MOST_WINDOW, MORE_THAN_LAGS, SPACING, LEAST_MORE = 36, 6, 6, 8


def _window(n: int, lag: int) -> int:
    return min(MOST_WINDOW, max(lag + MORE_THAN_LAGS, n // 3))


def relation_states(given: AnalysisInput) -> DataFrame:
    """Each candidate's latest rolling relation in training with its state.

    Where training rows are few, or levels declared none persist in one of the windows, the
    relation is that of all training rows, without stability and in the state birth.
    """
    last = cases.month(given.train_end)
    levels = given.panel.where(F.col("t") <= last)
    train = transforms.transform(levels, given.declared)
    n = train.select("t").distinct().count()
    if n <= given.lag_window:
        raise cases.CaseError("too_short", "training rows do not exceed the lags", "train_end")
    whole = relations.ranked(relations.relations(train, given.lag_window, given.target))
    none = [F.lit(None).cast("double").alias(c) for c in ("stability", "uncertainty")]
    plain = whole.select(*relations.EDGE, "lag", "weight", "score", "sample_count", *none, F.lit("birth").alias("state"), F.lit(0).cast("long").alias("points"))
    if n <= given.lag_window + LEAST_MORE:
        return plain
    window = _window(n, given.lag_window)
    first = train.agg(F.min("t")).first()[0]
    offset = F.col("step") - first
    start = window + given.lag_window + 1
    wanted = (offset >= start) & (offset <= n) & ((offset - start) % SPACING == 0)
    if not transforms.persistent_windows(levels, given.declared, window).where(wanted).isEmpty():
        return plain
    differenced = [s for s, kind in given.declared.items() if kind != "none"]
    timed = relations.rolling_relations(train, given.lag_window, window, given.target, differenced)
    found = lifecycle.lifecycle(timed.where(wanted)).select(*relations.EDGE, "lag", "weight", "score", "sample_count", "stability", "uncertainty", "state", "points")
    return found.unionByName(plain.join(found, relations.EDGE, "left_anti"))


def build_report(given: AnalysisInput) -> dict:
    """Report JSON version 1: outcome ok if the evidence gate selects a relation, else baseline_only."""
    blocks = audit(given)
    gate = selection.evidence_gate(relation_states(given), given.lag_window).orderBy(F.desc(F.round("score", stats.TIE_DIGITS)), "source").collect()
    views = [
        {
            "source": r["source"], "target": r["target"], "lag": r["lag"],
            "effect": {"weight": r["weight"], "score": r["score"], "effect_size": r["effect_size"], "direction": (r["weight"] > 0) - (r["weight"] < 0)},
            "evidence": {"sample_count": r["sample_count"], "p_value": r["p_value"], "fdr_threshold": r["fdr_cutoff"], "sample_support": r["support"]},
            "stability": {"stability": r["stability"], "uncertainty": r["uncertainty"], "state": r["state"], "points": r["points"]},
            "selected": r["selected"], "reason": r["reason"],
        }
        for r in gate
    ]
    chosen = [v["source"] for v in views if v["selected"]]
    most = max((r["sample_count"] for r in gate), default=0)
    comparisons = given.lag_window * len(given.candidates)
    floor = math.tanh(stats.critical_z(0.05, comparisons) / math.sqrt(most - 3)) if most > 3 else None
    rows = evaluation.naive_forecasts(evaluation.target_rows(given.panel, given.target)).where(F.col("t") >= (cases.month(given.test_start) if given.test_start else cases.month(given.train_end) + 1))
    error = evaluation.errors(rows, "persistence").select("mae").first() if given.source == "case" else None
    text = sinks.snapshot_csv(given.panel, given.variables)
    outcome = "ok" if chosen else "baseline_only"
    return {
        "schema_version": SCHEMA_VERSION,
        "outcome": outcome,
        "generated_as_of": given.train_end,
        "case": {"name": given.name, "target": given.target, "candidate_signals": list(given.candidates), "frequency": "monthly", "n_observations": text.count("\n") - 1, "train_end": given.train_end, "lag_window": given.lag_window},
        "snapshot": {"hash": sinks.snapshot_hash(text), "source": given.source, "provenance": given.provenance},
        "transform_declarations": dict(given.declared),
        **blocks,
        "baseline": {"name": "persistence", "mae": error["mae"] if error else None},
        "evaluation": None,
        "noise_floor": {"sample_count": most, "comparisons": comparisons, "alpha": 0.05, "threshold": floor},
        "relations": views,
        "selection": {"fit_status": "fit" if chosen else "baseline_only_no_evidence", "final_mode": "not_evaluated", "selected_count": len(chosen), "selected_sources": chosen},
        "prediction_confidence": {"confidence": None, "input_support": 1.0, "residual_uncertainty": None},
        "narrative": {"headline": f"{len(chosen)} of {len(views)} relations are supported" if chosen else "No relation is supported; the naive forecast stands", "lines": [f"{v['source']}: {REASONS[v['reason']]}" for v in views]},
        "warnings": [],
    }


def find_case(name: str, root: str) -> str:
    """The file of a bundled case: ``root``/name/case.json, for plain names only."""
    path = Path(root) / name / "case.json"
    if not name.replace("_", "").replace("-", "").isalnum() or not path.is_file():
        raise LookupError(f"there is no case {name!r}")
    return str(path)


def _input(spark: SparkSession, payload: dict, root: str | None, service: cubes.Service | None = None) -> AnalysisInput:
    kinds = [k for k in ("case_name", "csv_base64", "series") if payload.get(k) is not None]
    if len(kinds) != 1:
        raise cases.CaseError("invalid_request", "one of case_name, csv_base64 and series is needed")
    if kinds == ["case_name"]:
        if root is None:
            raise LookupError("no folder of cases is served")
        path = find_case(str(payload["case_name"]), root)
        config = cases.load_case(path)
        declared = payload.get("transform_declarations") or config.transform_declarations
        if declared is None:
            raise cases.CaseError("undeclared_transform", "every signal needs a transform", "transform_declarations")
        candidates = payload.get("candidate_signals") or config.candidate_signals
        panel = cases.read_case(spark, config).where(F.col("signal").isin(payload.get("target", config.target), *candidates))
        settings = (payload.get("target", config.target), candidates, {k: declared[k] for k in declared if k in (payload.get("target", config.target), *candidates)}, payload.get("train_end", config.train_end), payload.get("lag_window", config.lag_window))
        return AnalysisInput(config.case_name, panel, *settings, metadata=cases.signal_metadata(path), provenance=cases.manifest(path), test_start=config.test_start)
    target, candidates = payload["target"], payload["candidate_signals"]
    common = (target, candidates, payload["transform_declarations"], payload["train_end"], payload["lag_window"])
    if kinds == ["csv_base64"]:
        panel = cases.read_upload(spark, payload["csv_base64"], payload.get("date_column", "date"), [target, *sorted(candidates)])
        return AnalysisInput("upload", panel, *common, source="upload")
    series = cases.check_series([cases.CubeSeries(s["name"], s["dataset"], tuple(map(tuple, s["filters"]))) for s in payload["series"]])
    if unknown := sorted({target, *candidates} - {s.name for s in series}):
        raise cases.CaseError("unknown_signal", f"unknown signals: {', '.join(unknown)}", unknown[0])
    start, end = payload["start"], payload["end"]
    docs = cubes.documents(spark, series, payload.get("cubes") or {}, start, end, service)
    panel = cases.cube_panel(cases.decode_cube(spark, docs, series), start, end).where(F.col("signal").isin(target, *candidates))
    scope, when, root = {s.name: dict(s.filters) for s in series}, cubes.updated(docs), service.root if service else ""
    about = {k: {"unit": v.get("unit", "unknown"), "seasonal_adjustment": v.get("s_adj", "unknown")} for k, v in scope.items()}
    told = [{"name": s.name, "dataset": s.dataset, "filters": scope[s.name], "address": s.url(root, start, end), "updated": when[s.name]} for s in series]
    return AnalysisInput("snapshot", panel, *common, source="snapshot", metadata=about, provenance={"start": start, "end": end, "series": told})


def _error(status: int, outcome: str, code: str, message: str, where: str | None, **blocks: object) -> tuple[int, dict]:
    return status, {"schema_version": SCHEMA_VERSION, "outcome": outcome, "error": {"code": code, "message": message, "field": where}} | blocks


def _answer(make: Callable[[], dict]) -> tuple[int, dict]:
    try:
        return 200, make()
    except cases.AxisError as e:
        return _error(422, "validation_error", e.code, e.message, e.where, data_audit={"date_axis": e.axis, "signals": [], "candidate_pool_available": False}, transform_diagnostics=[])
    except cases.CaseError as e:
        return _error(422, "validation_error", e.code, e.message, e.where, **(e.blocks if isinstance(e, Rejected) else {}))
    except KeyError as e:
        return _error(422, "validation_error", "invalid_request", f"{e} is missing", str(e).strip("'"))
    except LookupError as e:
        return _error(404, "not_found", "unknown_case", str(e), "case_name")
    except Exception as e:  # the last resort of a service: whatever else goes wrong is a failed analysis
        return _error(500, "analysis_failure", "analysis_failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", None)


def analyze_payload(spark: SparkSession, payload: dict, root: str | None = None, service: cubes.Service | None = None) -> tuple[int, dict]:
    """(status, report) of a request; ``root`` is the folder of bundled cases, ``service`` where cubes that the request doesn't bring are fetched."""
    return _answer(lambda: build_report(_input(spark, payload, root, service)))


def audit_payload(spark: SparkSession, payload: dict, root: str | None = None, service: cubes.Service | None = None) -> tuple[int, dict]:
    """(status, audit blocks) of a request."""
    return _answer(lambda: audit(_input(spark, payload, root, service)))


def snapshot_payload(spark: SparkSession, payload: dict, root: str | None = None, service: cubes.Service | None = None) -> tuple[int, dict]:
    """(status, canonical CSV and its hash) of a request."""

    def make() -> dict:
        given = _input(spark, payload, root, service)
        text = sinks.snapshot_csv(given.panel, given.variables)
        return {"csv": text, "hash": sinks.snapshot_hash(text), "provenance": given.provenance}

    return _answer(make)
