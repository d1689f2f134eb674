"""What a page shows of an answer: plain fields taken from a report, an audit or an error. Nothing is computed or made up here."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from .report import SCHEMA_VERSION, STATES

#: What a page calls a state, and how it colours it.
BADGES = {"birth": ("New", "info"), "strengthening": ("Growing", "good"), "stable": ("Stable", "good"), "decaying": ("Fading", "warning"), "dead": ("Gone", "bad")}
UNKNOWN_BADGE = ("Unknown", "neutral")
#: Outcomes an answer of each status may have, and the view that shows them.
VIEWS = {200: {"ok": "report", "baseline_only": "baseline"}, 404: {"not_found": "not_found"}, 422: {"validation_error": "rejected"}}


def view_of(status: int | None, body: object, transport: str | None = None) -> str:
    """The view for an answer; ``transport`` says why there is none, and an answer that contradicts itself is ``malformed``."""
    if transport is not None:
        return transport
    if not isinstance(body, dict):
        return "malformed"
    if status is not None and status >= 500:
        return "failure"
    if status == 200 and body.get("schema_version") != SCHEMA_VERSION:
        return "malformed"
    return VIEWS.get(status, {}).get(body.get("outcome"), "malformed")


def _at(body: dict | None, path: str) -> object:
    """The value under a dotted path, or None where any part is absent."""
    for part in path.split("."):
        body = body.get(part) if isinstance(body, dict) else None
    return body


def _fields(**paths: str) -> Callable[[dict], dict]:
    """A function that takes fields from under dotted paths."""
    return lambda body: {name: _at(body, path) for name, path in paths.items()}


report_context = _fields(
    name="case.name", target="case.target", candidates="case.candidate_signals", frequency="case.frequency", observations="case.n_observations",
    lag_window="case.lag_window", as_of="generated_as_of", source="snapshot.source", hash="snapshot.hash", transforms="transform_declarations",
)
decision = _fields(outcome="outcome", headline="narrative.headline", lines="narrative.lines", status="selection.fit_status", mode="selection.final_mode", sources="selection.selected_sources")
confidence = _fields(confidence="prediction_confidence.confidence", support="prediction_confidence.input_support", residual="prediction_confidence.residual_uncertainty")
error_fields = _fields(code="error.code", message="error.message", field="error.field", outcome="outcome")
snapshot_fields = _fields(hash="hash", provenance="provenance")
axis_fields = _fields(continuous="date_axis.continuous", expected="date_axis.expected_months", present="date_axis.present", missing="date_axis.missing_months", duplicates="date_axis.duplicate_months")
relation_fields = _fields(
    source="source", target="target", lag="lag", weight="effect.weight", score="effect.score", effect_size="effect.effect_size", direction="effect.direction",
    sample_count="evidence.sample_count", p_value="evidence.p_value", fdr_threshold="evidence.fdr_threshold", sample_support="evidence.sample_support",
    stability="stability.stability", uncertainty="stability.uncertainty", state="stability.state", points="stability.points", selected="selected", reason="reason",
)
signal_fields = _fields(signal="signal", samples="sample_count", unit="unit", adjustment="seasonal_adjustment", start="coverage.start", end="coverage.end", acf="lag1_acf", persistent="highly_persistent_risk")


def relation_rows(report: dict) -> list[dict]:
    """One flat row a relation, in the report's order."""
    return [relation_fields(r) for r in report.get("relations") or []]


def signal_rows(blocks: dict) -> list[dict]:
    """One flat row a signal of an audit."""
    return [signal_fields(s) for s in _at(blocks, "data_audit.signals") or []]


def axis_summary(blocks: dict) -> dict:
    return axis_fields(blocks.get("data_audit") or {})


def rejected_signals(blocks: dict) -> list[str]:
    """Signals whose declared transform an audit rejects."""
    return [v["signal"] for v in blocks.get("transform_diagnostics") or [] if v["verdict"] == "rejected"]


def may_analyze(blocks: dict) -> bool:
    """Whether an audit has diagnostics and rejects none."""
    return bool(blocks.get("transform_diagnostics")) and not rejected_signals(blocks)


def evaluation_interval(report: dict) -> dict | None:
    """Median, low, high, folds and whether it resolves, of the rolling-origin skill; only if the report has a median: an interval is never made up."""
    found = {k: _at(report, f"evaluation.rolling_origin.{k}") for k in ("median", "low", "high", "folds")}
    return found | {"resolves": bool(_at(report, "evaluation.rolling_origin.resolves"))} if found["median"] is not None else None


def has_evaluation(report: dict) -> bool:
    return evaluation_interval(report) is not None


def has_trajectory(relation: dict) -> bool:
    """Whether a relation carries steps to draw."""
    steps = relation.get("trajectory")
    return isinstance(steps, list) and len(steps) > 0


def shown_number(value: float | None, digits: int = 3) -> str:
    """A figure, or a dash where there is none; never 0 for nothing."""
    return "\u2014" if value is None else f"{float(value):.{digits}f}"


def shown_signed(value: float | None, digits: int = 3) -> str:
    return "\u2014" if value is None else f"{float(value):+.{digits}f}"


def shown_percent(value: float | None, digits: int = 1) -> str:
    """A share in percent, with its sign."""
    return "\u2014" if value is None else f"{float(value) * 100:+.{digits}f}%"


def report_filename(report: dict) -> str:
    """A file name from the case's name or else the target; other characters than letters, digits, - and _ become -."""
    raw = str(_at(report, "case.name") or _at(report, "case.target") or "analysis")
    return "report-" + (re.sub(r"[^\w-]", "-", raw).strip("-") or "analysis") + ".json"


def badge(state: str | None) -> dict[str, str]:
    text, tone = BADGES.get(state, UNKNOWN_BADGE)
    return {"label": text, "tone": tone}


def state_steps(state: str | None) -> list[dict]:
    """All states in their order; the given one is active."""
    return [{"state": s, "label": BADGES[s][0], "active": s == state} for s in STATES]


def upload_of_snapshot(answer: dict, request: dict) -> dict:
    """The request that analyses exactly the rows of a snapshot's answer, with the settings of the request that made it."""
    kept = ("target", "candidate_signals", "transform_declarations", "train_end", "lag_window")
    return {"csv_base64": base64.b64encode(answer["csv"].encode()).decode(), "date_column": "date", **{k: request[k] for k in kept if k in request}}
