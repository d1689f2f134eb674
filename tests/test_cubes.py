"""Cubes that executors fetch, and requests that bring or lack them, without a network."""

import json
import math
import random
from urllib.parse import parse_qs, urlparse

import pytest

from lagweave.plans import report
from lagweave.sources import cases, cubes

START, END = "2010-01", "2017-12"
ROOT = "http://cubes.invalid/data"


def document(name, keep=lambda m: True, updated="2018-02-01"):
    """A cube of two places, of which AA has the series; values differ by name."""
    months = [m for m in cases.month_axis(START, END) if keep(m)]
    rng = random.Random(sum(map(ord, name)))
    change = [rng.gauss(0, 1) for _ in months]
    if name == "y":  # follows x by two months
        lead = random.Random(ord("x"))
        before = [lead.gauss(0, 1) for _ in months]
        change = [0.3 * c + (before[i - 2] if i >= 2 else 0) for i, c in enumerate(change)]
    values, level = [], 100.0
    for c in change:
        level += c
        values.append(round(level, 6))
    return {
        "updated": updated, "id": ["geo", "s_adj", "unit", "time"], "size": [2, 1, 1, len(months)], "value": values + [0.0] * len(months),
        "dimension": {"geo": {"category": {"index": {"AA": 0, "BB": 1}}}, "s_adj": {"category": {"index": {"SA": 0}}}, "unit": {"category": {"index": {"I15": 0}}}, "time": {"category": {"index": {m: i for i, m in enumerate(months)}}}},
    }


def request(names=("x", "y"), **more):
    series = [{"name": n, "dataset": f"set_{n}", "filters": [["geo", "AA"], ["unit", "I15"], ["s_adj", "SA"]]} for n in names]
    return {"series": series, "start": START, "end": END, "target": "y", "candidate_signals": ["x"], "transform_declarations": {"x": "diff", "y": "diff"}, "train_end": "2016-12", "lag_window": 3} | more


def opener(folder, fail=0, answer=None):
    """Answers from the address alone; each series fails so many times before (a file counts, as tasks share nothing else)."""

    def open_(address, seconds):
        name = urlparse(address).path.rsplit("set_", 1)[-1]
        with open(f"{folder}/{name}", "a+") as f:
            f.write("x")
            f.seek(0)
            tries = len(f.read())
        if tries <= fail:
            raise ConnectionError(f"no answer from {name}")
        assert parse_qs(urlparse(address).query)["geo"] == ["AA"] and seconds == 9.0
        return json.dumps(document(name)).encode() if answer is None else answer

    return open_


def service(folder, **options):
    return cubes.Service(ROOT, opener(folder, **options), wait=0.01, timeout=9.0)


def test_a_request_with_cubes_is_reported(spark, tmp_path):
    given = {"set_x": document("x"), "y": json.dumps(document("y"))}  # by data set and by name, as object and as text
    status, found = report.analyze_payload(spark, request(cubes=given))
    assert status == 200 and found["outcome"] == "ok" and found["selection"]["selected_sources"] == ["x"]
    assert [(v["source"], v["lag"]) for v in found["relations"]] == [("x", 2)]
    signals = {s["signal"]: s for s in found["data_audit"]["signals"]}
    assert signals["x"]["unit"] == "I15" and signals["y"]["seasonal_adjustment"] == "SA" and signals["x"]["sample_count"] == 96
    # the same documents, fetched by the executors: the same report and snapshot
    other = report.analyze_payload(spark, request(), service=service(tmp_path))[1]
    drop = lambda r: {k: v for k, v in r.items() if k not in ("snapshot", "provenance")}
    assert drop(other) == drop(found)
    made = [report.snapshot_payload(spark, r, service=service(tmp_path))[1] for r in (request(), request(cubes=given))]
    assert made[0]["csv"] == made[1]["csv"] and made[0]["hash"] == made[1]["hash"] and made[0]["csv"].count("\n") == 97
    told = made[0]["provenance"]["series"][0]
    assert told["address"] == f"{ROOT}/set_x?lang=en&geo=AA&unit=I15&s_adj=SA&sinceTimePeriod={START}&untilTimePeriod={END}" and told["updated"] == "2018-02-01"


def test_attempts_are_bounded_and_errors_are_columns(spark, tmp_path):
    series = [cases.CubeSeries(n, f"set_{n}", (("geo", "AA"),)) for n in "xyz"]
    for fail, tries, whole in ((0, 1, True), (2, 3, True), (3, 3, False)):
        folder = tmp_path / str(fail)
        folder.mkdir()
        frame = cubes.fetched(spark, series, service(folder, fail=fail), START, END)
        assert frame.rdd.getNumPartitions() == 3
        rows = {r.name: r for r in frame.collect()}
        assert rows.keys() == set("xyz") and all(r.attempts == tries and (r.json is not None) == whole and (r.error is None) == whole for r in rows.values())
    assert "ConnectionError: no answer from z" in rows["z"].error
    folder = tmp_path / "odd"
    folder.mkdir()
    for answer, says in ((b"[1]", "not a JSON object"), (b"<html>", "not JSON"), (b"\xff\xfe", "not JSON")):
        r = cubes.fetched(spark, series[:1], service(folder, answer=answer), START, END).first()
        assert r.json is None and r.attempts == 1 and says in r.error
    with pytest.raises(ValueError, match="attempts"):
        cubes.fetched(spark, series, cubes.Service(ROOT, len, attempts=0), START, END)


def test_requests_that_cannot_be_filled(spark, tmp_path):
    say = lambda r, **k: (lambda s, f: (s, f["error"]["code"], f["error"]["field"]))(*report.analyze_payload(spark, r, **k))
    assert say(request(cubes={"x": document("x")})) == (422, "missing_cube", "y")
    assert say(request(), service=service(tmp_path, fail=99)) == (422, "unreachable_cube", "x")
    assert say(request(cubes={"x": document("x"), "y": "[]"})) == (422, "invalid_cube", "y")
    gap = document("y", keep=lambda m: m != "2012-05")
    assert say(request(cubes={"x": document("x"), "y": gap})) == (422, "missing_months", "y")
    assert say(request(cubes={"x": document("x"), "y": document("y")}, end="2017-11")) == (422, "missing_months", "x")
    assert say(request(cubes={}, target="w")) == (422, "unknown_signal", "w")
    assert say({"target": "y"}) == (422, "invalid_request", None)


def test_a_zero_and_a_constant_cube(spark):
    flat = document("x") | {"value": [0.0] * 192}
    status, found = report.analyze_payload(spark, request(cubes={"x": flat, "y": document("y")}))
    assert status == 200 and found["outcome"] == "baseline_only" and found["relations"][0]["effect"]["score"] == 0
    assert not math.isnan(found["relations"][0]["evidence"]["p_value"])
