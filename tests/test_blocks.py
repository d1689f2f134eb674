"""Moments from blocks of steps, and windows of any length, against plain loops."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lagweave.operators import blocks, relations, transforms
from lagweave.plans import report

SCHEMA = "series_id string, t long, signal string, value double"


def correlation(pairs):
    x, y = [a for a, _ in pairs], [b for _, b in pairs]
    return 0.0 if len({*x}) == 1 or len({*y}) == 1 else statistics.correlation(x, y)


def windows(data, max_lag, window, target, late=(), shortened=False):
    """(source, step, lag) -> (weight, pairs) by the definition: pairs whose both ends lie in the window."""
    axis = sorted({t for v in data.values() for t in v})
    out = {}
    for step in [*axis, axis[-1] + 1]:
        if step - axis[0] < window if not shortened else step - axis[0] <= max_lag:
            continue
        begin = max(axis[0], step - window)
        for source in data:
            for lag in range(1, max_lag + 1):
                low = begin + (source in late)
                pairs = [(data[source][t - lag], data[target][t]) for t in range(low + lag, step) if t - lag in data[source] and t in data[target]]
                if source != target and pairs:
                    out[source, step, lag] = correlation(pairs), len(pairs)
    return out


def frame(spark, data, series="s"):
    return spark.createDataFrame([(series, t, k, v) for k, vs in data.items() for t, v in vs.items()], SCHEMA)


def walk(rng, n, start=0, gaps=0.0):
    value, out = 0.0, {}
    for t in range(start, start + n):
        value += rng.gauss(0, 1)
        if rng.random() >= gaps:
            out[t] = value
    return out


@pytest.mark.parametrize("window", [36, 60, 120])
def test_a_year_of_lags_in_any_window(spark, window):
    rng = random.Random(window)
    data = {k: walk(rng, 150, start=1190, gaps=0.0) for k in "abc"}
    got = {(r.source, r.step, r.lag): (r.weight, r.sample_count) for r in relations.rolling_correlations(frame(spark, data), 12, window, "a").collect()}
    want = windows(data, 12, window, "a")
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=1e-10), k


@pytest.mark.parametrize("shortened", [False, True])
def test_gaps_late_sources_and_shortened_windows(spark, monkeypatch, shortened):
    monkeypatch.setattr(blocks, "STEPS", 40)  # several blocks
    rng = random.Random(5)
    data = {k: walk(rng, 130, start=-20, gaps=0.2) for k in "abc"}
    data["flat"] = {t: 0.1 if t < 60 else 7.7 for t in range(-20, 110)}  # constant in some windows, though not as a whole
    panel = frame(spark, data)
    for late in ((), ("b", "flat")):
        got = {(r.source, r.step, r.lag): (r.weight, r.sample_count) for r in relations.rolling_correlations(panel, 5, 16, "a", late, shortened).collect()}
        want = windows(data, 5, 16, "a", late, shortened)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=1e-10), k
        best = {(r.source, r.step): r for r in relations.rolling_relations(panel, 5, 16, "a", late, shortened).collect()}
        for (source, step), r in best.items():
            lag = min(range(1, 6), key=lambda lag: (-round(abs(want.get((source, step, lag), (-1,))[0]), 10) if (source, step, lag) in want else 1, lag))
            assert r.lag == lag and r.window_start == (max(-20, step - 16) if shortened else step - 16) and r.window_end == step


def test_a_far_offset_and_a_quiet_window_keep_their_digits(spark):
    rng = random.Random(9)
    loud = {k: {t: 1e6 + (rng.gauss(0, 1e4) if t < 200 else rng.gauss(0, 1e-2)) for t in range(260)} for k in "ab"}
    got = {(r.source, r.step, r.lag): r.weight for r in relations.rolling_correlations(frame(spark, loud), 2, 20, "a").collect()}
    want = windows(loud, 2, 20, "a")
    assert max(abs(got[k] - want[k][0]) for k in want) < 1e-10


def test_whole_series_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "STEPS", 16)
    rng = random.Random(6)
    data = {k: walk(rng, 300, start=-70, gaps=0.1) for k in "abcd"} | {"flat": {t: 0.3 for t in range(300)}, "late": {t: 5.5 if t < 200 else 9.0 for t in range(-70, 210)}}
    panel = frame(spark, data).unionByName(spark.createDataFrame([("s", 400, "a", None), ("other", 0, "a", 1.0)], SCHEMA))
    got = {(r.source, r.target, r.lag): (r.weight, r.sample_count) for r in relations.lagged_correlations(panel, 7).collect()}
    for source in data:
        for goal in data:
            for lag in range(1, 8):
                pairs = [(data[source][t - lag], v) for t, v in data[goal].items() if t - lag in data[source]]
                if source != goal:
                    assert got[source, goal, lag][1] == len(pairs) and math.isclose(got[source, goal, lag][0], correlation(pairs), abs_tol=1e-11)
    assert len(got) == 6 * 5 * 7
    into = relations.lagged_correlations(panel, 7, "a")
    assert {(r.source, r.lag): round(r.weight, 12) for r in into.collect()} == {(s, lag): round(w, 12) for (s, g, lag), (w, _) in got.items() if g == "a"}
    # what is shuffled is the panel and a row for each block, not one for each pair, lag and step
    assert blocks.lagged_moments(panel, 7).count() <= 6 * 5 * 7 * (370 / 16 + 2)


def test_edges_of_panels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert relations.lagged_correlations(empty, 3).collect() == [] and relations.rolling_relations(empty, 3, 9).collect() == []
    alone = frame(spark, {"a": {1: 1.0}})
    assert relations.relations(alone, 3).collect() == [] and relations.rolling_relations(alone, 3, 9, "none").collect() == []
    twice = frame(spark, {"a": {1: 1.0}, "b": {2: 1.0}}).unionByName(frame(spark, {"a": {1: 2.0}}))
    with pytest.raises(Exception, match="two values for one step"):
        relations.relations(twice, 1).collect()
    with pytest.raises(ValueError, match="longer than the lag"):
        relations.rolling_relations(alone, 3, 3)


def test_declared_relations_call_the_guard(spark):
    ramp = frame(spark, {"x": {t: float(t) for t in range(40)}, "y": {t: t + 0.5 * (t % 3) for t in range(40)}})
    with pytest.raises(transforms.PersistentLevels):
        relations.declared_relations(ramp, {"x": "none", "y": "diff"}, 2).collect()
    assert relations.declared_relations(ramp, {"x": "diff", "y": "diff"}, 2).count() == 2


def test_a_report_with_a_year_of_lags(spark):
    rng = random.Random(12)
    n, months = 140, [f"{2008 + i // 12}-{i % 12 + 1:02d}" for i in range(140)]
    source = [rng.gauss(0, 1) for _ in range(n)]
    target = [(0.9 * source[i - 12] if i >= 12 else 0) + 0.3 * rng.gauss(0, 1) for i in range(n)]
    body = "\n".join(["date,target,source", *(f"{m},{a:.6f},{b:.6f}" for m, a, b in zip(months, target, source))])
    import base64

    request = {"csv_base64": base64.b64encode(body.encode()).decode(), "target": "target", "candidate_signals": ["source"], "transform_declarations": {"target": "none", "source": "none"}, "train_end": months[-1], "lag_window": 12}
    status, found = report.analyze_payload(spark, request)
    assert status == 200, found
    # the states' trajectory against plain loops
    given = report._input(spark, request, None)
    state = report.relation_states(given).where(F.col("source") == "source").first()
    data = {"target": dict(enumerate(map(float, (f"{v:.6f}" for v in target)))), "source": dict(enumerate(map(float, (f"{v:.6f}" for v in source))))}
    want = windows(data, 12, 36, "target")
    last = max(step for step in range(36 + 13, n + 1, 6))
    lag = max(range(1, 13), key=lambda lag: abs(want["source", last, lag][0]))
    assert state.lag == lag == 12 and math.isclose(state.weight, want["source", last, lag][0], abs_tol=1e-10) and state.sample_count == 24
