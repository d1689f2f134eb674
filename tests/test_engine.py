"""Published figures, brute force and properties of the analytics engine."""

import base64
import json
import math
import random
import shutil
import statistics
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import stats
from lagweave.operators import evaluation, lifecycle, models, relations, selection, transforms
from lagweave.plans import catalog, power, predictors, report, sweep, views
from lagweave.sources import cases, fixtures, panel, sinks
from lagweave.streaming import panels as streams


def long(spark, **signals):
    rows = [("s", t, k, float(v)) for k, vs in signals.items() for t, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, t long, signal string, value double")


def pearson(x, y):
    return 0.0 if len({*x}) == 1 or len({*y}) == 1 else statistics.correlation(x, y)


def near(a, b):
    return a == b or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_relations_are_brute_force(spark):
    rng = random.Random(3)
    data = {k: [rng.gauss(0, 1) for _ in range(40)] for k in "abc"} | {"flat": [0.1] * 40}
    got = {(r.source, r.target): r for r in relations.relations(long(spark, **data), 4).collect()}
    assert len(got) == 12
    for (s, g), r in got.items():
        scores = [(-round(abs(pearson(data[s][:-lag], data[g][lag:])), 12), lag) for lag in range(1, 5)]
        lag = min(scores)[1]
        assert (r.lag, r.sample_count) == (lag, 40 - lag) and near(r.weight, pearson(data[s][:-lag], data[g][lag:]))
    assert got["flat", "a"].score == 0 and got["flat", "a"].lag == 1


def test_rolling_relations_look_back_only(spark):
    rng = random.Random(4)
    data = {k: [rng.gauss(0, 1) for _ in range(30)] for k in "xy"}
    rows = {r.step: r for r in relations.rolling_relations(long(spark, **data), 2, 12, "y").collect()}
    assert sorted(rows) == [*range(12, 31)]
    for step, r in rows.items():
        x, y = data["x"][step - 12 : step], data["y"][step - 12 : step]
        best = max((1, 2), key=lambda lag: abs(pearson(x[:-lag], y[lag:])))
        assert r.lag == best and near(r.weight, pearson(x[:-best], y[best:]))
    changed = {k: v[:20] + [99.0] * 10 for k, v in data.items()}
    again = {r.step: r for r in relations.rolling_relations(long(spark, **changed), 2, 12, "y").collect()}
    assert all(again[s] == rows[s] for s in rows if s <= 20)


def test_transforms_and_guard(spark):
    frame = long(spark, ramp=range(1, 41), other=[1, 4] * 20)
    out = {(r.signal, r.t): r.value for r in transforms.transform(frame, {"ramp": "log_diff", "other": "diff"}).collect()}
    assert out["ramp", 0] is None and near(out["ramp", 5], math.log(6 / 5)) and out["other", 1] == 3
    assert {r.signal for r in transforms.undeclared_persistence(frame, {"ramp": "none", "other": "none"}).collect()} == {"ramp", "other"}
    assert transforms.undeclared_persistence(frame, {"ramp": "diff", "other": "diff"}).isEmpty()
    assert transforms.label({"a": "diff", "b": "none"}) == "mixed:diff,none" and transforms.label({"a": "diff"}) == "diff"
    with pytest.raises(Exception, match="no transform"):
        transforms.transform(frame, {"ramp": "diff"}).collect()
    with pytest.raises(Exception, match="positive"):
        transforms.transform(long(spark, a=[1, -1]), {"a": "log_diff"}).collect()
    with pytest.raises(ValueError):
        transforms.transform(frame, {"ramp": "square"})


def test_published_predictor_errors(spark):
    base = fixtures.synthetic_panel(spark, "base", fixtures.BASE_SEEDS).persist()
    rows = predictors.compare(base, "target", 5, (5, 419), (510, 599), selection.tiers(spark, (1.0,)))
    got = {r.model: (round(r.a, 6), round(r.b, 6)) for r in rows.groupBy("model").agg(F.avg("mae").alias("a"), F.avg("rmse").alias("b")).collect()}
    assert got["all_signals"] == (0.428163, 0.540204) and got["top_sources"] == (0.422277, 0.532636) and got["trust_gated"] == (0.454786, 0.568517)
    naive = evaluation.naive_forecasts(evaluation.target_rows(base, "target")).where("t >= 510")
    r = evaluation.errors(naive, "persistence").agg(F.avg("mae"), F.avg("rmse")).first()
    assert (round(r[0], 6), round(r[1], 6)) == (0.566021, 0.703043)
    full = relations.relations(base, 5, "target").groupBy("source").agg(F.avg("score").alias("s")).collect()
    assert {r.source: round(r.s, 6) for r in full} == {"driver_a": 0.595528, "driver_b": 0.393421, "noise": 0.059127}


def test_published_drift_errors(spark):
    drift = fixtures.synthetic_panel(spark, "drift", fixtures.DRIFT_SEEDS).persist()
    rows = predictors.compare_drift(drift, "target", 5, 120, (120, 419), (510, 599)).groupBy("model").agg(F.avg("mae").alias("m")).collect()
    assert {r.model: round(r.m, 6) for r in rows} == {"static": 0.547689, "dynamic": 0.506484}


def test_published_gate_and_lifecycle(spark):
    mixed = fixtures.mixed_relations(spark, tuple(range(100))).persist()
    truth = mixed.where("source like 'true%'")
    for chosen, want in ((selection.evidence_gate(mixed, 3).where("selected"), (1.0, 1.0)), (selection.fixed_threshold(mixed), (0.262, 1.0))):
        r = selection.precision_recall(chosen, truth, "series_id").agg(F.avg("precision"), F.avg("recall")).first()
        assert (round(r[0], 3), r[1]) == want
    dying = transforms.transform(fixtures.synthetic_panel(spark, "relation_death", tuple(range(8))), {"x": "diff", "y": "diff"})
    timed = relations.rolling_relations(dying, 3, 36, "y", differenced=True)
    assert {int(r.series_id): r.detection_lag for r in lifecycle.detection_lags(timed, 120).collect()} == dict(enumerate((11, 15, 8, 14, 7, 9, 9, 25)))


def test_detection_covers_every_series(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for name, first, n in (("early", 100, 46), ("late", 24000, 60)):
        x = [rng.gauss(0, 1) for _ in range(n)]
        y = [rng.gauss(0, 1) if t < 1 or t > n // 2 else x[t - 1] for t in range(n)]
        rows += [(name, first + t, k, v) for k, vs in (("x", x), ("volume", y)) for t, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "series_id string, t long, signal string, value double")
    monkeypatch.setattr(catalog.panels, "panel", lambda spark, d: frame)
    steps = relations.rolling_relations(frame, catalog.LAGS, catalog.WINDOW, "volume").persist()
    want = {}
    for r in steps.groupBy("series_id").agg(F.min("step"), F.max("step")).collect():
        middle = (r[1] + r[2]) // 2
        decays = lambda end: lifecycle.lifecycle(steps.where((F.col("series_id") == r[0]) & (F.col("step") <= end))).first().state == "decaying"  # noqa: B023, E731
        want[r[0]] = next((end - middle for end in range(middle, r[2] + 1) if decays(end)), None)
    assert {r.series_id: r.detection_lag for r in catalog.relation_detection(spark, "").collect()} == want
    assert set(want) == {"early", "late"} and None not in want.values()


def test_noise_floor_and_gate(spark):
    for n, k, want in ((191, 1, 0.1420), (191, 6, 0.1896), (24, 1, 0.4034)):
        assert round(math.tanh(stats.critical_z(0.05, k) / math.sqrt(n - 3)), 4) == want
    p = spark.createDataFrame([("f", x) for x in (0.01, 0.02, 0.049, 0.051)], "series_id string, p_value double")
    assert {r.fdr_cutoff for r in selection.benjamini_hochberg(p).collect()} == {0.02}
    admitted = spark.createDataFrame([(0.1,), (0.15,), (0.325,), (0.5,), (None,)], "x double").select(selection.admission(F.col("x"))).collect()
    assert [None if r[0] is None else round(r[0], 9) for r in admitted] == [0.0, 0.0, 0.5, 1.0, None]


def test_generator_states(spark):
    state, want = evaluation.SEED, []
    for _ in range(40):
        state = (evaluation.MULTIPLIER * state + evaluation.INCREMENT) % evaluation.MODULUS
        want.append(state)
    assert [r[0] for r in spark.range(40).select(evaluation.generator_state(F.col("id"), 40)).collect()] == want


def test_intervals_are_brute_force(spark):
    rng = random.Random(1)
    values = [round(rng.uniform(-1, 1), 3) for _ in range(7)]
    skills = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series_id string, fold int, skill double")
    state, medians, means = evaluation.SEED, [], []
    for _ in range(50):
        sample = []
        for _ in values:
            state = (evaluation.MULTIPLIER * state + evaluation.INCREMENT) % evaluation.MODULUS
            sample.append(values[state % 7])
        medians.append(statistics.median(sample))
    state = evaluation.SEED
    for _ in range(50):
        total = 0.0
        for v in values:
            state = (evaluation.MULTIPLIER * state + evaluation.INCREMENT) % evaluation.MODULUS
            total += v if state < evaluation.MODULUS // 2 else -v
        means.append(total / 7)
    r = evaluation.skill_intervals(skills, resamples=50).first()
    assert near(r.median, statistics.median(values)) and near(r.low, sorted(medians)[2]) and near(r.high, sorted(medians)[47])
    r = evaluation.sign_flip_intervals(skills, resamples=50).first()
    assert near(r.low, sorted(means)[2]) and near(r.high, sorted(means)[47])


def test_measures(spark):
    rows = spark.createDataFrame([("s", t, float(a), float(p), float(q)) for t, (a, p, q) in enumerate([(1, 2, 1), (3, 3, 2), (2, 4, 3), (5, 5, 5)])], "series_id string, t long, actual double, guess double, persistence double")
    r = evaluation.errors(rows, "guess").first()
    assert r.mae == 0.75 and near(r.rmse, math.sqrt(5 / 4))
    r = evaluation.directional_accuracy(rows, "guess").first()
    assert r.decided == 0.75 and near(r.accuracy, 1 / 3)
    assert evaluation.worst_decile(rows, "guess").first().worst_decile == 2
    assert math.isnan(evaluation.directional_accuracy(rows, "persistence").first().accuracy)
    folds = evaluation.rolling_origin_folds(spark.createDataFrame([("s", 20), ("short", 3)], "series_id string, n long"), 2, 10, 3)
    assert [(r.fold, r.train_lo, r.train_hi, r.test_hi) for r in folds.collect()] == [(0, 0, 10, 12), (1, 0, 13, 15), (2, 0, 16, 18)]
    assert evaluation.leaking_folds(folds).isEmpty()


def test_collinear_sources_are_dropped(spark):
    rng = random.Random(8)
    a = [rng.gauss(0, 1) for _ in range(60)]
    data = {"target": [rng.gauss(0, 1) for _ in range(60)], "a": a, "b": [2 * x for x in a], "c": [rng.gauss(0, 1) for _ in range(60)], "zero": [0.0] * 60}
    for t in range(1, 60):
        data["target"][t] += 0.8 * a[t - 1]
    frame = long(spark, **data)
    names = [("s", "m", s, i + 1, 1.0) for i, s in enumerate(("a", "b", "c", "zero"))]
    sources = spark.createDataFrame(names, "series_id string, model string, source string, rank int, scale double")
    rows = models.features(frame, "target", sources, 2)
    near_ones = models.nearly_proportional(models.gram(rows), 2)
    pairs = models.proportional_pairs(frame, sources, 2, rows.select("series_id", "t"), near_ones)
    assert {(1, 2)} <= {(r.low, r.high) for r in near_ones.collect()} <= {(1, 2), (1, 4), (2, 4), (3, 4)}  # a vector of zeros has no minors
    assert [(r.low, r.high) for r in pairs.collect()] == [(1, 2)]
    r = models.fit(rows, pairs, 2).first()
    assert (r.fit_status, r.kept, r.dropped) == ("fit_after_collinearity_backoff", [1, 3], [2, 4]) and len(r.coefficients) == 11
    solved = models.predict(rows, models.fit(rows, pairs, 2))
    normal = solved.select(F.sum((F.col("y") - F.col("predicted"))).alias("e")).first()
    assert abs(normal.e) < 1e-8


def test_sweep_does_not_see_the_future(spark):
    rng = random.Random(6)
    data = {k: [rng.gauss(0, 1) for _ in range(60)] for k in ("target", "a", "b")}
    for t in range(1, 60):
        data["target"][t] += 0.9 * data["a"][t - 1]
    frame, budgets = long(spark, **data), selection.tiers(spark)
    ends = spark.createDataFrame([("s", 47)], "series_id string, train_end long")
    rows = sweep.budget_sweep(frame, "target", 2, 2, ends, budgets).collect()
    changed = frame.withColumn("value", F.when(F.col("t") > 47, F.col("value") * 0 + 7).otherwise(F.col("value")))
    again = {r.budget: r for r in sweep.budget_sweep(changed, "target", 2, 2, ends, budgets).collect()}
    assert len(rows) == 5 and all((r.sources, r.fit_status) == (again[r.budget].sources, again[r.budget].fit_status) for r in rows)
    by = {r.budget: r for r in rows}
    assert by[1.0].mae_loss_pct == 0 and by[1.0].model_mae < by[1.0].persistence_mae
    kept = [by[b].retained for b in selection.TIERS]
    assert kept == sorted(kept, reverse=True)
    assert all((r.model_mae is None) == (r.admitted == 0) for r in rows)


def case_files(folder, gap=False):
    rng = random.Random(2)
    axis = cases.month_axis("2005-01", "2014-12")
    y, rows, a = 100.0, [], 50.0
    before = 0.0
    for i, m in enumerate(axis):
        change = rng.gauss(0, 1)
        y, a = y + 0.9 * before + rng.gauss(0, 0.2), a + change
        before = change
        if not (gap and i == 7):
            rows.append(f"{m},{y:.6f},{a:.6f},{rng.gauss(0, 1):.6f}")
    (folder / "data.csv").write_text("date,y,a,b\n" + "\n".join(rows) + "\n")
    config = {"case_name": "toy", "csv": "data.csv", "date_column": "date", "target": "y", "candidate_signals": ["b", "a"], "frequency": "monthly", "lag_window": 2, "train_end": "2013-12", "test_start": "2014-01", "max_selected_signals": 2, "output_dir": "out", "seasonal_period": 12, "notes": ""}
    (folder / "case.json").write_text(json.dumps(config))
    return str(folder / "case.json"), config


def served(path):
    """A folder of cases that serves the toy case by its name."""
    folder = Path(path).parent / "served" / "toy"
    shutil.copytree(Path(path).parent, folder)
    return str(folder.parent)


def test_cases_are_strict(spark, tmp_path):
    path, config = case_files(tmp_path)
    frame = cases.read_case(spark, cases.load_case(path))
    assert frame.count() == 360 and panel.axis_audit(frame).where("is_complete").count() == 3
    for change in ({"extra": 1}, {"target": "a"}, {"frequency": "daily"}, {"lag_window": "2"}, {"train_end": "2014-13"}, {"max_selected_signals": 3}):
        (tmp_path / "case.json").write_text(json.dumps(config | change))
        with pytest.raises(cases.CaseError):
            cases.load_case(path)
    path, _ = case_files(tmp_path, gap=True)
    with pytest.raises(cases.CaseError, match="1 months are missing"):
        cases.read_case(spark, cases.load_case(path))


def test_reports(spark, tmp_path):
    path, _ = case_files(tmp_path)
    root, request = served(path), {"case_name": "toy", "transform_declarations": {"y": "diff", "a": "diff", "b": "none"}}
    status, found = report.analyze_payload(spark, request, root)
    assert status == 200 and found["outcome"] == "ok" and found["selection"]["selected_sources"] == ["a"]
    assert {k: found[k] for k in ("transform_diagnostics", "data_audit")} == report.audit_payload(spark, request, root)[1]
    assert report.snapshot_payload(spark, request, root)[1]["hash"] == found["snapshot"]["hash"]
    json.dumps(found)
    status, found = report.analyze_payload(spark, request | {"transform_declarations": dict.fromkeys("yab", "none")}, root)
    assert status == 422 and found["error"]["code"] == "persistent_level" and found["data_audit"]
    for name in ("none", "../served/toy", ""):
        assert report.analyze_payload(spark, {"case_name": name}, root)[0] == 404
    assert report.analyze_payload(spark, request)[0] == 404
    assert report.analyze_payload(spark, request | {"train_end": 7}, root)[0] == 500
    text = (tmp_path / "data.csv").read_text()
    upload = {"csv_base64": base64.b64encode(text.encode()).decode(), "target": "y", "candidate_signals": ["a"], "transform_declarations": {"y": "diff", "a": "diff"}, "train_end": "2013-12", "lag_window": 2}
    assert report.analyze_payload(spark, upload)[1]["outcome"] == "ok"
    bad = upload | {"csv_base64": base64.b64encode(text.replace("2010-03", "2010-02").encode()).decode()}
    axis = report.analyze_payload(spark, bad)[1]
    assert axis["error"]["code"] == "duplicate_months" and axis["data_audit"]["date_axis"]["duplicate_months"] == ["2010-02"] and axis["data_audit"]["date_axis"]["missing_months"] == ["2010-03"]
    assert report.analyze_payload(spark, {k: v for k, v in upload.items() if k != "target"})[0] == 422


def test_views(spark, tmp_path):
    path, _ = case_files(tmp_path)
    root, request = served(path), {"case_name": "toy", "transform_declarations": {"y": "diff", "a": "diff", "b": "none"}}
    status, found = report.analyze_payload(spark, request, root)
    assert views.view_of(status, found) == "report" and views.view_of(200, found | {"outcome": "baseline_only"}) == "baseline"
    assert views.view_of(200, found | {"schema_version": "other"}) == views.view_of(200, "text") == views.view_of(422, found) == "malformed"
    assert views.view_of(None, None, "timeout") == "timeout" and views.view_of(500, {}) == "failure"
    assert views.report_context(found)["target"] == "y" and views.decision(found)["sources"] == ["a"] and views.confidence(found)["confidence"] is None
    assert [r["source"] for r in views.relation_rows(found) if r["selected"]] == ["a"] and not views.has_evaluation(found)
    assert views.evaluation_interval({"evaluation": {"rolling_origin": {"low": -0.1, "median": 0.2, "high": 0.4, "folds": 9, "resolves": False}}}) == {"low": -0.1, "median": 0.2, "high": 0.4, "folds": 9, "resolves": False}
    assert views.report_filename({"case": {"name": "a b/c"}}) == "report-a-b-c.json" and views.shown_number(None) == "\u2014" and views.shown_percent(0.1234) == "+12.3%" and views.shown_signed(-1) == "-1.000"
    assert {r["signal"] for r in views.signal_rows(found)} == {"y", "a", "b"} and views.axis_summary(found)["continuous"] and views.may_analyze(found)
    assert views.badge("dead")["label"] == "Gone" and views.badge("else")["tone"] == "neutral" and [s["state"] for s in views.state_steps("stable") if s["active"]] == ["stable"]
    status, bad = report.analyze_payload(spark, request | {"transform_declarations": dict.fromkeys("yab", "none")}, root)
    assert views.view_of(status, bad) == "rejected" and views.error_fields(bad)["code"] == "persistent_level" and views.rejected_signals(bad) and not views.may_analyze(bad)
    snapshot = report.snapshot_payload(spark, request, root)[1]
    again = views.upload_of_snapshot(snapshot, {"target": "y", "candidate_signals": ["a", "b"], "transform_declarations": request["transform_declarations"], "train_end": "2013-12", "lag_window": 2})
    assert report.snapshot_payload(spark, again)[1]["hash"] == snapshot["hash"] == views.snapshot_fields(snapshot)["hash"]


def test_power_controls_are_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=60)
    y = 10 + np.concatenate([[0, 0], 2 * x[:-2]]) + 0.3 * rng.normal(size=60)
    panel = spark.createDataFrame([("s", 1000 + t, k, float(v[t])) for k, v in (("x", x), ("y", y)) for t in range(60)], "series_id string, t long, signal string, value double").persist()
    sources = spark.createDataFrame([("s", "ols", "x", 1, 1.0)], "series_id string, model string, source string, rank int, scale double")
    origins = spark.createDataFrame([("s", 1000 + t) for t in range(30, 60)], "series_id string, t long")

    def skills(values):
        at = lambda t: [1.0, values[t - 1], values[t - 2]]
        out = []
        for o in range(30, 60):
            beta = np.linalg.lstsq(np.array([at(t) for t in range(2, o)]), y[2:o], rcond=None)[0]
            out.append(1 - abs(y[o] - np.dot(at(o), beta)) / abs(y[o] - y[o - 1]))
        return out

    order, state = list(range(60)), power.SCRAMBLE_SEED
    for i in range(59, 0, -1):
        state = (1103515245 * state + 12345) % 2**31
        order[i], order[state % (i + 1)] = order[state % (i + 1)], order[i]
    noise, state = [], power.NOISE_SEED
    for o in range(30, 60):
        state = (1103515245 * state + 12345) % 2**31
        usual = np.abs(np.diff(y[2:o])).mean()
        noise.append(1 - abs(y[o] - y[o - 1] - (state / 2**31 - 0.5) * 2 * usual) / abs(y[o] - y[o - 1]))
    got = {}
    for r in power.controls(panel, "y", sources, 2, origins).orderBy("fold").collect():
        got.setdefault(r.control, []).append(r.skill)
    assert got["model"] == pytest.approx(skills(x)) and got["scrambled"] == pytest.approx(skills(x[order])) and got["degraded"] == pytest.approx(noise)
    assert set(got["identity"]) == {0.0}
    forecasts = power.origin_forecasts(panel, "y", sources, 2, origins, 1, False)
    assert [r.skill for r in power.origin_skills(forecasts, panel, "y").orderBy("fold").collect()] == pytest.approx(skills(x))
    beta = np.linalg.lstsq(np.array([[1.0, x[t - 1], x[t - 2]] for t in range(2, 50)]), y[2:50], rcond=None)[0]
    wrong = np.abs(y[50:] - np.array([[1.0, x[t - 1], x[t - 2]] for t in range(50, 60)]) @ beta).mean()
    r = power.block_skill(panel, "y", sources, 2, 1050, 1059, False).first()
    assert r.n == 10 and r.skill == pytest.approx(1 - wrong / np.abs(np.diff(y[49:])).mean())


def test_cubes(spark):
    doc = {"id": ["geo", "unit", "time"], "size": [2, 1, 3], "dimension": {"geo": {"category": {"index": {"AA": 0, "BB": 1}}}, "unit": {"category": {"index": {"U": 0}}}, "time": {"category": {"index": {"2020-01": 0, "2020-02": 1, "2020-03": 2}}}}}
    dense, sparse = doc | {"value": [1, 2, 3, 4, 5, 6]}, doc | {"value": {"3": 4.5, "4": 5.5, "5": 6.5}}
    texts = spark.createDataFrame([("d", json.dumps(dense)), ("s", json.dumps(sparse))], "dataset string, json string")
    series = [cases.CubeSeries("x", "d", (("geo", "AA"),)), cases.CubeSeries("y", "s", (("geo", "BB"), ("unit", "U")))]
    got = {(r.name, r.period): r.value for r in cases.decode_cube(spark, texts, series).collect()}
    assert got == {("x", f"2020-0{i}"): float(i) for i in (1, 2, 3)} | {("y", f"2020-0{i}"): i + 3.5 for i in (1, 2, 3)}
    assert cases.cube_panel(cases.decode_cube(spark, texts, series), "2020-01", "2020-03").count() == 6
    with pytest.raises(cases.CaseError):
        cases.cube_panel(cases.decode_cube(spark, texts, series), "2020-01", "2020-04")
    with pytest.raises(Exception, match="open"):
        cases.decode_cube(spark, texts, [cases.CubeSeries("x", "d", ())]).collect()
    assert series[0].url("http://x", "2020-01", "2020-02") == "http://x/d?lang=en&geo=AA&sinceTimePeriod=2020-01&untilTimePeriod=2020-02"


def test_search_and_frozen_test(spark, tmp_path):
    path, _ = case_files(tmp_path)
    frame = cases.read_case(spark, cases.load_case(path)).persist()
    end = lambda c, m: spark.createDataFrame([("toy", cases.month(m))], f"series_id string, {c} long")
    grid = sweep.validation_search(frame, "y", [1, 2], [0.1, 0.99], [1, 2], end("train_end", "2012-06"), end("validation_end", "2013-06"))
    cells = grid.collect()
    assert len(cells) == 8 and all(near(c.validation_mae, c.persistence_mae) for c in cells if c.n_sources == 0)
    best = sweep.select_cell(grid)
    r = sweep.frozen_test(frame, "y", best, end("train_end", "2013-06"), [1, 2]).first()
    assert r.test_rows == 18 and (r.mode == "model") == (r.model_mae is not None)
    sinks.write_selection(str(tmp_path / "s.json"), {k: v for k, v in best.first().asDict().items() if k in ("threshold", "lag_window", "validation_mae", "persistence_mae")} | {"max_selected_signals": 1})
    assert cases.load_selection(str(tmp_path / "s.json")).mode == best.first().mode


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("a", 0.1, None, ["x", "y"])], "n string, v double, w double, l array<string>")
    assert sinks.printable(table).first() == ("a", "0.1000000000", "", "x;y")
    assert "| a | 0.1000000000 |" in sinks.markdown(table, "T")
    sinks.write_csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_streams_agree_with_tables(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} {h:02d}:00:00", k, float(d * h)) for d in range(1, 9) for h in (1, 5, 23) for k in "ab"]
    table = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    streams.append_panel(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    whole = {tuple(r) for r in streams.stream_panel(table).collect()}
    done = {tuple(r) for r in spark.read.schema("series_id string, start timestamp, volume double, mean_value double").parquet(str(tmp_path / "out")).collect()}
    assert done <= whole and len(done) >= 10
