"""Published figures of the suites, and report files of cases that are written here."""

import json
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.functions import stats
from lagweave.operators import evaluation, lifecycle, models, relations, selection, transforms
from lagweave.plans import files, power, predictors, suites, sweep
from lagweave.sources import cases, fixtures, panel


def test_normal_tail_and_critical_values(spark):
    zs = [0.0, 1e-9, 1e-3, 0.00999, 0.01, 0.1, 1.0, 1.96, 4.0, 6.0, 8.0, 12.0, 20.0, 30.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.two_sided(F.col("z")).alias("p")).collect():
        assert math.isclose(r.p, math.erfc(r.z / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-14)
    for r in spark.createDataFrame([(x,) for x in (0.5, 0.05, 0.01, 1e-4, 1e-9)], "a double").select("a", stats.critical(F.col("a")).alias("z")).collect():
        assert math.isclose(math.erfc(r.z / math.sqrt(2)), r.a, rel_tol=1e-9)
    for k in (1, 6, 45):
        level = 1 - 0.95 ** (1 / k)
        assert math.isclose(spark.range(1).select(stats.critical(F.lit(level)).alias("z")).first().z, stats.critical_z(0.05, k), rel_tol=1e-9)


def test_random_walk_and_trended_suites(spark):
    walks = {r.path: r for r in suites.score_suite(spark, "random_walks", suites.WALK_SEEDS, max_lag=3).collect()}
    assert (round(walks["levels"].median_score, 10), round(walks["differences"].median_score, 10)) == (0.4103115938, 0.0883252720)
    assert (round(walks["levels"].share_above_030, 3), walks["differences"].share_above_030) == (0.664, 0.0)
    trended = {r.path: r for r in suites.score_suite(spark, "trended_lag3", suites.TRENDED_SEEDS, max_lag=5).collect()}
    assert trended["differences"].correct_lag_rate == 1.0 and trended["levels"].seeds == 200


def test_lifecycle_suites(spark):
    r = suites.detection_summary(suites.death_detections(spark)).first()
    assert (r.seeds, r.detected, r.success_rate, r.median_lag) == (100, 100, 1.0, 14.5)
    noise = suites.noise_lifecycles(spark, range(100))
    values = noise.where("stability is not null").agg(F.median("stability").alias("m"), stats.floor_quantile(F.collect_list("stability"), 0.9).alias("p"), F.max("stability").alias("x")).first()
    assert tuple(round(v, 3) for v in values) == (0.082, 0.252, 0.359)
    states = {r.value: r.n for r in suites.distribution(noise, "state").collect()}
    assert sum(states.values()) == 100 and not {"stable", "strengthening"} & {*states}


def test_gate_and_calibration_suites(spark):
    r = suites.gate_summary(suites.gate_runs(spark)).first()
    assert (r.seeds, round(r.fixed_threshold_precision, 3), r.evidence_gate_precision, r.evidence_gate_recall, r.recall_lift) == (100, 0.262, 1.0, 1.0, 0.0)
    rows = suites.calibration_rows(spark)
    assert round(evaluation.spearman(rows, "confidence", "error").first().spearman, 3) == -0.488
    bins = evaluation.calibration_bins(rows, "confidence", "error").orderBy("bin").collect()
    assert [b.n for b in bins] == [30] * 4 and bins[0].error > bins[3].error


def test_ladder_summary_is_published(spark):
    budgets = selection.tiers(spark)
    panels = fixtures.synthetic_panel(spark, "ladder", fixtures.LADDER_SEEDS).persist()
    drift = fixtures.synthetic_panel(spark, "drift", fixtures.DRIFT_SEEDS).persist()
    rows = suites.ladder(panels, "target", 5, (5, 419), (510, 599), budgets).unionByName(suites.ladder(drift, "target", 5, (120, 419), (510, 599), budgets, "drift"))
    table = {(r.track, r.budget): r for r in suites.ladder_summary(rows).collect()}
    full = table["ladder", 1.0]
    assert (round(full.retained_mean, 2), round(full.mae_mean, 6), full.runs) == (13.20, 0.500765, 5)
    assert [round(table["ladder", b].mae_loss_pct_mean, 2) for b in (0.75, 0.5, 0.25, 0.0)] == [4.11, 55.23, 81.77, 137.57]
    assert [round(table["ladder", b].compute_reduction_pct_mean, 2) for b in (0.75, 0.5, 0.25, 0.0)] == [41.56, 73.00, 84.49, 98.46]
    assert [round(table["drift", b].mae_loss_pct_mean, 2) for b in (0.75, 0.5, 0.25, 0.0)] == [0.14, 2.03, 8.74, 13.32]


def test_trust_counterfactual_is_published(spark):
    base = fixtures.synthetic_panel(spark, "base", fixtures.BASE_SEEDS).persist()
    rows = suites.trust_counterfactual(base, "target", 5, "driver_b", (5, 419), (510, 599))
    table = {r.model: r for r in suites.sensitivity_summary(rows).collect()}
    assert round(table["trust_gated"].mean_change_mean, 10) == 0.0774200737 and table["weighted"].mean_change_mean < 1e-9
    found = relations.relations(base.where("t <= 419"), 5, "target").persist()
    gates = {r.source: r for r in suites.admission_summary(selection.trust_gates(found)).collect()}
    assert {*gates} == {"driver_a", "driver_b", "noise"} and gates["driver_a"].direction == "+1" and gates["noise"].blocked_runs == 5
    assert {r.source: r.runs for r in suites.source_summary(found).collect()} == dict.fromkeys(gates, 5)
    errors = predictors.fit_and_predict(base, "target", 5, "trust_gated", (5, 419), (510, 599)).groupBy("series_id").agg(stats.mae(F.col("y"), F.col("predicted")).alias("m")).agg(F.avg("m")).first()
    assert round(errors[0], 6) == 0.454786
    with pytest.raises(ValueError):
        predictors.fit_and_predict(base, "target", 5, "other", (5, 419), (510, 599))


def test_sweep_of_a_written_case_is_published(spark, tmp_path):
    """A case written from a synthetic panel, read back, swept and reported twice with equal bytes."""
    sources = [*fixtures.LADDER]
    levels = fixtures.synthetic_panel(spark, "ladder", (227,)).where("t < 216").withColumn("t", F.col("t") + cases.month("2008-01"))
    settings = {"case_name": "ladder", "target": "target", "candidate_signals": sources, "frequency": "monthly", "lag_window": 5, "train_end": "2023-12", "test_start": "2024-01", "max_selected_signals": 5, "output_dir": "out", "seasonal_period": 0, "notes": ""}
    digest = files.write_case(str(tmp_path), levels, settings, [{"name": "target", "filters": "unit=I15&s_adj=SCA"}], "How it was made.")
    path = str(tmp_path / "case.json")
    assert cases.file_sha256(str(tmp_path / "data.csv")) == digest and cases.signal_metadata(path)["target"]["unit"] == "I15" and cases.manifest(path)["coverage"]["months"] == 216
    config = cases.load_case(path)
    frame = cases.read_case(spark, config).persist()
    budgets = selection.tiers(spark)
    runs = []
    for name in "ab":
        found, predicted = sweep.budget_sweep_frames(frame, config.target, config.lag_window, config.max_selected_signals, config.windows(spark), budgets)
        runs.append([p.read_bytes() for p in files.write_sweep(str(tmp_path / name), config, found, predicted)])
    assert runs[0] == runs[1]
    header, *lines = runs[0][0].decode().splitlines()
    rows = [dict(zip(header.split(","), x.split(","))) for x in lines]
    assert header.split(",") == [c for c in found.columns if c != "series_id"] and [r["budget"] for r in rows] == ["1.00", "0.75", "0.50", "0.25", "0.00"]
    assert (rows[0]["persistence_mae"], rows[0]["model_mae"]) == ("1.2841998951", "0.7382196369")
    assert runs[0][1].decode().count("\n") == 1 + 5 * 24
    forecast, used = cases.read_frozen_forecast(spark, str(tmp_path / "a" / "sweep_predictions.csv"), "1.00", 24)
    assert forecast.count() == 24 and ";".join(used) == rows[0]["used_sources"]
    with pytest.raises(cases.CaseError):
        cases.read_frozen_forecast(spark, str(tmp_path / "a" / "sweep_predictions.csv"), "1.00", 23)
    table = files.availability(frame, "2008-01", "2025-12")
    assert table.where("available").count() == 16 and b"signal_x" not in files.write_availability(str(tmp_path / "c"), table)[0].read_bytes()


def toy(spark, tmp_path, n=60, **settings):
    """target follows signal by a month; other is noise, twin is proportional to signal."""
    rng = random.Random(5)
    signal = [rng.gauss(0, 1) for _ in range(n)]
    target = [10 + (0.9 * signal[t - 1] if t else 0) + rng.gauss(0, 0.05) for t in range(n)]
    signal, target = [round(x, 4) for x in signal], [round(x, 4) for x in target]
    data = {"target": target, "signal": signal, "twin": [2 * x for x in signal], "other": [round(rng.gauss(0, 1), 4) for _ in range(n)]}
    frame = spark.createDataFrame([("toy", cases.month("2008-01") + t, k, v[t]) for k, v in data.items() for t in range(n)], "series_id string, t long, signal string, value double")
    base = {"case_name": "toy", "target": "target", "candidate_signals": ["twin", "signal", "other"], "frequency": "monthly", "output_dir": "out", "notes": "n"}
    files.write_case(str(tmp_path), frame, base | settings)
    return data, str(tmp_path / "case.json")


def test_real_case_is_brute_force(spark, tmp_path):
    data, path = toy(spark, tmp_path, lag_window=2, train_end="2011-06", test_start="2011-10", max_selected_signals=3, seasonal_period=12)
    config = cases.load_case(path)
    frame = cases.read_case(spark, config)
    frames = sweep.real_case(frame, "target", 2, 3, config.windows(spark), config.seasonal_period)
    y = data["target"]
    test = range(45, 60)  # from 2011-10 on; rows between the windows are in neither
    rows = frames["predictions"].orderBy("t").collect()
    assert [r.t - cases.month("2008-01") for r in rows] == [*test]
    at = lambda t, names: [1.0] + [data[s][t - lag] for lag in (1, 2) for s in names]
    beta = np.linalg.lstsq(np.array([at(t, ("target", "signal", "other")) for t in range(2, 42)]), y[2:42], rcond=None)[0]
    for r, t in zip(rows, test):
        assert r.persistence == pytest.approx(y[t - 1]) and r.seasonal == pytest.approx(y[t - 12]) and r.model == pytest.approx(np.dot(at(t, ("target", "signal", "other")), beta), abs=1e-6)
    metrics = {r.name: r for r in frames["metrics"].collect()}
    assert metrics["persistence"].mae == pytest.approx(statistics.mean(abs(y[t] - y[t - 1]) for t in test)) and metrics["model"].n == 15
    model = frames["model"].first()
    assert model.fit_status == "fit_after_collinearity_backoff" and {*model.used_sources.split(";")} in ({"signal", "other"}, {"twin", "other"})
    assert {r.source: r.selected for r in frames["ranking"].collect()} == {s: s in model.used_sources.split(";") for s in ("signal", "twin", "other")}
    again = [p.read_bytes() for p in files.write_real_case(str(tmp_path / "a"), config, frames)]
    assert again == [p.read_bytes() for p in files.write_real_case(str(tmp_path / "b"), config, sweep.real_case(frame, "target", 2, 3, config.windows(spark), config.seasonal_period))]
    none = sweep.real_case(frame, "target", 2, 3, config.windows(spark), 0)
    assert {r.name for r in none["metrics"].collect()} == {"persistence", "model"} and none["predictions"].where("seasonal is not null").isEmpty()


def test_adaptive_case_to_frozen_test(spark, tmp_path):
    windows = {"train_start": "2008-01", "train_end": "2010-06", "validation_start": "2010-07", "validation_end": "2011-06", "test_start": "2011-07", "test_end": "2012-12"}
    grids = {"relation_thresholds": [0.06, 0.99], "lag_windows": [1, 2], "max_selected_signals": [1, 2]}
    data, path = toy(spark, tmp_path, **windows, **grids)
    case = cases.load_adaptive_case(path)
    frame = cases.read_adaptive_case(spark, case).persist()
    with pytest.raises(cases.CaseError):
        cases.read_adaptive_case(spark, case, end="2012-11")
    grid = sweep.validation_search(frame, case.target, case.lag_windows, case.relation_thresholds, case.max_selected_signals, *case.search_windows(spark))
    best = sweep.select_cell(grid)
    y = data["target"]
    cells = grid.collect()
    assert len(cells) == 8 and all(c.persistence_mae == pytest.approx(statistics.mean(abs(y[t] - y[t - 1]) for t in range(30, 42))) for c in cells)
    paths = files.write_search(str(tmp_path / "a"), case, grid, best)
    assert [p.read_bytes() for p in paths] == [p.read_bytes() for p in files.write_search(str(tmp_path / "b"), case, grid, best)]
    chosen = cases.load_selection(str(paths[1]))
    assert (chosen.mode, chosen.case_name, chosen.test_evaluated) == ("model", "toy", False) and json.loads(paths[1].read_text())["validation_mae"] == best.first().validation_mae
    # changes of the test rows change neither the grid nor the choice
    changed = frame.withColumn("value", F.when(F.col("t") >= cases.month("2011-07"), 0.0).otherwise(F.col("value")))
    other = sweep.validation_search(changed, case.target, case.lag_windows, case.relation_thresholds, case.max_selected_signals, *case.search_windows(spark))
    assert sorted(map(str, other.collect())) == sorted(map(str, cells))
    found, predicted = sweep.frozen_test_frames(frame, case.target, chosen.cell(spark, case), case.test_windows(spark), [chosen.lag_window])
    r = found.first()
    own = r.used_sources.split(";")
    at = lambda t: [1.0] + [data[s][t - lag] for lag in range(1, chosen.lag_window + 1) for s in ("target", *own)]
    beta = np.linalg.lstsq(np.array([at(t) for t in range(chosen.lag_window, 42)]), y[chosen.lag_window : 42], rcond=None)[0]
    assert r.test_rows == 18 and r.model_mae == pytest.approx(statistics.mean(abs(y[t] - np.dot(at(t), beta)) for t in range(42, 60)), abs=1e-6)
    text = files.write_frozen_test(str(tmp_path / "c"), case, found, predicted)
    assert text[1].read_text().count("\n") == 19 and "not changed" in text[2].read_text() and f"{r.model_mae:.10f}" in text[2].read_text()
    guard, shown = sweep.frozen_test_frames(frame, case.target, chosen.cell(spark, case).withColumn("mode", F.lit("baseline_only")), case.test_windows(spark), [chosen.lag_window])
    assert guard.first().fit_status == "baseline_only_validation_guard" and guard.first().model_mae is None and shown.where("predicted is not null").isEmpty()


def test_mixed_transforms_in_windows_are_brute_force(spark):
    rng = random.Random(4)
    n, window = 60, 20
    levels = {k: list(np.cumsum([rng.gauss(0, 1) for _ in range(n)])) if k != "flat" else [rng.gauss(0, 1) for _ in range(n)] for k in ("y", "a", "flat")}
    declared = {"y": "diff", "a": "diff", "flat": "none"}
    frame = spark.createDataFrame([("s", t, k, float(v[t])) for k, v in levels.items() for t in range(n)], "series_id string, t long, signal string, value double")
    rows = relations.rolling_correlations(transforms.transform(frame, declared), 2, window, "y", ["y", "a"]).collect()
    assert len(rows) == 2 * 2 * (n - window + 1)
    for r in rows:
        part = {k: v[r.step - window : r.step] for k, v in levels.items()}
        seen = {k: [None] + [b - a for a, b in zip(v, v[1:])] if declared[k] == "diff" else v for k, v in part.items()}
        pairs = [(seen[r.source][i - r.lag], seen["y"][i]) for i in range(r.lag, window) if seen[r.source][i - r.lag] is not None and seen["y"][i] is not None]
        assert r.sample_count == len(pairs) and r.weight == pytest.approx(statistics.correlation(*zip(*pairs)))
    flagged = {(r.signal, r.step) for r in transforms.persistent_windows(frame, dict.fromkeys(levels, "none"), window).collect()}
    want = {(k, s) for k, v in levels.items() for s in range(window, n + 1) if abs(statistics.correlation(v[s - window : s - 1], v[s - window + 1 : s])) > 0.95}
    assert flagged == want
    with pytest.raises(transforms.PersistentLevels):
        transforms.guarded(spark.createDataFrame([("s", t, "x", float(t)) for t in range(30)], "series_id string, t long, signal string, value double"), {"x": "none"})


def test_running_lifecycle_is_that_of_every_prefix(spark):
    rng = random.Random(6)
    rows = [("s", "x", "y", t, rng.choice([1, 1, 2]), w, abs(w), 20) for t in range(30) for w in [round(rng.uniform(-0.2, 0.9) * (1 if t < 18 else 0.1), 3)]]
    timed = spark.createDataFrame(rows, "series_id string, source string, target string, step long, lag int, weight double, score double, sample_count long")
    columns = ("state", "points", "stability", "uncertainty", "recent_mean", "prior_mean", "slope")
    near = lambda a, b: a == b or a is not None and b is not None and not isinstance(a, str) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    for r in lifecycle.running_lifecycle(timed).where("step in (3, 6, 11, 19, 25, 29)").collect():
        whole = lifecycle.lifecycle(timed.where(F.col("step") <= r.step)).first()
        assert all(near(r[c], whole[c]) for c in columns)


def test_eras_are_parts_of_all_origins(spark):
    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(50)]
    y = [5 + (x[t - 1] if t else 0) + rng.gauss(0, 0.3) for t in range(50)]
    frame = spark.createDataFrame([("s", t, k, float(v[t])) for k, v in (("x", x), ("y", y)) for t in range(50)], "series_id string, t long, signal string, value double").persist()
    sources = spark.createDataFrame([("s", "frozen", "x", 1, 1.0)], "series_id string, model string, source string, rank int, scale double")
    eras = spark.createDataFrame([("s", "calm", 20, 29), ("s", "later", 35, 49)], "series_id string, era string, first long, last long")
    got = {(r.era, r.t): (r.fold, r.skill) for r in power.era_skills(frame, "y", sources, 1, eras).collect()}
    want = {r.t: r.skill for r in power.origin_skills(power.origin_forecasts(frame, "y", sources, 1, spark.range(20, 50).select(F.lit("s").alias("series_id"), F.col("id").alias("t"))), frame, "y").collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({(era, t): want[t] for era, a, b in (("calm", 20, 29), ("later", 35, 49)) for t in range(a, b + 1)})
    table = {r.era: r for r in power.era_intervals(power.era_skills(frame, "y", sources, 1, eras), resamples=50).collect()}
    assert table["calm"].folds == 10 and table["later"].median == pytest.approx(statistics.median(want[t] for t in range(35, 50))) and table["later"].low <= table["later"].median <= table["later"].high


def test_tables_and_scopes(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,a,b\n2020-01,1,x\n2020-02, 2.5 ,3\n2020-03,4,5\n")
    rows = {(r.t, r.signal): r.value for r in cases.read_table(spark, str(tmp_path / "t.csv"), end="2020-02").collect()}
    first = cases.month("2020-01")
    assert rows == {(first, "a"): 1.0, (first, "b"): None, (first + 1, "a"): 2.5, (first + 1, "b"): 3.0}
    assert cases.scope("unit=I15&s_adj=A%20B") == {"unit": "I15", "s_adj": "A B"} and cases.scope("unit = x; nothing; s_adj=y") == {"unit": "x", "s_adj": "y"}
    assert [round(r.coefficient, 6) for r in fixtures.drift_truth(spark).where("t in (0, 420, 599)").orderBy("t").collect()] == [0.15, 0.15, 0.65]
    series = cases.CubeSeries("x", "d", (("geo", "AA"),))
    assert json.loads(cases.fetch_cube(series, "http://h", "2020-01", "2020-02", lambda url, seconds: json.dumps({"url": url}).encode()))["url"].startswith("http://h/d?")
    for answer in (b"[]", b"<html>"):
        with pytest.raises(cases.CaseError):
            cases.fetch_cube(series, "http://h", "2020-01", "2020-02", lambda url, seconds: answer)  # noqa: B023
    with pytest.raises(cases.CaseError, match="repeated"):
        cases.check_series([series, series])
    for bad in ({"low": 0.5, "high": 0.5}, {"low": -0.1}, {"high": 1.1}):
        with pytest.raises(ValueError):
            selection.TrustRule(**bad)
    with pytest.raises(ValueError):
        selection.BudgetRule(value_bytes=0)
    assert models.feature_names("y", ["a"], 1) == predictors.mixture_feature_names("y", 1, "a") and predictors.mixture_feature_names("y", 1, None) == ["intercept", "y_lag1"]
    expanding = spark.createDataFrame([("s", "a", "y", 9, 0.5, 0.5), ("s", "b", "y", 9, -0.4, 0.4), ("s", "c", "y", 9, 0.1, 0.1)], "series_id string, source string, target string, step long, weight double, score double")
    assert files.check_cutoff(expanding, 9, ["b", "a"]) == {"a": 0.5, "b": -0.4}
    with pytest.raises(ValueError):
        files.check_cutoff(expanding, 9, ["a", "c"])
    assert panel.missing_steps(spark.createDataFrame([("s", 1, "x", 1.0), ("s", 3, "x", 1.0)], "series_id string, t long, signal string, value double")).first().t == 2
