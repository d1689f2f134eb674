"""Report files of panels and trajectories, read back; and models with lags of their own."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import models, relations
from lagweave.plans import files
from lagweave.sources import cases

SCHEMA = "series_id string, t long, signal string, value double"


def panel(spark, n=40, seed=3):
    rng = random.Random(seed)
    start = cases.month("2015-01")
    data = {k: [rng.gauss(0, 1) for _ in range(n)] for k in ("b", "a", "target")}
    return data, start, spark.createDataFrame([("s", start + t, k, v) for k, vs in data.items() for t, v in enumerate(vs)], SCHEMA)


def test_panels_and_trajectories_are_read_back(spark, tmp_path):
    data, start, frame = panel(spark)
    (path,) = files.write_panel(str(tmp_path), frame)
    rows = list(csv.DictReader(path.open()))
    assert path.name == "series.csv" and len(rows) == 40 and rows[0]["date"] == "2015-01" and list(rows[0])[1:] == ["a", "b", "target"]
    assert all(float(r[k]) == round(data[k][i], 10) for i, r in enumerate(rows) for k in data)
    timed = relations.rolling_relations(frame, 2, 12, "target")
    (path,) = files.write_weights(str(tmp_path), timed)
    rows = list(csv.DictReader(path.open()))
    want = {(cases.month_name(r.step), r.source): r for r in timed.collect()}
    assert len(rows) == len(want) == 2 * 29 and [(r["date"], r["source"]) for r in rows] == sorted(want)
    assert all(r["weight"] == f"{want[r['date'], r['source']].weight:.10f}" and int(r["lag"]) == want[r["date"], r["source"]].lag for r in rows)
    two = frame.unionByName(frame.withColumn("series_id", F.lit("other")))
    with pytest.raises(ValueError, match="one series"):
        files.write_panel(str(tmp_path), two)


def test_models_with_lags_of_their_own(spark):
    """One job for models of one, two and four lags, each equal to least squares on its own rows."""
    data, start, frame = panel(spark, n=60)
    each = {"one": 1, "two": 2, "four": 4}
    sources = spark.createDataFrame([("s", m, s, i + 1, 1.0, lags) for m, lags in each.items() for i, s in enumerate(("a", "b"))], "series_id string, model string, source string, rank int, scale double, lags int")
    rows = models.features(frame, "target", sources, None)
    sums, lags = models.gram(rows), sources.select(*models.MODEL, "lags").distinct()
    near = models.nearly_proportional(sums, lags)
    pairs = models.proportional_pairs(frame, sources, None, rows.select("series_id", "lags", "t").distinct(), near)
    assert pairs.isEmpty()
    fitted = {r.model: r for r in models.fit_sums(sums, pairs, lags).collect()}
    for m, k in each.items():
        x = np.array([[1.0] + [data[s][t - lag] for lag in range(1, k + 1) for s in ("target", "a", "b")] for t in range(k, 60)])
        beta = np.linalg.lstsq(x, np.array(data["target"][k:]), rcond=None)[0]
        assert fitted[m].fit_status == "fit" and np.allclose(fitted[m].coefficients, beta)
    # the same with a source that is another's double, at each number of lags
    double = frame.unionByName(frame.where("signal = 'a'").select("series_id", "t", F.lit("c").alias("signal"), (2 * F.col("value")).alias("value")))
    more = sources.unionByName(sources.where("rank = 1").withColumns({"source": F.lit("c"), "rank": F.lit(3)}))
    rows = models.features(double, "target", more, None)
    sums = models.gram(rows)
    near = models.nearly_proportional(sums, lags)
    found = models.proportional_pairs(double, more, None, rows.select("series_id", "lags", "t").distinct(), near)
    assert sorted((r.model, r.low, r.high) for r in found.collect()) == [("four", 1, 3), ("one", 1, 3), ("two", 1, 3)]
    assert {(r.model, tuple(r.kept), tuple(r.dropped)) for r in models.fit_sums(sums, found, lags).collect()} == {(m, (1, 2), (3,)) for m in each}
    # a value that differs a little is a candidate, but no double
    odd = double.withColumn("value", F.when((F.col("signal") == "c") & (F.col("t") == start + 30), F.col("value") * (1 + 1e-7)).otherwise(F.col("value")))
    rows = models.features(odd, "target", more, None)
    near = models.nearly_proportional(models.gram(rows), lags)
    assert near.count() == 3 and models.proportional_pairs(odd, more, None, rows.select("series_id", "lags", "t").distinct(), near).isEmpty()
