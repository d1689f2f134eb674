"""Places in an order, found in ranges, against sorted lists."""

import math
import random

from pyspark.sql import functions as F

from lagweave.operators import evaluation, positions, selection


def table(spark, n=4000):
    """One long series with a value that a third of the rows share, one short series, and NULLs."""
    rng = random.Random(2)
    rows = [("long", t, 7.0 if t % 3 == 0 else round(rng.gauss(0, 9), 1), rng.gauss(0, 1)) for t in range(n)]
    rows += [("short", t, float(t % 2), rng.random()) for t in range(5)] + [("short", 9, None, 0.5), ("one", 0, 1.0, 2.0)]
    return rows, spark.createDataFrame(rows, "series_id string, t long, x double, y double").repartition(5)


def test_places_and_totals(spark):
    rows, frame = table(spark)
    for keys in (("series_id",), ()):
        placed = positions.cumulative(frame.where("x is not null"), keys, ["x", "series_id", "t"])
        got = {(r.series_id, r.t): (r._before, r._whole) for r in placed.collect()}
        groups = {}
        for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0], r[1])):
            groups.setdefault(r[0] if keys else None, []).append(r)
        assert got == {(r[0], r[1]): (i, len(g)) for g in groups.values() for i, r in enumerate(g)}
    # no task sorts a whole group, unless it is so small that Spark joins its ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranges = frame.where("series_id = 'long'").repartitionByRange("series_id", "x", "t").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 4000


def test_ranks_share_the_mean_of_ties(spark):
    rows, frame = table(spark)
    got = {(r.series_id, r.t): r.rank for r in evaluation.average_ranks(frame, "x", "rank").collect()}
    assert len(got) == len(rows)
    for name in ("long", "short", "one"):
        own = [r for r in rows if r[0] == name]
        key = lambda v: (v is not None, v or 0)  # noqa: E731  NULLs first
        for r in own[:200]:
            below = sum(key(o[2]) < key(r[2]) for o in own)
            equal = sum(o[2] == r[2] for o in own)
            assert got[name, r[1]] == below + (equal + 1) / 2


def test_bins_and_the_worst_tenth(spark):
    rows, frame = table(spark)
    bins = {(r.series_id, r.bin): r for r in evaluation.calibration_bins(frame.where("x is not null"), "x", "y").collect()}
    long = sorted((r for r in rows if r[0] == "long"), key=lambda r: (r[2], r[1]))
    for b in range(4):
        part = long[b * len(long) // 4 : (b + 1) * len(long) // 4]
        assert bins["long", b].n == len(part) and math.isclose(bins["long", b].error, sum(abs(r[3]) for r in part) / len(part))
    forecasts = frame.select("series_id", "t", F.col("x").alias("actual"), F.lit(0.0).alias("zero")).where("actual is not null")
    worst = {r.series_id: r.worst_decile for r in evaluation.worst_decile(forecasts, "zero").collect()}
    for name in ("long", "short", "one"):
        errors = sorted((abs(r[2]) for r in rows if r[0] == name and r[2] is not None), reverse=True)
        k = max(1, len(errors) // 10)
        assert math.isclose(worst[name], sum(errors[:k]) / k)


def test_a_pooled_family_is_one_sort(spark):
    rng = random.Random(4)
    p = [round(rng.random() ** 4, 4) for _ in range(3000)] + [0.01] * 500 + [None]
    tests = spark.createDataFrame([(f"s{i % 7}", i, v) for i, v in enumerate(p)], "series_id string, i int, p_value double")
    known = sorted(v for v in p if v is not None)
    cut = max((v for k, v in enumerate(known, 1) if v <= 0.05 * k / len(known)), default=0.0)
    found = selection.benjamini_hochberg(tests, keys=())
    assert {r.fdr_cutoff for r in found.collect()} == {cut} and found.count() == len(p) and cut > 0
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert {r.fdr_cutoff for r in selection.benjamini_hochberg(tests.where("p_value > 0.9"), keys=()).collect()} == {0.0}
    # each family of a series by itself
    each = {r.series_id: r.fdr_cutoff for r in selection.benjamini_hochberg(tests.where("p_value is not null")).collect()}
    for s in each:
        own = sorted(v for i, v in enumerate(p) if v is not None and f"s{i % 7}" == s)
        assert each[s] == max((v for k, v in enumerate(own, 1) if v <= 0.05 * k / len(own)), default=0.0)


def test_a_gate_over_all_panels(spark):
    rng = random.Random(6)
    rows = [(f"p{i % 3}", f"x{i}", "y", 1, rng.random(), 0.0, rng.randint(20, 60), 0.9, 0.05) for i in range(30)]
    found = spark.createDataFrame(rows, "series_id string, source string, target string, lag int, score double, weight double, sample_count long, stability double, uncertainty double")
    got = selection.evidence_gate(found, 3, keys=()).collect()
    assert len(got) == 30 and len({r.fdr_cutoff for r in got}) == 1
    most = max(r[6] for r in rows)
    assert all(math.isclose(r.support, min(1, r.sample_count / most)) for r in got) and {r.reason for r in got} <= {"selected", "below_fdr_corrected_effect", "insufficient_sample_support"}


def test_unpaired_rows_negative_uncertainty_and_few_samples_are_errors(spark):
    import pytest

    whole = spark.createDataFrame([("s", 1, 2.0, 3.0), ("s", 2, 4.0, 1.0)], "series_id string, t long, actual double, p double")
    assert evaluation.errors(evaluation.paired(whole, "p"), "p").first().mae == 2.0
    for row in (("s", 3, None, 1.0), ("s", 3, 1.0, None), ("s", 3, 1.0, float("nan"))):
        with pytest.raises(Exception, match="paired: step 3"):
            evaluation.errors(evaluation.paired(whole.unionByName(spark.createDataFrame([row], whole.schema)), "p"), "p").collect()
    at = lambda *v: spark.range(1).select(evaluation.prediction_confidence(*[F.lit(x).cast("double") for x in v]).alias("c")).first().c
    assert at(0.8, 0.0, 0.9, 1.0) == (0.8 + 1 + 0.9 + 0.5) / 4 and at(0.8, None, 0.9, 1.0) is None
    for v, name in (((0.8, -0.1, 0.9, 1.0), "parameter"), ((0.8, 0.1, 0.9, -1.0), "residual")):
        with pytest.raises(Exception, match=f"{name} uncertainty"):
            at(*v)
    floor = lambda n, **k: spark.range(1).select(selection.noise_floor(F.lit(n), 6, **k).alias("f")).first().f
    assert floor(3) is None and floor(191) == floor(191, strict=True) and math.isclose(floor(191), 0.1896, abs_tol=5e-5)
    with pytest.raises(Exception, match="more than three"):
        floor(3, strict=True)
