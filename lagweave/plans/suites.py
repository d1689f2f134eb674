"""Suites over synthetic panels with known truth, and summaries of many runs: every seed is a series, so one job covers all."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import evaluation, lifecycle, models, relations, selection, transforms
from ..sources import fixtures
from . import predictors
from .settle import settle

#: Seeds of the published suites, and the lag that the trended panels hold.
WALK_SEEDS, TRENDED_SEEDS, DEATH_SEEDS, MIXED_SEEDS = range(500), range(200), range(100), range(100)
TRUE_LAG = 3
#: Lags, window and the spacing of steps of the lifecycle suites, and steps within which an end must be seen.
MAX_LAG, WINDOW, SPACING, WITHIN = 3, 36, 6, 30


def _shares(score: Column) -> list[Column]:
    ordered = F.collect_list(score)
    return [F.count(F.lit(1)).alias("seeds"), F.median(score).alias("median_score"), stats.floor_quantile(ordered, 0.9).alias("p90_score"), F.avg((score > 0.06).cast("double")).alias("share_above_006"), F.avg((score > 0.30).cast("double")).alias("share_above_030")]


def score_suite(spark: SparkSession, kind: str, seeds: range, max_lag: int = 5) -> DataFrame:
    """How strong x -> y looks on levels and on differences: (path, seeds, median_score, p90_score, share_above_006, share_above_030, correct_lag_rate)."""
    panel = settle(fixtures.synthetic_panel(spark, kind, tuple(seeds)))
    changed = transforms.transform(panel, {"x": "diff", "y": "diff"})
    parts = [relations.relations(p, max_lag, "y").withColumn("path", F.lit(name)) for name, p in (("levels", panel), ("differences", changed))]
    rows = parts[0].unionByName(parts[1])
    return rows.groupBy("path").agg(*_shares(F.col("score")), F.avg((F.col("lag") == TRUE_LAG).cast("double")).alias("correct_lag_rate"))


def noise_lifecycles(spark: SparkSession, seeds: range = range(50), max_lag: int = MAX_LAG, window: int = WINDOW) -> DataFrame:
    """(series_id, stability, state) of the relation x -> y between differences of independent walks, from every sixth window."""
    changed = transforms.transform(fixtures.synthetic_panel(spark, "random_walks", tuple(seeds)), {"x": "diff", "y": "diff"})
    timed = relations.rolling_relations(changed, max_lag, window, "y", differenced=True)
    first = window + max_lag + 1
    return lifecycle.lifecycle(timed.where((F.col("step") >= first) & ((F.col("step") - first) % SPACING == 0))).select("series_id", "stability", "state")


def death_detections(spark: SparkSession, seeds: range = DEATH_SEEDS, within: int = WITHIN) -> DataFrame:
    """(series_id, detection_lag): steps until the end of a relation is seen; NULL if it isn't within the given steps."""
    dying = transforms.transform(fixtures.synthetic_panel(spark, "relation_death", tuple(seeds)), {"x": "diff", "y": "diff"})
    timed = relations.rolling_relations(dying, MAX_LAG, WINDOW, "y", differenced=True).where(F.col("step") >= WINDOW + MAX_LAG + 1)
    found = lifecycle.detection_lags(timed, fixtures.DEATH_STEP)
    return found.select("series_id", F.when(F.col("detection_lag") <= within, F.col("detection_lag")).alias("detection_lag"))


def detection_summary(detections: DataFrame) -> DataFrame:
    """One row: (seeds, detected, success_rate, median_lag)."""
    n, hit = F.count(F.lit(1)), F.count("detection_lag")
    return detections.agg(n.alias("seeds"), hit.alias("detected"), (hit / n).alias("success_rate"), F.median("detection_lag").alias("median_lag"))


def gate_runs(spark: SparkSession, seeds: range = MIXED_SEEDS) -> DataFrame:
    """(series_id, selector, precision, recall, selected) of a fixed threshold and of the evidence gate on mixed relations."""
    mixed = settle(fixtures.mixed_relations(spark, tuple(seeds)))
    truth = mixed.where("source like 'true%'")
    parts = []
    for name, chosen in (("fixed_threshold", selection.fixed_threshold(mixed)), ("evidence_gate", selection.evidence_gate(mixed, MAX_LAG).where("selected"))):
        n = chosen.groupBy("series_id").agg(F.count(F.lit(1)).alias("selected"))
        parts.append(selection.precision_recall(chosen, truth, "series_id").join(n, "series_id", "left").select("series_id", F.lit(name).alias("selector"), "precision", "recall", F.coalesce("selected", F.lit(0)).alias("selected")))
    return parts[0].unionByName(parts[1])


def gate_summary(runs: DataFrame) -> DataFrame:
    """One row: means of both selectors, and the gate's lift."""
    mean = lambda c, name: F.avg(F.when(F.col("selector") == name, F.col(c)))
    row = runs.agg(F.count_distinct("series_id").alias("seeds"), *[mean(c, name).alias(f"{name}_{c}") for name in ("fixed_threshold", "evidence_gate") for c in ("precision", "recall")])
    return row.withColumns({f"{c}_lift": F.col(f"evidence_gate_{c}") - F.col(f"fixed_threshold_{c}") for c in ("precision", "recall")})


def calibration_rows(spark: SparkSession, seed: int = 0, count: int = 120) -> DataFrame:
    """(series_id, t, confidence, error): errors drawn with a spread that grows as confidence falls."""
    support = 1 - F.col("t") / (count - 1)
    # fixed values: what stability, uncertainties and spreads are at full support, and what they gain without
    lost = 1 - support
    score = evaluation.prediction_confidence(F.lit(0.70), 0.08 + lost * 0.60, support, 0.10 + lost * 0.80)
    rng = random.Random(40_000 + seed)
    draws = spark.createDataFrame([(t, rng.gauss(0.0, 1.0)) for t in range(count)], "t long, draw double")
    rows = draws.withColumn("confidence", score)
    return rows.select(F.lit(str(seed)).alias("series_id"), "t", "confidence", F.abs((0.10 + (1 - F.col("confidence")) * 1.40) * F.col("draw")).alias("error"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, in order; NULL last."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("value").asc_nulls_last())


def measure_summary(rows: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Runs, and mean, least and most of every measure, by keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), *[f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def source_summary(found: DataFrame) -> DataFrame:
    """Each source's rank and score over many series."""
    return measure_summary(relations.ranked(found), ["source"], ["rank", "score"])


def admission_summary(gates: DataFrame) -> DataFrame:
    """Each source's trust and admission over many series, its direction (+1, -1 or mixed), and how often nothing of it was admitted."""
    table = measure_summary(gates, ["source"], ["trust", "admission"])
    sides = gates.groupBy("source").agg(F.count_distinct("direction").alias("k"), F.first("direction").alias("d"), F.count_if(F.col("admission") == 0).alias("blocked_runs"))
    direction = F.when(F.col("k") > 1, "mixed").otherwise(F.format_string("%+d", F.col("d")))
    return table.join(sides.select("source", direction.alias("direction"), "blocked_runs"), "source")


def sensitivity(before: DataFrame, after: DataFrame) -> DataFrame:
    """(series_id, model, mean_change, max_change, n) between two sets of (series_id, model, t, predicted)."""
    both = before.join(after.select("series_id", "model", "t", F.col("predicted").alias("_other")), ["series_id", "model", "t"])
    change = F.abs(F.col("predicted") - F.col("_other"))
    return both.groupBy("series_id", "model").agg(F.avg(change).alias("mean_change"), F.max(change).alias("max_change"), F.count(F.lit(1)).alias("n"))


def sensitivity_summary(rows: DataFrame) -> DataFrame:
    """Mean changes of each model over many series."""
    return measure_summary(rows, ["model"], ["mean_change"])


def trust_counterfactual(panel: DataFrame, target: str, lags: int, source: str, train: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """How far predictions move if one source is trusted fully: ``sensitivity`` of the trust-gated model and of one that scales its two best sources by their weights."""
    found = settle(relations.relations(panel.where(F.col("t") <= train[1]), lags, target))
    top = settle(models.top_sources(found, target, 2, "weighted"))
    out = []
    for now in (found, selection.with_full_trust(found, source)):
        gated = predictors.forecasts(predictors.mixture_features(panel, target, predictors.trust_weights(now, target), lags), train, test, lags)
        scaled = top.drop("scale").join(now.where(F.col("target") == target).select("series_id", "source", F.col("weight").alias("scale")), ["series_id", "source"]).select(*top.columns)
        out.append(gated.unionByName(predictors.forecasts(models.features(panel, target, scaled, lags), train, test, lags)))
    return sensitivity(*out)


def ladder(panel: DataFrame, target: str, lags: int, train: tuple[int, int], test: tuple[int, int], budgets: DataFrame, track: str = "ladder") -> DataFrame:
    """One row for each series and budget: sources kept by tier, what the model computes, its errors, and its loss against the full budget."""
    found = settle(relations.relations(panel.where(F.col("t") <= train[1]), lags, target))
    kept = selection.retain(found, budgets)
    tier = F.substring_index("source", "_", 1)
    counts = kept.groupBy("series_id", "budget").agg(F.count(F.lit(1)).alias("retained"), *[F.count_if(tier == t).alias(f"{t}_kept") for t in ("strong", "medium", "weak", "noise")])
    n_train = train[1] - train[0] + 1
    weights = predictors.budget_weights(found, target, budgets)
    # a budget that keeps nothing leaves the target's own past
    empty = found.select("series_id").distinct().crossJoin(F.broadcast(budgets.select("budget"))).withColumn("model", F.format_string("budget_%.2f", "budget")).join(weights.select("series_id", "model").distinct(), ["series_id", "model"], "left_anti")
    alone = empty.select("series_id", "model", F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("scale"))
    scored = predictors.evaluate(predictors.mixture_features(panel, target, weights, lags), train, test, lags).unionByName(predictors.evaluate(models.features(panel, target, alone, lags), train, test, lags))
    rows = scored.withColumn("budget", F.expr("cast(substring(model, 8) as double)")).drop("model").join(budgets, "budget").join(counts, ["series_id", "budget"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts.columns if c not in ("series_id", "budget")})
    rows = rows.withColumns({"track": F.lit(track), "compute": F.col("retained") * lags * n_train}).withColumn("bytes", F.col("compute") * selection.VALUE_BYTES)
    full = rows.where("budget = 1").select("series_id", F.col("compute").alias("_c"), F.col("mae").alias("_m"), F.col("rmse").alias("_r"))
    rows = rows.join(full, "series_id", "left")
    return rows.withColumns({"compute_reduction_pct": stats.reduction_pct("compute", "_c"), "mae_loss_pct": stats.increase_pct("mae", "_m"), "rmse_loss_pct": stats.increase_pct("rmse", "_r")}).drop("_c", "_m", "_r")


def ladder_summary(rows: DataFrame) -> DataFrame:
    """``measure_summary`` of ladders by track and budget."""
    measures = ["retained", "compute", "bytes", "mae", "rmse", "compute_reduction_pct", "mae_loss_pct", "rmse_loss_pct"]
    first = rows.groupBy("track", "budget").agg(F.first("threshold").alias("threshold"))
    return measure_summary(rows, ["track", "budget"], measures).join(first, ["track", "budget"])
