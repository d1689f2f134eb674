"""The registered queries of the analytics engine over the base tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.stats import out
from ..operators import evaluation, lifecycle, models, relations, selection, transforms
from ..sources import panel as panels
from . import oracle, power, sweep
from .settle import settle

TARGET = panels.TARGET
#: Lags, rolling window, and the transforms declared for the signals of the base panels.
LAGS, WINDOW, SEASON = 3, 20, 12
#: A year of lags, with windows of three years, and of two that may begin with the series.
YEAR, YEAR_WINDOW, GROWING_WINDOW = 12, 36, 24
DECLARED = {s: "diff" for s in ("volume", "quantity", "discount", "tax", "lines", "orders", "finished", "mean_value", "max_value", "users")}
MIXED = DECLARED | {s: "none" for s in ("quantity", "tax", "orders", "mean_value", "users")}
LOGS = DECLARED | {s: "log_diff" for s in ("volume", "quantity", "lines", "orders", "users")}

Query = Callable[[SparkSession, str], DataFrame]


def _held(spark: SparkSession, d: str) -> DataFrame:
    """The base panels for queries that read them many times: small next to the tables they are summed from, so they are settled."""
    return settle(panels.panel(spark, d))


def _relations(frame: DataFrame, *more: str) -> DataFrame:
    return frame.select("series_id", "source", "target", *more, "lag", out("weight").alias("weight"), out("score").alias("score"), "sample_count")


def panel_axis_audit(spark: SparkSession, d: str) -> DataFrame:
    return panels.axis_audit(panels.panel(spark, d)).select("series_id", "signal", "first_t", "last_t", "present", "expected", "missing", "repeated", "is_complete")


def brand_complete_panel(spark: SparkSession, d: str) -> DataFrame:
    return panels.brand_panel(spark, d).select("series_id", "t", "signal", out("value", 4).alias("value"))


def brand_relations(spark: SparkSession, d: str) -> DataFrame:
    return _relations(relations.relations(panels.brand_panel(spark, d), LAGS, TARGET))


def missing_steps(spark: SparkSession, d: str) -> DataFrame:
    gaps = panels.missing_steps(panels.panel(spark, d).unionByName(panels.brand_rows(spark, d)))
    return gaps.select("series_id", "t", panels.month_label(F.col("t")).alias("period"))


def series_digest(spark: SparkSession, d: str) -> DataFrame:
    return panels.series_digest(panels.panel(spark, d))


def lagged_correlations(spark: SparkSession, d: str) -> DataFrame:
    return relations.lagged_correlations(panels.panel(spark, d), LAGS).select("series_id", "source", "target", "lag", out("weight").alias("weight"), "sample_count")


def best_lag_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _relations(relations.ranked(relations.relations(panels.panel(spark, d), LAGS)), "rank")


def diff_relations(spark: SparkSession, d: str) -> DataFrame:
    return _relations(relations.relations(transforms.transform(panels.panel(spark, d), DECLARED), LAGS))


def log_diff_relations(spark: SparkSession, d: str) -> DataFrame:
    return _relations(relations.relations(transforms.transform(panels.panel(spark, d), LOGS), LAGS))


def acf_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return transforms.diagnostics(panels.panel(spark, d)).select("series_id", "signal", out("lag1_acf").alias("lag1_acf"), "pairs", "highly_persistent")


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluation.target_rows(panels.panel(spark, d), TARGET)
    return evaluation.hold_out(evaluation.naive_forecasts(rows, SEASON))


def _test(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(spark, d).where("is_test")


def naive_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return _forecasts(spark, d).select("series_id", "t", F.col("idx").cast("long").alias("idx"), "is_test", *[out(c, 4).alias(c) for c in ("actual", "persistence", "seasonal")])


def baseline_errors(spark: SparkSession, d: str) -> DataFrame:
    test = _test(spark, d)
    parts = [evaluation.errors(test, p).select("series_id", F.lit(p).alias("baseline"), out("mae", 4).alias("mae"), out("rmse", 4).alias("rmse"), "n") for p in ("persistence", "seasonal")]
    return parts[0].unionByName(parts[1])


def baseline_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = baseline_errors(spark, d)
    return rows.groupBy("baseline").agg(F.count(F.lit(1)).alias("runs"), *[out(f(m), 3).alias(f"{n}_{m}") for m in ("mae", "rmse") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def mase(spark: SparkSession, d: str) -> DataFrame:
    rows = _forecasts(spark, d)
    return evaluation.mase(rows.where("is_test"), "seasonal", rows.where("not is_test")).select("series_id", out("scale", 4).alias("scale"), out("mase", 8).alias("mase"))


def directional_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.directional_accuracy(_test(spark, d), "seasonal").select("series_id", out("decided").alias("decided"), out("accuracy").alias("accuracy"))


def worst_decile(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.worst_decile(_test(spark, d), "persistence").select("series_id", out("worst_decile", 4).alias("worst_decile"))


def change_space(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.change_space(_test(spark, d), "seasonal").select("series_id", out("mean_absolute_change", 4).alias("mean_absolute_change"), out("change_mae", 4).alias("change_mae"), out("error_share_of_move", 8).alias("error_share_of_move"))


def _budget_relations(spark: SparkSession, d: str) -> DataFrame:
    return relations.relations(panels.panel(spark, d), LAGS)


def budget_tiers(spark: SparkSession, d: str) -> DataFrame:
    kept = selection.retain(_budget_relations(spark, d), selection.tiers(spark))
    return kept.select("series_id", "target", "budget", out("threshold").alias("threshold"), "rank", "source", "lag", out("score").alias("score"))


def resource_profile(spark: SparkSession, d: str) -> DataFrame:
    frame = _held(spark, d)
    rows = frame.where(F.col("signal") == TARGET).groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    return selection.resource_profile(relations.relations(frame, LAGS), selection.tiers(spark), LAGS, rows).withColumn("threshold", out("threshold"))


def trust_gates(spark: SparkSession, d: str) -> DataFrame:
    return selection.trust_gates(_budget_relations(spark, d)).select("series_id", "target", "rank", "source", "lag", "direction", out("trust").alias("trust"), out("admission", 8).alias("admission"))


def gated_mixture(spark: SparkSession, d: str) -> DataFrame:
    frame = _held(spark, d)
    gates = selection.trust_gates(relations.relations(frame, LAGS, TARGET))
    return selection.gated_mixture(frame, gates).select("series_id", "target", "t", out("mixture", 3).alias("mixture"))


def fixed_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _relations(selection.fixed_threshold(_budget_relations(spark, d)))


def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    found = _budget_relations(spark, d).where(F.col("target") == TARGET)
    key = "series_id"
    return selection.precision_recall(found.where("score > 0.2"), found.where("lag = 1"), key).select(key, out("precision").alias("precision"), out("recall").alias("recall"))


def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    found = _budget_relations(spark, d)
    floor = selection.noise_floor(F.col("sample_count"), LAGS)
    return found.select("series_id", "source", "target", "sample_count", out(floor, 8).alias("floor"), (F.col("score") > floor).alias("clears"))


def bh_cutoff(spark: SparkSession, d: str) -> DataFrame:
    found = _budget_relations(spark, d)
    rows = found.withColumn("p_value", stats.correlation_p(F.col("score"), F.col("sample_count")))
    return selection.benjamini_hochberg(rows).select("series_id", "source", "target", out("p_value", 8).alias("p_value"), out("fdr_cutoff", 8).alias("fdr_cutoff"), (F.col("p_value") <= F.col("fdr_cutoff")).alias("rejected"))


def pooled_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """All relations of all panels and brands as one family of tests."""
    found = relations.relations(panels.panel(spark, d).unionByName(panels.brand_panel(spark, d)), LAGS)
    tested = selection.benjamini_hochberg(found.withColumn("p_value", stats.correlation_p(F.col("score"), F.col("sample_count"))), keys=())
    return tested.select("series_id", "source", "target", out("p_value", 8).alias("p_value"), out("fdr_cutoff", 8).alias("fdr_cutoff"), (F.col("p_value") <= F.col("fdr_cutoff")).alias("rejected"))


def lag_features(spark: SparkSession, d: str) -> DataFrame:
    frame = _held(spark, d)
    sources = models.top_sources(relations.relations(frame, LAGS, TARGET), TARGET, 2).withColumn("scale", F.lit(1.0))
    rows = models.features(frame, TARGET, sources, 2)
    return rows.select("series_id", "t", out("y", 4).alias("y"), *[out(F.element_at("x", i + 1), 4).alias(f"x{i}") for i in range(7)])


def _unit(frame: DataFrame) -> DataFrame:
    """Every signal over its own largest value."""
    return frame.withColumn("value", F.col("value") / F.max("value").over(Window.partitionBy("series_id", "signal")))


def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cross-products of the target with every other signal of its series, all on the scale of 1."""
    frame = _held(spark, d)
    others = frame.where(F.col("signal") != TARGET).select("series_id", F.lit("m").alias("model"), F.col("signal").alias("source")).distinct()
    sources = others.withColumns({"rank": F.row_number().over(Window.partitionBy("series_id").orderBy("source")), "scale": F.lit(1.0)})
    return models.gram(models.features(_unit(frame), TARGET, sources, 2)).select("series_id", "i", "j", out("value", 6).alias("value"), "n")


def ar1_ols(spark: SparkSession, d: str) -> DataFrame:
    frame = _held(spark, d)
    none = frame.select("series_id").distinct().select("series_id", F.lit("ar1").alias("model"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("scale"))
    fitted = models.fit(models.features(_unit(frame), TARGET, none, 1), None, 1)
    return fitted.select("series_id", "fit_status", out(F.element_at("coefficients", 1), 6).alias("intercept"), out(F.element_at("coefficients", 2), 6).alias("slope"))


def rolling_relations(spark: SparkSession, d: str) -> DataFrame:
    found = relations.rolling_relations(panels.panel(spark, d), LAGS, WINDOW, TARGET)
    return _relations(found, "step", "window_start", "window_end")


def yearly_relations(spark: SparkSession, d: str) -> DataFrame:
    """The best of a year of lags of every edge."""
    return _relations(relations.relations(panels.panel(spark, d), YEAR))


def yearly_rolling_relations(spark: SparkSession, d: str) -> DataFrame:
    """The best of a year of lags in the three years before each step."""
    return _relations(relations.rolling_relations(panels.panel(spark, d), YEAR, YEAR_WINDOW, TARGET), "step", "window_start", "window_end")


def growing_window_relations(spark: SparkSession, d: str) -> DataFrame:
    """The best of a year of lags in the two years before each step, or in the steps since the series began."""
    return _relations(relations.rolling_relations(panels.panel(spark, d), YEAR, GROWING_WINDOW, TARGET, shortened=True), "step", "window_start", "window_end")


def rolling_diff_relations(spark: SparkSession, d: str) -> DataFrame:
    changed = transforms.transform(panels.panel(spark, d), DECLARED)
    return _relations(relations.rolling_relations(changed, LAGS, WINDOW, TARGET, differenced=True), "step", "window_start", "window_end")


def rolling_mixed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Rolling relations between levels of some signals and changes of others."""
    changed = transforms.transform(panels.panel(spark, d), MIXED)
    differenced = [s for s, kind in MIXED.items() if kind != "none"]
    return _relations(relations.rolling_relations(changed, LAGS, WINDOW, TARGET, differenced), "step", "window_start", "window_end")


def expanding_relations(spark: SparkSession, d: str) -> DataFrame:
    return _relations(relations.expanding_relations(panels.panel(spark, d), LAGS, TARGET, WINDOW), "step")


def trajectory_ranks(spark: SparkSession, d: str) -> DataFrame:
    found = relations.ranked(relations.rolling_relations(panels.panel(spark, d), LAGS, WINDOW, TARGET), ("series_id", "target", "step"))
    return found.where("rank <= 2").select("series_id", "target", "step", "rank", "source", "lag", out("score").alias("score"))


def _lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.lifecycle(relations.rolling_relations(_held(spark, d), LAGS, WINDOW, TARGET))


def relation_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return _lifecycle(spark, d).select("series_id", "source", "target", "step", "lag", "points", "sample_count", *[out(c, 8).alias(c) for c in ("weight", "stability", "uncertainty", "recent_mean", "prior_mean", "slope")], "state")


def relation_detection(spark: SparkSession, d: str) -> DataFrame:
    """For every edge of every series the steps from the middle of the series' trajectory on until it is seen to decay."""
    found = settle(relations.rolling_relations(panels.panel(spark, d), LAGS, WINDOW, TARGET))  # read three times
    middle = found.groupBy("series_id").agg(F.floor((F.min("step") + F.max("step")) / 2).alias("middle"))
    return lifecycle.detection_lags(found.join(middle, "series_id"), F.col("middle"))


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    found = selection.evidence_gate(_lifecycle(spark, d), LAGS)
    return found.select("series_id", "source", "target", "lag", out("p_value", 6).alias("p_value"), out("fdr_cutoff", 6).alias("fdr_cutoff"), out("noise_floor", 8).alias("noise_floor"), out("effect_size", 6).alias("effect_size"), out("support").alias("support"), "selected", "reason")


def rolling_origin_folds(spark: SparkSession, d: str) -> DataFrame:
    lengths = evaluation.target_rows(panels.panel(spark, d), TARGET).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.rolling_origin_folds(lengths, test_size=2, min_train=15, step=3)


def sliding_folds(spark: SparkSession, d: str) -> DataFrame:
    lengths = evaluation.target_rows(panels.panel(spark, d), TARGET).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.rolling_origin_folds(lengths, test_size=1, min_train=12, step=2, expanding=False, max_folds=8)


def _fold_skills(spark: SparkSession, d: str) -> DataFrame:
    rows = _forecasts(spark, d)
    lengths = rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    folds = evaluation.rolling_origin_folds(lengths, test_size=2, min_train=15, step=3).select("series_id", "fold", F.explode(F.sequence("test_lo", F.col("test_hi") - 1)).alias("idx"))
    errors = folds.join(rows.withColumn("idx", F.col("idx").cast("long")), ["series_id", "idx"])
    per = errors.groupBy("series_id", "fold").agg(stats.mae(F.col("actual"), F.col("seasonal")).alias("m"), stats.mae(F.col("actual"), F.col("persistence")).alias("b"))
    return per.select("series_id", "fold", F.round(evaluation.fold_skill(F.col("m"), F.col("b")), 8).alias("skill")).where("skill is not null")


def fold_skill(spark: SparkSession, d: str) -> DataFrame:
    return _fold_skills(spark, d).select("series_id", "fold", out("skill", 8).alias("skill"))


def bootstrap_skill(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.skill_intervals(_fold_skills(spark, d))
    return found.select("series_id", "folds", *[out(c, 8).alias(c) for c in ("median", "low", "high")])


def sign_flip_null(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.sign_flip_intervals(_fold_skills(spark, d))
    return found.select("series_id", "folds", *[out(c, 8).alias(c) for c in ("low", "high")])


def spearman(spark: SparkSession, d: str) -> DataFrame:
    wide = panels.widen(panels.orders_panel(spark, d), ["volume", "orders", "finished"])
    return evaluation.spearman(wide, "orders", "finished").select("series_id", out("spearman").alias("spearman"), "n")


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    wide = panels.widen(panels.lineitem_panel(spark, d), ["volume", "quantity", "discount", "tax", "lines"])
    return evaluation.calibration_bins(wide, "quantity", "discount").select("series_id", "bin", out("confidence", 8).alias("confidence"), out("error", 8).alias("error"), "n")


def input_support(spark: SparkSession, d: str) -> DataFrame:
    rows = _forecasts(spark, d)
    ends = rows.where("not is_test").groupBy("series_id").agg(F.min("actual").alias("low"), F.max("actual").alias("high"))
    scored = rows.where("is_test").join(ends, "series_id")
    return scored.select("series_id", "t", out(evaluation.input_support(F.col("actual"), F.col("low"), F.col("high")), 8).alias("support"))


def prediction_confidence(spark: SparkSession, d: str) -> DataFrame:
    life = _lifecycle(spark, d)
    score = evaluation.prediction_confidence(F.col("stability"), F.col("uncertainty"), F.least(F.lit(1.0), F.col("points") / 10), F.when(F.col("lag") > 1, F.col("recent_mean")))
    return life.select("series_id", "source", "target", out(score, 8).alias("confidence"))


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    """Settled panels on the scale of 1, on which a dense system's digits mean something."""
    return settle(_unit(panels.panel(spark, d)))


def budget_sweep(spark: SparkSession, d: str) -> DataFrame:
    frame = _scaled(spark, d)
    found = sweep.budget_sweep(frame, TARGET, 2, 3, sweep.train_ends(frame, TARGET), selection.tiers(spark))
    errors = [out(c, 6).alias(c) for c in ("persistence_mae", "persistence_rmse", "model_mae", "model_rmse")]
    return found.select("series_id", "budget", out("threshold").alias("threshold"), "retained", "admitted", "sources", "fit_status", "compute", "test_rows", *errors, *[out(c, 3).alias(c) for c in ("mae_loss_pct", "mae_vs_persistence_pct")])


def _search(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    frame = _scaled(spark, d)
    train, check = sweep.train_ends(frame, TARGET, 2), sweep.train_ends(frame, TARGET, 5)
    return frame, sweep.validation_search(frame, TARGET, [1, 2], [0.1, 0.3], [1, 2], train, check.withColumnRenamed("train_end", "validation_end"))


def validation_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d)[1].select("series_id", "lag_window", "threshold", "cap", "n_sources", "used", "fit_status", out("validation_mae", 6).alias("validation_mae"), out("persistence_mae", 6).alias("persistence_mae"))


def frozen_test(spark: SparkSession, d: str) -> DataFrame:
    frame, grid = _search(spark, d)
    found = sweep.frozen_test(frame, TARGET, sweep.select_cell(grid), sweep.train_ends(frame, TARGET, 5), [1, 2])
    return found.select("series_id", "mode", "lag_window", "threshold", "cap", "fit_status", "test_rows", *[out(c, 6).alias(c) for c in ("persistence_mae", "persistence_rmse", "model_mae", "model_rmse")])


def origin_skill(spark: SparkSession, d: str) -> DataFrame:
    """A predictor from a series' own last value, refitted at every origin."""
    frame = settle(_unit(panels.panel(spark, d).where(F.col("signal") == TARGET)))
    none = frame.select("series_id").distinct().select("series_id", F.lit("own").alias("model"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("scale"))
    origins = evaluation.target_rows(frame, TARGET).where("idx > 12").select("series_id", "t")
    found = power.origin_skills(power.origin_forecasts(frame, TARGET, none, 1, origins), frame, TARGET)
    return found.select("series_id", "fold", "t", out("skill", 6).alias("skill"))


def protocol_controls(spark: SparkSession, d: str) -> DataFrame:
    """The predictor of every series' target from its first other signal at every origin after a year, with the controls of its protocol."""
    frame = settle(_unit(panels.panel(spark, d)))
    other = frame.where(F.col("signal") != TARGET).groupBy("series_id").agg(F.min("signal").alias("source"))
    sources = other.select("series_id", F.lit("ols").alias("model"), "source", F.lit(1).alias("rank"), F.lit(1.0).alias("scale"))
    origins = evaluation.target_rows(frame, TARGET).where("idx > 12").select("series_id", "t")
    found = power.controls(frame, TARGET, sources, 2, origins)
    return found.select("series_id", "control", "fold", "t", out("skill", 6).alias("skill"))


QUERIES: tuple[Query, ...] = (
    panel_axis_audit, brand_complete_panel, brand_relations, missing_steps, series_digest, lagged_correlations, best_lag_ranking, diff_relations, log_diff_relations,
    acf_diagnostics, naive_forecasts, baseline_errors, baseline_summary, mase, directional_accuracy, worst_decile, change_space, budget_tiers, resource_profile,
    trust_gates, gated_mixture, fixed_threshold, precision_recall, noise_floor, bh_cutoff, pooled_cutoff, lag_features, gram_matrix, ar1_ols, rolling_relations,
    yearly_relations, yearly_rolling_relations, growing_window_relations, rolling_diff_relations, rolling_mixed_relations, expanding_relations, trajectory_ranks, relation_lifecycle, relation_detection, evidence_gate, rolling_origin_folds, sliding_folds,
    fold_skill, bootstrap_skill, sign_flip_null, spearman, calibration_bins, input_support, prediction_confidence, budget_sweep, validation_search, frozen_test,
    origin_skill, protocol_controls,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
