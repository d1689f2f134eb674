"""Predictors with source mixtures: weighted top sources, trust gates, adaptive budgets, and static or rolling weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import models, relations, selection
from .settle import settle

MIXTURE = "_mixture"


def mixture(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """A signal of weighted sums: weights has (series_id, model, source, scale)."""
    rows = panel.join(weights.select("series_id", "model", F.col("source").alias("signal"), "scale"), ["series_id", "signal"])
    return rows.groupBy("series_id", "model", "t").agg(F.sum(F.col("scale") * F.col("value")).alias("value"))


def mixture_features(panel: DataFrame, target: str, weights: DataFrame, lags: int) -> DataFrame:
    """Features [1, then for each lag the target's and the mixture's value] of every model; as ``models.features``."""
    mixed = mixture(panel, weights)
    names = mixed.select("series_id", "model").distinct()
    own = panel.where(F.col("signal") == target).join(names, "series_id").select("series_id", "model", "t", "value", F.lit(0).alias("place"))
    both = own.unionByName(mixed.withColumn("place", F.lit(1)))
    past = both.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("t", F.col("t") + F.col("lag"))
    rows = past.groupBy("series_id", "model", "t").agg(F.array_sort(F.collect_list(F.struct("lag", "place", "value"))).alias("f")).where(F.size("f") == 2 * lags)
    label = panel.where(F.col("signal") == target).select("series_id", "t", F.col("value").alias("y"))
    return rows.join(label, ["series_id", "t"]).select("series_id", "model", "t", "y", F.concat(F.array(F.lit(1.0)), F.transform("f", lambda f: f["value"])).alias("x"))


def step_features(panel: DataFrame, target: str, weights: DataFrame, lags: int) -> DataFrame:
    """As ``mixture_features`` where weights (series_id, model, step, source, scale) hold for all lags of the label at ``step``."""
    past = panel.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).select("series_id", "signal", (F.col("t") + F.col("lag")).alias("t"), "lag", "value")
    mixed = past.join(weights.select("series_id", "model", F.col("step").alias("t"), F.col("source").alias("signal"), "scale"), ["series_id", "t", "signal"])
    mixed = mixed.groupBy("series_id", "model", "t", "lag").agg(F.sum(F.col("scale") * F.col("value")).alias("value")).withColumn("place", F.lit(1))
    own = past.where(F.col("signal") == target).join(mixed.select("series_id", "model", "t").distinct(), ["series_id", "t"]).select("series_id", "model", "t", "lag", "value", F.lit(0).alias("place"))
    rows = own.unionByName(mixed).groupBy("series_id", "model", "t").agg(F.array_sort(F.collect_list(F.struct("lag", "place", "value"))).alias("f")).where(F.size("f") == 2 * lags)
    label = panel.where(F.col("signal") == target).select("series_id", "t", F.col("value").alias("y"))
    return rows.join(label, ["series_id", "t"]).select("series_id", "model", "t", "y", F.concat(F.array(F.lit(1.0)), F.transform("f", lambda f: f["value"])).alias("x"))


def trust_weights(found: DataFrame, target: str) -> DataFrame:
    gates = selection.trust_gates(found.where(F.col("target") == target))
    return gates.select("series_id", F.lit("trust_gated").alias("model"), "source", (F.col("direction") * F.col("admission")).alias("scale"))


def budget_weights(found: DataFrame, target: str, budgets: DataFrame) -> DataFrame:
    kept = selection.retain(found.where(F.col("target") == target), budgets)
    return kept.select("series_id", F.format_string("budget_%.2f", "budget").alias("model"), "source", F.col("weight").alias("scale"))


def rolling_weights(panel: DataFrame, target: str, lags: int, window: int, sources: DataFrame) -> DataFrame:
    """Weights at every step from the window before it, for the chosen (series_id, source)."""
    timed = relations.rolling_relations(panel, lags, window, target)
    return timed.join(sources.select("series_id", "source").distinct(), ["series_id", "source"], "left_semi").select("series_id", F.lit("dynamic").alias("model"), "step", "source", F.col("weight").alias("scale"))


def forecasts(rows: DataFrame, train: tuple[int, int], test: tuple[int, int], lags: int) -> DataFrame:
    """(series_id, model, t, y, predicted) on the label steps of ``test`` of models fitted on those of ``train``."""
    fitted = models.fit(rows.where(F.col("t").between(*train)), None, lags)
    return models.predict(rows.where(F.col("t").between(*test)), fitted)


def mixture_feature_names(target: str, lags: int, mixture: str | None = "mixture") -> list[str]:
    """Names of ``mixture_features``; without a mixture those of the target alone."""
    return models.feature_names(target, [mixture] if mixture else [], lags)


#: Modes of a predictor with fixed weights, and what makes its weights.
MODES = ("ols", "trust_gated")


def fit_and_predict(panel: DataFrame, target: str, lags: int, mode: str, train: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """``forecasts`` of one mode: ``ols`` on all sources, or ``trust_gated`` on their admitted mixture."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    found = relations.relations(panel.where(F.col("t") <= train[1]), lags, target)
    if mode == "trust_gated":
        return forecasts(mixture_features(panel, target, trust_weights(found, target), lags), train, test, lags)
    every = relations.ranked(found).select("series_id", F.lit(mode).alias("model"), "source", "rank", F.lit(1.0).alias("scale"))
    return forecasts(models.features(panel, target, every, lags), train, test, lags)


def evaluate(rows: DataFrame, train: tuple[int, int], test: tuple[int, int], lags: int, sources: int = 1) -> DataFrame:
    """Fit on label steps of ``train`` and score those of ``test`` (both ends included): (series_id, model, mae, rmse, n)."""
    scored = forecasts(rows, train, test, lags)
    return scored.groupBy("series_id", "model").agg(stats.mae(F.col("y"), F.col("predicted")).alias("mae"), stats.rmse(F.col("y"), F.col("predicted")).alias("rmse"), F.count("predicted").alias("n"))


def compare(panel: DataFrame, target: str, lags: int, train: tuple[int, int], test: tuple[int, int], budgets: DataFrame, top: int = 2) -> DataFrame:
    """All predictors with fixed weights on the same rows: every signal, the top sources, trust gates, and each budget."""
    past = panel.where(F.col("t") <= train[1])
    found = settle(relations.relations(past, lags, target))
    every = relations.ranked(found).select("series_id", F.lit("all_signals").alias("model"), "source", "rank", F.lit(1.0).alias("scale"))
    plain = [evaluate(models.features(panel, target, s, lags), train, test, lags) for s in (every, models.top_sources(found, target, top, "top_sources"))]
    mixed = trust_weights(found, target).unionByName(budget_weights(found, target, budgets))
    return plain[0].unionByName(plain[1]).unionByName(evaluate(mixture_features(panel, target, mixed, lags), train, test, lags))


def compare_drift(panel: DataFrame, target: str, lags: int, window: int, train: tuple[int, int], test: tuple[int, int], top: int = 2) -> DataFrame:
    """Static weights of the training rows against weights that roll with the label; coefficients are fixed in training."""
    found = relations.relations(panel.where(F.col("t") <= train[1]), lags, target)
    chosen = settle(models.top_sources(found, target, top, "static"))
    static = evaluate(mixture_features(panel, target, chosen, lags), train, test, lags)
    rolling = evaluate(step_features(panel, target, rolling_weights(panel, target, lags, window, chosen), lags), train, test, lags)
    return static.unionByName(rolling)
