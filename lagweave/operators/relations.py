"""Directed relations between signals: lagged correlations, best lags, ranks and trajectories.

A relation from source to target at lag L correlates the source at t - L with the target at
t. Moments of all pairs and lags come from blocks of steps (``blocks``), which are summed for
whole series and differenced for windows; only expanding windows join the lagged pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import blocks, transforms

EDGE = blocks.EDGE


def lag_pairs(panel: DataFrame, max_lag: int, target: str | None = None) -> DataFrame:
    """(series_id, source, target, lag, t, x, y): the source's value ``lag`` steps before t and the target's at t.

    Pairs with a NULL are left out. With a target, only edges into it are built.
    """
    if max_lag < 1:
        raise ValueError("max_lag must be positive")
    source = panel.where("value is not null").select("series_id", F.col("signal").alias("source"), F.col("value").alias("x"), F.col("t").alias("t0"))
    source = source.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).withColumn("t", F.col("t0") + F.col("lag")).drop("t0")
    goal = panel.where("value is not null").select("series_id", "t", F.col("signal").alias("target"), F.col("value").alias("y"))
    if target is not None:
        goal = goal.where(F.col("target") == target)
    return source.join(goal, ["series_id", "t"]).where("source <> target").select(*EDGE, "lag", "t", "x", "y")


def lagged_correlations(panel: DataFrame, max_lag: int, target: str | None = None) -> DataFrame:
    """The correlation and the number of pairs of every edge and lag; 0 where either side is constant. With a target, only edges into it."""
    total = lambda c: F.sum(c).alias(c)
    ends = [f(c).alias(c) for side in "xy" for f, c in ((F.min, f"{side}_least"), (F.max, f"{side}_most"))]
    rows = blocks.lagged_moments(panel, max_lag, target).groupBy(*EDGE, "lag").agg(*[total(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")], *ends)
    spread = lambda product, a, b: F.col(product) - F.col(a) * F.col(b) / F.col("n")
    constant = (F.col("x_least") == F.col("x_most")) | (F.col("y_least") == F.col("y_most"))
    weight = F.when(constant, 0.0).otherwise(stats.correlation(spread("sxy", "sx", "sy"), spread("sxx", "sx", "sx"), spread("syy", "sy", "sy")))
    return rows.select(*EDGE, "lag", weight.alias("weight"), F.col("n").alias("sample_count"))


def order_key(score: Column | str) -> Column:
    return F.round(score, stats.TIE_DIGITS)


def best_lags(correlations: DataFrame, keys: list[str] = EDGE) -> DataFrame:
    """Each edge's lag of the largest absolute correlation; of equal ones the smallest lag."""
    rank = F.struct((-order_key(F.abs("weight"))).alias("s"), "lag")
    best = correlations.groupBy(*keys).agg(F.min_by(F.struct("lag", "weight", "sample_count"), rank).alias("b"))
    return best.select(*keys, "b.lag", "b.weight", F.abs("b.weight").alias("score"), "b.sample_count")


def relations(panel: DataFrame, max_lag: int, target: str | None = None) -> DataFrame:
    """The best relation of every edge."""
    return best_lags(lagged_correlations(panel, max_lag, target))


def declared_relations(levels: DataFrame, declared: dict[str, str], max_lag: int, target: str | None = None) -> DataFrame:
    """The best relations between signals under their declared transforms; raises where levels persist though they are declared ``none``."""
    return relations(transforms.guarded(levels, declared), max_lag, target)


def ranked(relations: DataFrame, keys: tuple[str, ...] = ("series_id", "target")) -> DataFrame:
    """Add each source's rank for its target: by falling score, then source, then lag."""
    order = Window.partitionBy(*keys).orderBy(order_key("score").desc(), "source", "lag")
    return relations.withColumn("rank", F.row_number().over(order))


def _windows(panel: DataFrame, max_lag: int, window: int, target: str | None, differenced: bool | Iterable[str], shortened: bool, best: bool) -> DataFrame:
    if window <= max_lag:
        raise ValueError("the window must be longer than the lag")
    changed = differenced if isinstance(differenced, bool) else frozenset(differenced)
    return blocks.window_correlations(panel, max_lag, window, target, changed, shortened, _best_lag if best else None)


def _best_lag(scores: np.ndarray) -> np.ndarray:
    """The index of the first lag of the largest score."""
    return np.round(np.where(np.isnan(scores), -1.0, scores), stats.TIE_DIGITS).argmax(0)


def rolling_correlations(panel: DataFrame, max_lag: int, window: int, target: str | None = None, differenced: bool | Iterable[str] = False, shortened: bool = False) -> DataFrame:
    """Correlations over the ``window`` steps before each step; both ends of a pair lie inside.

    Steps are those of the series and the one past its end; any window longer than the lags
    will do. Steps whose window isn't full are left out, or with ``shortened`` begin with the
    series once it has more steps than lags. differenced: whether all values are differences,
    or which signals are; a difference's first value in a window is unknown, so pairs of such a
    source begin a step later. Windows without a pair have no row.
    """
    return _windows(panel, max_lag, window, target, differenced, shortened, best=False)


def rolling_relations(panel: DataFrame, max_lag: int, window: int, target: str | None = None, differenced: bool | Iterable[str] = False, shortened: bool = False) -> DataFrame:
    """The best relation of every edge in the window before each step, with the window's bounds; lags are compared inside the blocks."""
    best = _windows(panel, max_lag, window, target, differenced, shortened, best=True)
    start = F.col("step") - window
    if shortened:
        first = panel.where("value is not null").groupBy("series_id").agg(F.min("t").alias("_first"))
        best, start = best.join(first, "series_id"), F.greatest(start, F.col("_first"))
    return best.select(*EDGE, "step", "lag", "weight", F.abs("weight").alias("score"), "sample_count", start.alias("window_start"), F.col("step").alias("window_end"))


def expanding_relations(panel: DataFrame, max_lag: int, target: str, least: int) -> DataFrame:
    """The best relation of every edge over all rows before each step that has at least ``least`` of them."""
    pairs = lag_pairs(panel, max_lag, target)
    frame = Window.partitionBy(*EDGE, "lag").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    first = panel.where("value is not null").groupBy("series_id").agg(F.min("t").alias("first_t"))
    rows = pairs.select(*EDGE, "lag", F.col("t").alias("step"), stats.pearson_over("x", "y", frame).alias("weight"), F.count("x").over(frame).alias("sample_count"))
    rows = rows.join(first, "series_id").where(F.col("step") - F.col("first_t") >= least).drop("first_t")
    return best_lags(rows, [*EDGE, "step"])
