"""Stability, uncertainty and lifecycle of relations along their trajectories.

A trajectory is a table of relations with a step. Everything is an aggregation over the
last points of each edge, found by one window over the edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .relations import EDGE


@dataclass(frozen=True)
class LifecycleRules:
    """Fixed values of the lifecycle's decision."""

    min_points: int = 6
    recent_points: int = 5
    dead_points: int = 5
    score_floor: float = 0.20
    stable_floor: float = 0.45
    rise: float = 0.08
    rise_slope: float = 0.01
    fall_slope: float = -0.025
    fall_share: float = 0.65


def _summary(trajectory: DataFrame, rules: LifecycleRules, keys: list[str]) -> DataFrame:
    back = Window.partitionBy(*keys).orderBy(F.col("step").desc())
    whole = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = trajectory.withColumns({"_back": F.row_number().over(back), "_last_weight": F.last("weight").over(whole), "_last_lag": F.last("lag").over(whole)})
    recent, prior = F.col("_back") <= rules.recent_points, F.col("_back") > rules.recent_points
    tail = F.col("_back") <= max(2 * rules.recent_points, 3)
    same_sign = (F.signum("weight") == F.signum("_last_weight")) & (F.signum("_last_weight") != 0)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        F.max_by(F.struct("lag", "weight", "score", "sample_count", "step"), "step").alias("latest"),
        F.avg(F.when(recent, F.col("score"))).alias("recent_mean"),
        F.avg(F.when(prior, F.col("score"))).alias("prior_mean"),
        F.avg(F.when(recent, same_sign.cast("double"))).alias("sign_consistency"),
        F.avg(F.when(recent, (F.col("lag") == F.col("_last_lag")).cast("double"))).alias("lag_consistency"),
        F.stddev_pop(F.when(recent, F.col("weight"))).alias("spread"),
        F.coalesce(F.regr_slope(F.when(tail, F.col("score")), F.when(tail, -F.col("_back").cast("double"))), F.lit(0.0)).alias("slope"),
        F.bool_and(F.when(F.col("_back") <= rules.dead_points, F.col("score") < rules.score_floor)).alias("all_low"),
    )


def _rated(s: DataFrame, rules: LifecycleRules) -> DataFrame:
    """Stability, uncertainty and state from a trajectory's summary."""
    s = s.withColumn("prior_mean", F.coalesce("prior_mean", "recent_mean"))
    enough = F.col("points") >= rules.min_points
    stability = F.when(enough, stats.clamp01(F.col("recent_mean") * F.col("sign_consistency") * F.col("lag_consistency")))
    s = s.withColumns({"stability": stability, "uncertainty": F.when(enough, F.col("spread"))})
    endorsed = (F.col("stability") >= rules.stable_floor) & (F.col("recent_mean") >= rules.score_floor)
    rising = (F.col("recent_mean") > F.col("prior_mean") + rules.rise) & (F.col("slope") > rules.rise_slope)
    fallen = (F.col("recent_mean") < F.col("prior_mean") * rules.fall_share) | ((F.col("slope") < rules.fall_slope) & (F.col("recent_mean") < F.col("prior_mean") - rules.rise))
    state = (
        F.when(~enough, "birth")
        .when((F.col("points") >= rules.dead_points) & F.col("all_low"), "dead")
        .when((F.col("prior_mean") >= rules.score_floor) & fallen, "decaying")
        .when(endorsed & rising, "strengthening")
        .when(endorsed, "stable")
        .otherwise("birth")
    )
    return s.withColumn("state", state)


def lifecycle(trajectory: DataFrame, rules: LifecycleRules = LifecycleRules(), keys: list[str] = EDGE) -> DataFrame:
    """The latest relation of each edge with its stability, uncertainty and state.

    Below ``min_points`` points stability and uncertainty are NULL and the state is birth.
    """
    return _rated(_summary(trajectory, rules, keys), rules).select(*keys, "latest.*", "points", "stability", "uncertainty", "recent_mean", "prior_mean", "slope", "state")


def running_lifecycle(trajectory: DataFrame, rules: LifecycleRules = LifecycleRules(), keys: list[str] = EDGE) -> DataFrame:
    """``lifecycle`` of every prefix of each trajectory, as its last step's row: frames over one sort, linear in the steps."""
    order = Window.partitionBy(*keys).orderBy("step")
    last = lambda n: order.rowsBetween(1 - n, 0)
    recent, prior, tail = last(rules.recent_points), order.rowsBetween(Window.unboundedPreceding, -rules.recent_points), last(max(2 * rules.recent_points, 3))
    rows = trajectory.withColumn("_i", F.row_number().over(order).cast("double"))
    rows = rows.withColumns({
        "points": F.count(F.lit(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "recent_mean": F.avg("score").over(recent),
        "prior_mean": F.avg("score").over(prior),
        "_near": F.collect_list(F.struct("weight", "lag")).over(recent),
        "spread": F.stddev_pop("weight").over(recent),
        "slope": F.coalesce(F.regr_slope("score", "_i").over(tail), F.lit(0.0)),
        "all_low": F.max("score").over(last(rules.dead_points)) < rules.score_floor,
    })
    share = lambda ok: F.size(F.filter("_near", ok)) / F.size("_near")
    same_sign = share(lambda p: (F.signum(p["weight"]) == F.signum(F.col("weight"))) & (F.signum(F.col("weight")) != 0))
    rows = rows.withColumns({"sign_consistency": same_sign, "lag_consistency": share(lambda p: p["lag"] == F.col("lag"))}).drop("_near", "_i")
    return _rated(rows, rules)


def detection_lags(trajectory: DataFrame, death_step: int | Column, rules: LifecycleRules = LifecycleRules(), keys: list[str] = EDGE) -> DataFrame:
    """Steps from a relation's end until its state first is decaying, on prefixes of the trajectory; NULL if it never is.

    Edges without a step from ``death_step`` on have no row.
    """
    death = F.lit(death_step) if isinstance(death_step, int) else death_step
    states = running_lifecycle(trajectory.withColumn("_since", F.col("step") - death), rules, keys).where("_since >= 0")
    return states.groupBy(*keys).agg(F.min(F.when(F.col("state") == "decaying", F.col("_since"))).alias("detection_lag"))
