"""How far an evaluation can be trusted: a predictor refitted at every origin, with controls that must fail or pass.

* identity: the naive forecast against itself; its skill is 0 in every fold.
* scrambled: the predictor on sources whose steps are shuffled; skill there comes from the protocol.
* degraded: the naive forecast with noise of the size of a usual move; its skill is below 0.

The sign-flip null of ``evaluation.sign_flip_intervals`` takes the predictor's own skills.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation, models

#: The seeds of the two controls.
SCRAMBLE_SEED, NOISE_SEED = 424242, 987654321
CONTROLS = ("model", "identity", "scrambled", "degraded")


def scramble(panel: DataFrame, sources: list[str], seed: int = SCRAMBLE_SEED) -> DataFrame:
    """The panel with the values of all ``sources`` moved to other steps, by one permutation of the steps of each series."""

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        steps = sorted(group["t"].tolist())
        moved, state = list(steps), seed
        for i in range(len(moved) - 1, 0, -1):
            state = (evaluation.MULTIPLIER * state + evaluation.INCREMENT) % evaluation.MODULUS
            moved[i], moved[state % (i + 1)] = moved[state % (i + 1)], moved[i]
        return pd.DataFrame({"series_id": key[0], "t": moved, "_to": steps})

    places = panel.groupBy("series_id", "t").agg(F.count("value").alias("n")).groupBy("series_id").applyInPandas(one, f"series_id {dict(panel.dtypes)['series_id']}, t long, _to long")
    own = panel.where(F.col("signal").isin(sources)).join(places, ["series_id", "t"])
    return panel.where(~F.col("signal").isin(sources)).unionByName(own.drop("t").withColumnRenamed("_to", "t").select(*panel.columns))


def origin_forecasts(panel: DataFrame, target: str, sources: DataFrame, lags: int, origins: DataFrame, test_size: int = 1, with_target: bool = True) -> DataFrame:
    """(series_id, model, origin, t, actual, predicted) of models refitted at each origin on all rows before it.

    sources: as ``models.features`` takes them. origins: (series_id, t) of first test rows.
    predicted is NULL where no model can be solved.
    """
    rows = models.features(panel, target, sources, lags, with_target)
    solved = models.fit_sums(models.running_gram(rows, origins), None, lags, with_target)
    solved = solved.where("size(dropped) = 0").select("series_id", F.substring_index("model", "@", -1).cast("long").alias("origin"), F.regexp_replace("model", "@[^@]*$", "").alias("model"), "coefficients")
    tests = origins.select("series_id", F.col("t").alias("origin"), F.explode(F.sequence(F.col("t"), F.col("t") + (test_size - 1))).alias("t"))
    dot = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    found = rows.join(tests, ["series_id", "t"]).join(solved, ["series_id", "model", "origin"], "left")
    return found.select("series_id", "model", "origin", "t", F.col("y").alias("actual"), dot.alias("predicted"))


def origin_skills(forecasts: DataFrame, panel: DataFrame, target: str) -> DataFrame:
    """(series_id, model, fold, t, skill) against the naive forecast, for origins with a model and a naive error above 0; t is the origin."""
    naive = evaluation.naive_forecasts(evaluation.target_rows(panel, target)).select("series_id", "t", "persistence")
    rows = forecasts.where("predicted is not null").join(naive, ["series_id", "t"])
    error = lambda c: F.avg(F.abs(F.col("actual") - F.col(c)))
    folds = rows.groupBy("series_id", "model", "origin").agg(evaluation.fold_skill(error("predicted"), error("persistence")).alias("skill")).where("skill is not null")
    order = Window.partitionBy("series_id", "model").orderBy("origin")
    return folds.select("series_id", "model", (F.row_number().over(order) - 1).alias("fold"), F.col("origin").alias("t"), "skill")


def era_skills(panel: DataFrame, target: str, sources: DataFrame, lags: int, eras: DataFrame) -> DataFrame:
    """(series_id, model, era, fold, t, skill) of frozen sources, refitted at every step of each era on all rows before it.

    eras: (series_id, era, first, last), both ends included; an origin without a model, or
    with a naive error of 0, is skipped. Folds count within an era.
    """
    origins = eras.select("series_id", F.explode(F.sequence("first", "last")).alias("t")).distinct()
    found = origin_skills(origin_forecasts(panel, target, sources, lags, origins), panel, target).drop("fold")
    rows = found.join(eras, "series_id").where(F.col("t").between(F.col("first"), F.col("last")))
    order = Window.partitionBy("series_id", "model", "era").orderBy("t")
    return rows.select("series_id", "model", "era", (F.row_number().over(order) - 1).alias("fold"), "t", "skill")


def era_intervals(skills: DataFrame, **options) -> DataFrame:
    """(series_id, model, era, folds, median, low, high): ``evaluation.skill_intervals`` of each era."""
    key = F.concat_ws("\x1f", "series_id", "model", "era")
    found = evaluation.skill_intervals(skills.select(key.alias("series_id"), "fold", "skill"), **options)
    part = F.split("series_id", "\x1f")
    return found.select(part[0].alias("series_id"), part[1].alias("model"), part[2].alias("era"), "folds", "median", "low", "high")


def controls(panel: DataFrame, target: str, sources: DataFrame, lags: int, origins: DataFrame, test_size: int = 1, with_target: bool = False) -> DataFrame:
    """(series_id, control, fold, t, skill) of one model a series and its three controls, on folds that all of them have."""
    names = [r[0] for r in sources.where("source is not null").select("source").distinct().collect()]  # signals of a panel
    keys = ["series_id", "origin", "t"]
    real = origin_forecasts(panel, target, sources, lags, origins, test_size, with_target).select(*keys, "actual", F.col("predicted").alias("model"))
    mixed = origin_forecasts(scramble(panel, names), target, sources, lags, origins, test_size, with_target).select(*keys, F.col("predicted").alias("scrambled"))
    rows = evaluation.naive_forecasts(evaluation.target_rows(panel, target))
    along = Window.partitionBy("series_id").orderBy("t")
    # moves between training labels, which begin after the lags
    move = F.when(F.col("idx") > lags, F.abs(F.col("actual") - F.col("persistence")))
    rows = rows.withColumn("usual", F.avg(move).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    usual = rows.select("series_id", F.col("t").alias("origin"), "usual")
    found = real.where("model is not null").join(rows.select("series_id", "t", F.col("persistence").alias("identity")), ["series_id", "t"]).join(usual, ["series_id", "origin"])
    draws = found.withColumn("_draw", F.row_number().over(Window.partitionBy("series_id").orderBy("origin", "t")) - 1)
    most = draws.agg(F.max("_draw")).first()[0] or 0
    noise = evaluation.generator_state(F.col("_draw").cast("long"), most + 1, NOISE_SEED) / evaluation.MODULUS - 0.5
    draws = draws.withColumn("degraded", F.col("identity") + noise * 2 * F.col("usual")).join(mixed.where("scrambled is not null"), keys)
    error = {c: F.avg(F.abs(F.col("actual") - F.col(c))) for c in CONTROLS}
    folds = draws.groupBy("series_id", "origin").agg(*[evaluation.fold_skill(error[c], error["identity"]).alias(c) for c in CONTROLS]).where("identity is not null")
    order = Window.partitionBy("series_id").orderBy("origin")
    folds = folds.withColumn("fold", F.row_number().over(order) - 1).withColumnRenamed("origin", "t")
    return folds.unpivot(["series_id", "fold", "t"], list(CONTROLS), "control", "skill")


def block_skill(panel: DataFrame, target: str, sources: DataFrame, lags: int, first: int, last: int, with_target: bool = True) -> DataFrame:
    """(series_id, model, skill, n) of one fit before ``first`` over the whole window up to ``last``."""
    origins = panel.select("series_id", F.lit(first).cast("long").alias("t")).distinct()
    rows = origin_forecasts(panel, target, sources, lags, origins, last - first + 1, with_target)
    naive = evaluation.naive_forecasts(evaluation.target_rows(panel, target)).select("series_id", "t", "persistence")
    error = lambda c: F.avg(F.abs(F.col("actual") - F.col(c)))
    return rows.where("predicted is not null").join(naive, ["series_id", "t"]).groupBy("series_id", "model").agg(evaluation.fold_skill(error("predicted"), error("persistence")).alias("skill"), F.count(F.lit(1)).alias("n"))
