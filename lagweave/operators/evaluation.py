"""Baselines, error measures, rolling-origin folds, and seeded resampling intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import stats
from .positions import cumulative

#: Fixed values of the seeded intervals.
SEED, RESAMPLES, CONFIDENCE = 20260818, 2000, 0.90
MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2**31


def by_series() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("t")


def target_rows(panel: DataFrame, target: str) -> DataFrame:
    """(series_id, t, idx, actual) of one signal; idx counts from 0."""
    rows = panel.where(F.col("signal") == target).select("series_id", "t", F.col("value").alias("actual"))
    return rows.withColumn("idx", F.row_number().over(by_series()) - 1)


def naive_forecasts(rows: DataFrame, season: int = 12) -> DataFrame:
    """Add the previous value, and the value a season ago or else the previous one."""
    previous = F.lag("actual").over(by_series())
    return rows.withColumns({"persistence": previous, "seasonal": F.coalesce(F.lag("actual", season).over(by_series()), previous)})


def hold_out(rows: DataFrame, share: int = 5) -> DataFrame:
    """Mark the last fifth (or other ``share``) of each series as test rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return rows.withColumn("is_test", F.col("idx") >= n - F.floor(n / share))


def paired(forecasts: DataFrame, predicted: str) -> DataFrame:
    """The rows, of which each must have both an actual and a forecast; one without the other is an error when the rows are read, and so is a NaN."""
    a, p = F.col("actual"), F.col(predicted)
    whole = a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p)
    checked = F.when(whole, p).otherwise(F.raise_error(F.concat(F.lit(f"actual and {predicted} must be paired: step "), F.coalesce(F.col("t").cast("string"), F.lit("NULL")))).cast("double"))
    return forecasts.withColumn(predicted, checked)


def errors(forecasts: DataFrame, predicted: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """MAE, RMSE and the number of rows with a forecast. Rows without one don't count; ``paired`` makes them an error."""
    a, p = F.col("actual"), F.col(predicted)
    return forecasts.where(p.isNotNull()).groupBy(*keys).agg(stats.mae(a, p).alias("mae"), stats.rmse(a, p).alias("rmse"), F.count(F.lit(1)).alias("n"))


def mase(forecasts: DataFrame, predicted: str, train: DataFrame, season: int = 1) -> DataFrame:
    """MAE over the mean seasonal change of the training rows; NULL where that is 0 or unknown."""
    change = F.abs(F.col("actual") - F.lag("actual", season).over(by_series()))
    scale = train.withColumn("_c", change).groupBy("series_id").agg(F.avg("_c").alias("scale"))
    return errors(forecasts, predicted).join(scale, "series_id").select("series_id", "mae", "scale", F.try_divide("mae", F.nullif("scale", F.lit(0.0))).alias("mase"))


def directional_accuracy(forecasts: DataFrame, predicted: str, previous: str = "persistence") -> DataFrame:
    """Share of rows with a forecast change, and among these the share of right directions (NaN if there are none)."""
    rows = forecasts.where(F.col(predicted).isNotNull() & F.col(previous).isNotNull())
    move, real = F.signum(F.col(predicted) - F.col(previous)), F.signum(F.col("actual") - F.col(previous))
    decided, hits = F.count_if(move != 0), F.count_if((move != 0) & (real != 0) & (move == real))
    return rows.groupBy("series_id").agg((decided / F.count(F.lit(1))).alias("decided"), F.coalesce(F.try_divide(hits, decided), F.lit(float("nan"))).alias("accuracy"))


def worst_decile(forecasts: DataFrame, predicted: str) -> DataFrame:
    """Mean of the largest tenth of absolute errors, one at least."""
    rows = forecasts.where(F.col(predicted).isNotNull()).withColumn("_e", F.abs(F.col("actual") - F.col(predicted)))
    # equal errors are one row with a count, of which the last one may be in the tenth in part
    counts = rows.groupBy("series_id", "_e").agg(F.count(F.lit(1)).alias("_n"))
    placed = cumulative(counts, ("series_id",), [F.col("_e").desc()], "_n")
    room = F.greatest(F.lit(1), F.expr("_whole div 10")) - F.col("_before")
    taken = placed.withColumn("_k", F.least(F.col("_n"), room)).where("_k > 0")
    return taken.groupBy("series_id").agg((F.sum(F.col("_e") * F.col("_k")) / F.sum("_k")).alias("worst_decile"))


def change_space(forecasts: DataFrame, predicted: str, previous: str = "persistence") -> DataFrame:
    """Errors on the scale of the changes: mean move, MAE, and their ratio (NaN if nothing moves)."""
    rows = forecasts.where(F.col(predicted).isNotNull() & F.col(previous).isNotNull())
    move = F.avg(F.abs(F.col("actual") - F.col(previous)))
    error = F.avg(F.abs((F.col("actual") - F.col(previous)) - (F.col(predicted) - F.col(previous))))
    found = rows.groupBy("series_id").agg(move.alias("mean_absolute_change"), error.alias("change_mae"))
    return found.withColumn("error_share_of_move", F.coalesce(F.try_divide("change_mae", F.nullif("mean_absolute_change", F.lit(0.0))), F.lit(float("nan"))))


def fold_skill(model: Column, baseline: Column) -> Column:
    """How much of the baseline's error is saved; NULL where that isn't positive."""
    return F.when(baseline > 0, (baseline - model) / baseline)


def rolling_origin_folds(lengths: DataFrame, test_size: int, min_train: int, step: int = 1, expanding: bool = True, max_folds: int | None = None) -> DataFrame:
    """(series_id, fold, train_lo, train_hi, test_lo, test_hi) over positions of each series; upper ends are exclusive.

    lengths: (series_id, n). Series too short for a fold have none.
    """
    last = F.col("n") - test_size
    rows = lengths.where(last >= min_train).select("series_id", F.posexplode(F.sequence(F.lit(min_train).cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("fold", "origin"))
    if max_folds is not None:
        rows = rows.where(F.col("fold") < max_folds)
    low = F.lit(0).cast("long") if expanding else F.col("origin") - min_train
    return rows.select("series_id", "fold", low.alias("train_lo"), F.col("origin").alias("train_hi"), F.col("origin").alias("test_lo"), (F.col("origin") + test_size).alias("test_hi"))


def leaking_folds(folds: DataFrame) -> DataFrame:
    """Folds whose training rows reach into or beyond their test rows."""
    return folds.where("train_hi > test_lo or train_lo >= train_hi or test_lo >= test_hi")


def generator_state(draw: Column, count: int, seed: int = SEED) -> Column:
    """The state of the linear congruential generator after ``draw`` + 1 steps, for draws below ``count``.

    k steps are an affine map of the seed; the maps of the bits of k are applied in turn, so
    that any state is computed on its own.
    """
    a, c, state, k = MULTIPLIER, INCREMENT, F.lit(seed).cast("long"), draw + 1
    for i in range(max(1, count.bit_length())):
        bit = F.shiftright(k, i).bitwiseAND(F.lit(1))
        state = (state * (1 + bit * (a - 1)) + bit * c) % MODULUS  # state occurs once: no branch doubles the expression
        a, c = a * a % MODULUS, (a * c + c) % MODULUS
    return state


def _drawn(sizes: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(series_id, folds, resample, place, state): a draw for each fold of each resample."""
    longest = sizes.agg(F.max("folds")).first()[0] or 0
    rows = sizes.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("folds") - 1)))
    return rows.withColumn("state", generator_state(F.col("resample") * F.col("folds") + F.col("place"), longest * resamples, seed))


def _bounds(samples: DataFrame, resamples: int, confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    low, high = min(resamples - 1, int(tail * resamples)), min(resamples - 1, int((1 - tail) * resamples))
    return samples.groupBy("series_id").agg(F.sort_array(F.collect_list("v")).alias("v")).select("series_id", F.element_at("v", low + 1).alias("low"), F.element_at("v", high + 1).alias("high"))


def _numbered(skills: DataFrame) -> DataFrame:
    order = Window.partitionBy("series_id").orderBy("fold")
    return skills.select("series_id", "skill", F.row_number().over(order) - 1, F.count(F.lit(1)).over(Window.partitionBy("series_id"))).toDF("series_id", "skill", "i", "folds")


def skill_intervals(skills: DataFrame, confidence: float = CONFIDENCE, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(series_id, folds, median, low, high): a seeded bootstrap of the median of (series_id, fold, skill)."""
    rows = _numbered(skills)
    sizes = rows.groupBy("series_id").agg(F.first("folds").alias("folds"), F.median("skill").alias("median"))
    picks = _drawn(sizes.select("series_id", "folds"), resamples, seed).select("series_id", "resample", (F.col("state") % F.col("folds")).alias("i"))
    medians = picks.join(rows.select("series_id", "i", "skill"), ["series_id", "i"]).groupBy("series_id", "resample").agg(F.median("skill").alias("v"))
    return sizes.join(_bounds(medians, resamples, confidence), "series_id")


def sign_flip_intervals(skills: DataFrame, confidence: float = CONFIDENCE, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(series_id, folds, low, high): where the mean skill lies if each fold's sign is a coin's."""
    rows = _numbered(skills)
    sizes = rows.groupBy("series_id").agg(F.first("folds").alias("folds"))
    flips = _drawn(sizes, resamples, seed).select("series_id", "resample", F.col("place").alias("i"), F.when(F.col("state") < MODULUS // 2, 1.0).otherwise(-1.0).alias("sign"))
    means = flips.join(rows, ["series_id", "i"]).groupBy("series_id", "resample").agg(F.avg(F.col("sign") * F.col("skill")).alias("v"))
    return sizes.join(_bounds(means, resamples, confidence), "series_id")


def average_ranks(rows: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Add ranks from 1 on; equal values share the mean of theirs. Values are counted first, so a frequent one is one row to rank."""
    counts = rows.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    placed = cumulative(counts, keys, [column], "_n").select(*keys, F.col(column).alias("_v"), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    same = F.col(f"_rows.{column}").eqNullSafe(F.col("_ranks._v"))
    for key in keys:
        same = same & F.col(f"_rows.{key}").eqNullSafe(F.col(f"_ranks.{key}"))
    return rows.alias("_rows").join(placed.alias("_ranks"), same).select("_rows.*", f"_ranks.{out}")


def spearman(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Correlation of average ranks of rows without a NULL."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = average_ranks(average_ranks(both, x, "_rx", keys), y, "_ry", keys)
    return both.groupBy(*keys).agg(stats.pearson("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def calibration_bins(rows: DataFrame, confidence: str, error: str, bins: int = 4, keys: tuple[str, ...] = ("series_id",), tie: str = "t") -> DataFrame:
    """Mean confidence, mean absolute error and size of bins of equal numbers of rows in order of confidence."""
    rows = cumulative(rows.select(*keys, confidence, error, tie), keys, [confidence, tie], None, "_i", "_n")
    # bin b holds positions from b * n div bins on: the largest such b
    rows = rows.withColumn("bin", F.floor(((F.col("_i") + 1) * bins - 1) / F.col("_n")).cast("int"))
    return rows.groupBy(*keys, "bin").agg(F.avg(confidence).alias("confidence"), F.avg(F.abs(error)).alias("error"), F.count(F.lit(1)).alias("n"))


def input_support(value: Column, low: Column, high: Column, margin: float = 0.25) -> Column:
    """1 inside the training range, falling to 0 over a margin outside; NULL without training values."""
    width = high - low
    away = F.when(value < low, low - value).otherwise(value - high)
    return F.when(low.isNull() | value.isNull(), None).when(width == 0, (value == low).cast("double")).when((value >= low) & (value <= high), 1.0).otherwise(stats.clamp01(1 - F.try_divide(away, width * margin)))


def _support(uncertainty: Column, name: str) -> Column:
    """1 / (1 + u): 1 where nothing is uncertain; a value below 0 is an error."""
    return F.when(uncertainty < 0, F.raise_error(F.lit(f"{name} must not be below 0")).cast("double")).otherwise(1 / (1 + uncertainty))


def prediction_confidence(stability: Column, parameter: Column, support: Column, residual: Column) -> Column:
    """The mean of stability, support and the supports 1 / (1 + u) of two uncertainties, at most the input's support; NULL if any is. Uncertainties below 0 are an error."""
    mean = (stability + _support(parameter, "parameter uncertainty") + support + _support(residual, "residual uncertainty")) / 4
    return F.when(mean.isNotNull(), stats.clamp01(F.least(mean, support)))
