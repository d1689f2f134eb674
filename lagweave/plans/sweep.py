"""Budget sweep, validation search and the frozen test over many panels at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import evaluation, models, relations, selection
from .settle import settle


def _within(windows: DataFrame, low: str | None, high: str | None) -> Column:
    """Whether t lies in a window whose ends may be absent or NULL."""
    ok = F.lit(True)
    if low in windows.columns:
        ok = ok & F.coalesce(F.col("t") >= F.col(low), F.lit(True))
    if high in windows.columns:
        ok = ok & F.coalesce(F.col("t") <= F.col(high), F.lit(True))
    return ok


def split_rows(panel: DataFrame, target: str, lags: int, windows: DataFrame, season: int = 12) -> DataFrame:
    """Label rows (series_id, t, idx, actual, persistence, seasonal, is_train): all with ``lags`` rows before them.

    windows: (series_id, train_end) and any of train_start, test_start and test_end; by
    default the test begins after the training. Rows in neither window are left out.
    """
    rows = evaluation.naive_forecasts(evaluation.target_rows(panel, target), season).join(windows, "series_id")
    train = _within(windows, "train_start", "train_end")
    test = (F.col("t") > F.col("train_end")) & _within(windows, "test_start", "test_end")
    return rows.where((F.col("idx") >= lags) & (train | test)).withColumn("is_train", train).drop(*[c for c in windows.columns if c != "series_id"])


def train_ends(panel: DataFrame, target: str, share: int = 5) -> DataFrame:
    """The last t before the final fifth (or other ``share``) of each series."""
    rows = evaluation.hold_out(evaluation.target_rows(panel, target), share)
    return rows.where("not is_test").groupBy("series_id").agg(F.max("t").alias("train_end"))


def training_relations(panel: DataFrame, target: str, lags: int, windows: DataFrame) -> DataFrame:
    """Settled, as several steps read it: a few rows a series, next to the panel they are summed from."""
    past = panel.join(windows, "series_id").where(_within(windows, "train_start", "train_end")).select(*panel.columns)
    return settle(relations.relations(past, lags, target))


def _names(rows: DataFrame, name: str) -> DataFrame:
    """(series_id, model, name): the sources of rows (series_id, model, rank, source) in order of rank, joined by semicolons."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source")))
    return rows.groupBy("series_id", "model").agg(F.array_join(F.transform(ordered, lambda s: s["source"]), ";").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))


def _fitted(panel: DataFrame, rows: DataFrame, sources: DataFrame, lags: int | None, train: DataFrame) -> DataFrame:
    """The models of training ``features``, without sources that are proportional to better ones. Cross-products are summed once.

    With ``lags`` None sources and training rows have a column lags.
    """
    sums = settle(models.gram(rows.join(train, ["series_id", "t", *(["lags"] if lags is None else [])], "left_semi")))
    each = sources.select(*models.MODEL, "lags").distinct() if lags is None else lags
    pairs = models.proportional_pairs(panel, sources, lags, train, settle(models.nearly_proportional(sums, each)))
    return settle(models.fit_sums(sums, pairs, each))


def budget_sweep_frames(panel: DataFrame, target: str, lags: int, cap: int, windows: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tiers' metrics, and their predictions of every test row.

    Metrics have one row for each series and tier: sources kept, admitted and used, fit
    status, errors of model and persistence on test rows. Models are fixed on training rows.
    A tier without a model has NULL errors, never the baseline's. Losses are relative to the
    full budget. Predictions: (series_id, budget, t, actual, persistence, predicted).
    """
    labels = settle(split_rows(panel, target, lags, windows))
    found = training_relations(panel, target, lags, windows)
    kept = settle(selection.retain(found, budgets).withColumn("model", F.format_string("%.2f", "budget")))
    admitted = kept.where(F.col("rank") <= cap)
    sources = settle(admitted.select("series_id", "model", "source", "rank", F.col("weight").alias("scale")))
    rows = models.features(panel, target, sources, lags)
    train = labels.where("is_train").select("series_id", "t")
    fitted = _fitted(panel, rows, sources, lags, train)
    test = labels.where("not is_train")
    predicted = models.predict(rows, fitted).join(test.select("series_id", "t"), ["series_id", "t"], "left_semi").where("predicted is not null")
    predicted = settle(predicted)
    scored = predicted.groupBy("series_id", "model").agg(stats.mae(F.col("y"), F.col("predicted")).alias("model_mae"), stats.rmse(F.col("y"), F.col("predicted")).alias("model_rmse"))
    base = evaluation.errors(test, "persistence").select("series_id", F.col("mae").alias("persistence_mae"), F.col("rmse").alias("persistence_rmse"), F.col("n").alias("test_rows"))
    n_train = labels.where("is_train").groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    counts = kept.groupBy("series_id", "model").agg(F.count(F.lit(1)).alias("retained"), F.sum((F.col("rank") <= cap).cast("long")).alias("admitted"))
    candidates = found.groupBy("series_id").agg(F.count(F.lit(1)).alias("candidates"))
    ranks = lambda c: fitted.select(*models.MODEL, F.explode(c).alias("rank")).join(sources.select(*models.MODEL, "rank", "source"), [*models.MODEL, "rank"])
    table = base.crossJoin(F.broadcast(budgets)).withColumn("model", F.format_string("%.2f", "budget")).join(n_train, "series_id").join(candidates, "series_id")
    lists = (_names(kept, "retained_sources"), _names(admitted, "sources"), _names(ranks("kept"), "used_sources"), _names(ranks("dropped"), "dropped_sources"))
    for more in (counts, *lists, fitted.select(*models.MODEL, "fit_status"), scored):
        table = table.join(more, ["series_id", "model"], "left")
    admitted_n = F.coalesce("admitted", F.lit(0))
    compute = admitted_n * lags * F.col("rows")
    table = table.withColumns({c: F.coalesce(c, F.lit("")) for c in ("retained_sources", "sources", "used_sources", "dropped_sources")})
    table = table.withColumns({"retained": F.coalesce("retained", F.lit(0)), "admitted": admitted_n, "used": F.coalesce("n_used_sources", F.lit(0)), "fit_status": F.coalesce("fit_status", F.lit("baseline_only_no_retained_signal")), "compute": compute, "memory": compute, "bytes": compute * selection.VALUE_BYTES})
    # the full budget's figures, next to every tier's
    full = Window.partitionBy("series_id").orderBy(F.col("budget").desc())
    loss = lambda v: stats.relative_change_pct(v, F.first(v).over(full))
    table = table.withColumns({
        "mae_loss_pct": loss("model_mae"), "rmse_loss_pct": loss("model_rmse"),
        "mae_vs_persistence_pct": stats.relative_change_pct("model_mae", "persistence_mae"), "rmse_vs_persistence_pct": stats.relative_change_pct("model_rmse", "persistence_rmse"),
    })
    figures = table.drop("model", "rows", *[c for c in table.columns if c.startswith("n_")])
    every = test.crossJoin(F.broadcast(budgets.select("budget"))).withColumn("model", F.format_string("%.2f", "budget"))
    predictions = every.join(predicted.select(*models.MODEL, "t", "predicted"), [*models.MODEL, "t"], "left").select("series_id", "budget", "t", "actual", "persistence", "predicted")
    return figures, predictions


def budget_sweep(panel: DataFrame, target: str, lags: int, cap: int, train_end: DataFrame, budgets: DataFrame) -> DataFrame:
    """The metrics of ``budget_sweep_frames``."""
    return budget_sweep_frames(panel, target, lags, cap, train_end, budgets)[0]


def _status(fit: Column | str, sources: Column) -> Column:
    return F.when(sources == 0, "baseline_only_no_retained_signal").otherwise(F.col(fit) if isinstance(fit, str) else fit)


def validation_search(panel: DataFrame, target: str, lag_grid: list[int], thresholds: list[float], caps: list[int], train: DataFrame, validation: DataFrame) -> DataFrame:
    """Errors on validation rows of every (lag, threshold, cap); a cell without a model scores persistence.

    train: (series_id, train_end) and perhaps train_start; validation: (series_id,
    validation_end) and perhaps validation_start, which else follows the training. Rows
    after the validation are never read.

    All cells go through one pass: correlations of the longest lag hold those of all shorter
    ones, cells with equally many sources at a lag share a model, and models with lags of
    their own are built, summed and fitted together.
    """
    spark = panel.sparkSession
    grid = spark.createDataFrame([(t, c) for t in thresholds for c in caps], "threshold double, cap int")
    every = F.broadcast(spark.createDataFrame([(lags,) for lags in lag_grid], "lags int"))
    windows = train.join(validation.withColumnsRenamed({"validation_end": "test_end", "validation_start": "test_start"}), "series_id")
    seen = panel.join(windows.select("series_id", F.col("test_end").alias("_end")), "series_id").where("t <= _end").drop("_end")
    labels = settle(split_rows(seen, target, 1, windows))
    own = labels.where("is_train").crossJoin(every).where(F.col("idx") >= F.col("lags")).select("series_id", "lags", "t")
    held = labels.where("not is_train")  # every lag is scored on the same rows
    past = seen.join(windows, "series_id").where(_within(windows, "train_start", "train_end")).select(*panel.columns)
    lagged = settle(relations.lagged_correlations(past, max(lag_grid), target))
    best = relations.best_lags(lagged.join(every, F.col("lag") <= F.col("lags")), [*relations.EDGE, "lags"])
    found = settle(relations.ranked(best, ("series_id", "target", "lags")))
    name = F.concat_ws(":", "lags", "k")
    lists = found.crossJoin(F.broadcast(grid)).where("score > threshold").groupBy("series_id", "lags", "threshold", "cap").agg(F.count(F.lit(1)).alias("retained"), F.least(F.count(F.lit(1)), F.first("cap")).cast("int").alias("k"))
    # a cell admits the best k sources: models of a lag differ by k alone
    sources = found.join(lists.select("series_id", "lags", "k").distinct(), ["series_id", "lags"]).where("rank <= k")
    sources = settle(sources.select("series_id", name.alias("model"), "source", "rank", F.col("weight").alias("scale"), "lags"))
    rows = models.features(seen, target, sources, None)
    fitted = _fitted(seen, rows, sources, None, own)
    predicted = models.predict(rows, fitted).join(held.select("series_id", "t", "persistence"), ["series_id", "t"])
    value = F.coalesce("predicted", "persistence")
    scored = predicted.groupBy("series_id", "model").agg(stats.mae(F.col("y"), value).alias("mae"), stats.rmse(F.col("y"), value).alias("rmse"))
    base = evaluation.errors(held, "persistence").select("series_id", F.col("mae").alias("persistence_mae"), F.col("rmse").alias("persistence_rmse"), F.col("n").alias("validation_rows"))
    ranks = lambda c: fitted.select(*models.MODEL, F.explode(c).alias("rank")).join(sources.select(*models.MODEL, "rank", "source"), [*models.MODEL, "rank"])
    table = base.crossJoin(every).crossJoin(F.broadcast(grid))
    table = table.join(own.groupBy("series_id", "lags").agg(F.count(F.lit(1)).alias("train_rows")), ["series_id", "lags"], "left")
    table = table.join(found.groupBy("series_id", "lags").agg(F.count(F.lit(1)).alias("candidates")), ["series_id", "lags"], "left")
    table = table.join(lists, ["series_id", "lags", "threshold", "cap"], "left").withColumn("model", F.when(F.col("k").isNotNull(), name))
    for more in (scored, fitted.select(*models.MODEL, "fit_status", "coefficients"), _names(sources, "sources"), _names(ranks("kept"), "used_sources"), _names(ranks("dropped"), "dropped_sources")):
        table = table.join(more, ["series_id", "model"], "left")
    k = F.coalesce("k", F.lit(0)).cast("long")
    return settle(table.select(
        "series_id", F.col("lags").alias("lag_window"), "threshold", "cap", "candidates", F.coalesce("retained", F.lit(0)).alias("retained"), k.alias("n_sources"), F.coalesce("n_used_sources", F.lit(0)).alias("used"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("sources", "used_sources", "dropped_sources")], "coefficients", _status("fit_status", k).alias("fit_status"),
        F.coalesce("mae", "persistence_mae").alias("validation_mae"), F.coalesce("rmse", "persistence_rmse").alias("validation_rmse"), "persistence_mae", "persistence_rmse",
        stats.relative_change_pct(F.coalesce("mae", "persistence_mae"), "persistence_mae").alias("mae_vs_persistence_pct"), "train_rows", "validation_rows",
    ))


def select_cell(grid: DataFrame) -> DataFrame:
    """The best cell of each series: least error, fewest sources used, highest threshold, smallest lag and cap, then source names; baseline_only if it doesn't beat persistence."""
    key = F.struct(F.round("validation_mae", stats.TIE_DIGITS).alias("e"), "used", (-F.col("threshold")).alias("h"), "lag_window", "cap", "used_sources")
    best = grid.groupBy("series_id").agg(F.min_by(F.struct(*[c for c in grid.columns if c != "series_id"]), key).alias("b")).select("series_id", "b.*")
    return settle(best).withColumn("mode", F.when(F.col("validation_mae") >= F.col("persistence_mae"), "baseline_only").otherwise("model"))


def frozen_test_frames(panel: DataFrame, target: str, cells: DataFrame, windows: DataFrame, lag_grid: list[int]) -> tuple[DataFrame, DataFrame]:
    """Refit the chosen cells on training rows, validation included, and test once: metrics, and predictions of every test row.

    windows: (series_id, train_end) and any of train_start, test_start and test_end. Sources
    are ranked again on the longer training rows. A baseline_only series, or one that keeps
    no source or model, has NULL model errors.
    """
    out = shown = None
    for lags in lag_grid:
        own = cells.where(F.col("lag_window") == lags)
        part = panel.join(own.select("series_id"), "series_id", "left_semi")
        # the baseline needs one row before a label, a model all its lags
        labels = settle(split_rows(part, target, 1, windows).where(~F.col("is_train") | (F.col("idx") >= lags)))
        found = relations.ranked(training_relations(part, target, lags, windows)).join(own.where("mode = 'model'").select("series_id", "threshold", "cap"), "series_id")
        sources = settle(found.where("score > threshold and rank <= cap").select("series_id", F.lit("frozen").alias("model"), "source", "rank", F.col("weight").alias("scale")))
        rows = models.features(part, target, sources, lags)
        train, test = labels.where("is_train").select("series_id", "t"), labels.where("not is_train")
        fitted = _fitted(part, rows, sources, lags, train)
        predicted = settle(models.predict(rows, fitted).join(test.select("series_id", "t"), ["series_id", "t"], "left_semi").where("predicted is not null"))
        scored = predicted.groupBy("series_id").agg(stats.mae(F.col("y"), F.col("predicted")).alias("model_mae"), stats.rmse(F.col("y"), F.col("predicted")).alias("model_rmse"))
        base = evaluation.errors(test, "persistence").select("series_id", F.col("mae").alias("persistence_mae"), F.col("rmse").alias("persistence_rmse"), F.col("n").alias("test_rows"))
        ranks = lambda c: fitted.select(*models.MODEL, F.explode(c).alias("rank")).join(sources.select(*models.MODEL, "rank", "source"), [*models.MODEL, "rank"])  # noqa: B023, E731
        rest = base.join(own.select("series_id", "mode", "lag_window", "threshold", "cap"), "series_id").join(scored, "series_id", "left")
        for more in (fitted.select(*models.MODEL, "fit_status", "coefficients"), _names(ranks("kept"), "used_sources"), _names(ranks("dropped"), "dropped_sources")):
            rest = rest.join(more.drop("model"), "series_id", "left")
        status = F.when(F.col("mode") == "baseline_only", "baseline_only_validation_guard").otherwise(F.coalesce("fit_status", F.lit("baseline_only_no_retained_signal_after_refit")))
        rest = rest.withColumns({"fit_status": status, "used": F.coalesce("n_used_sources", F.lit(0)), "mae_vs_persistence_pct": stats.relative_change_pct("model_mae", "persistence_mae"), **{c: F.coalesce(c, F.lit("")) for c in ("used_sources", "dropped_sources")}}).drop("n_used_sources", "n_dropped_sources")
        rows_out = test.join(predicted.select("series_id", "t", "predicted"), ["series_id", "t"], "left").select("series_id", "t", "actual", "persistence", "predicted")
        out, shown = (rest, rows_out) if out is None else (out.unionByName(rest), shown.unionByName(rows_out))
    return out, shown


def frozen_test(panel: DataFrame, target: str, cells: DataFrame, refit_end: DataFrame, lag_grid: list[int]) -> DataFrame:
    """The metrics of ``frozen_test_frames``."""
    return frozen_test_frames(panel, target, cells, refit_end, lag_grid)[0]


def real_case(panel: DataFrame, target: str, lags: int, cap: int, windows: DataFrame, season: int = 0, budgets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Ranking, model, metrics, predictions and resources of a case, all sources ranked and models fixed on training rows.

    * ranking: every source with its rank, and whether the model uses it;
    * model: status, coefficients, used and dropped sources;
    * metrics: (series_id, name, mae, rmse, n) of persistence, the model, and the seasonal forecast for a ``season`` above 0;
    * predictions: a row for each test row; a column is NULL where that forecast isn't made;
    * resources: what each budget would keep, without the cap.
    """
    budgets = selection.tiers(panel.sparkSession) if budgets is None else budgets
    labels = settle(split_rows(panel, target, lags, windows, max(season, 1)))
    found = settle(relations.ranked(training_relations(panel, target, lags, windows)))
    sources = settle(found.where(F.col("rank") <= cap).select("series_id", F.lit("model").alias("model"), "source", "rank", F.col("weight").alias("scale")))
    rows = models.features(panel, target, sources, lags)
    train, test = labels.where("is_train").select("series_id", "t"), labels.where("not is_train")
    fitted = _fitted(panel, rows, sources, lags, train)
    predicted = models.predict(rows, fitted).select("series_id", "t", F.col("predicted").alias("model"))
    predictions = settle(test.join(predicted, ["series_id", "t"], "left").select("series_id", "t", "actual", "persistence", "model", (F.col("seasonal") if season > 0 else F.lit(None).cast("double")).alias("seasonal")))
    metrics = None
    for name in ("persistence", "model", "seasonal"):
        part = evaluation.errors(predictions, name).select("series_id", F.lit(name).alias("name"), "mae", "rmse", "n")
        metrics = part if metrics is None else metrics.unionByName(part)
    used = fitted.select("series_id", F.explode("kept").alias("rank"))
    ranking = selection.mark_selected(found, found.join(used, ["series_id", "rank"], "left_semi"))
    names = lambda c: fitted.select(*models.MODEL, F.explode(c).alias("rank")).join(sources.select(*models.MODEL, "rank", "source"), [*models.MODEL, "rank"])
    model = fitted.select(*models.MODEL, "fit_status", "coefficients").join(_names(names("kept"), "used_sources"), models.MODEL, "left").join(_names(names("dropped"), "dropped_sources"), models.MODEL, "left")
    n_train = train.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = selection.retain(found.drop("rank"), budgets).withColumn("model", F.format_string("%.2f", "budget"))
    resources = selection.resource_profile(found, budgets, lags, n_train).withColumn("model", F.format_string("%.2f", "budget")).join(_names(kept, "sources"), models.MODEL, "left").drop("model", "n_sources")
    return {"ranking": ranking, "model": model.drop("model", "n_used_sources", "n_dropped_sources"), "metrics": metrics, "predictions": predictions, "resources": resources.withColumn("sources", F.coalesce("sources", F.lit("")))}
