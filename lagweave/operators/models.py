"""Linear predictors on lagged values, fitted from distributed cross-products.

A model is a row of a table (series_id, model) with ranked sources. Features are built for
all models at once, cross-products are summed with partial aggregates, and what is left for
each model is a small dense system, solved in one task a model. Collinear or failing
sources are dropped on subsets of the same cross-products, without another scan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A pivot below this makes a system singular; ratios this close are one ratio; values below this are 0.
PIVOT, RATIO, ZERO = 1e-12, 1e-10, 1e-12
#: Share of two vectors' squared lengths below which their minor may be rounding.
MINOR = 1e-9

MODEL = ["series_id", "model"]


def features(panel: DataFrame, target: str, sources: DataFrame, lags: int | None, with_target: bool = True) -> DataFrame:
    """(series_id, model, t, y, x): for every t with all of its lags, x = [1, then for each lag the target's and the sources' values].

    sources: (series_id, model, source, rank, scale) with ranks from 1 on; a source's values
    are multiplied by scale. A model without sources needs a row with a NULL source. With
    ``lags`` None every model has its own number of lags in sources' column lags, which is
    given out too.
    """
    sources = sources if lags is None else sources.withColumn("lags", F.lit(lags))
    models = sources.groupBy(*MODEL, "lags").agg(F.count("source").alias("k"))
    own = sources.where("source is not null").select(*MODEL, "lags", F.col("source").alias("signal"), F.col("rank").cast("long").alias("place"), F.col("scale").cast("double").alias("scale"))
    if with_target:
        own = own.unionByName(models.select(*MODEL, "lags", F.lit(target).alias("signal"), F.lit(0).cast("long").alias("place"), F.lit(1.0).alias("scale")))
    shift = 1 if with_target else 0
    past = panel.where("value is not null").join(own, ["series_id", "signal"]).withColumn("lag", F.explode(F.sequence(F.lit(1), F.col("lags"))))
    past = past.select(*MODEL, (F.col("t") + F.col("lag")).alias("t"), F.struct("lag", "place", (F.col("value") * F.col("scale")).alias("v")).alias("f"))
    rows = past.groupBy(*MODEL, "t").agg(F.array_sort(F.collect_list("f")).alias("f"))
    label = panel.where((F.col("signal") == target) & F.col("value").isNotNull()).select("series_id", "t", F.col("value").alias("y"))
    rows = rows.join(models, MODEL).where(F.size("f") == F.col("lags") * (F.col("k") + shift)).join(label, ["series_id", "t"])
    return rows.select(*MODEL, *(["lags"] if lags is None else []), "t", "y", F.concat(F.array(F.lit(1.0)), F.transform("f", lambda f: f["v"])).alias("x"))


def gram(rows: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    """(keys, i, j, value): sums of x_i x_j, and of x_i y under j = -1."""
    wide = rows.select(*keys, "x", "y", F.posexplode("x").alias("i", "xi"))
    entries = wide.select(*keys, "i", F.posexplode(F.concat("x", F.array("y"))).alias("j", "xj"), "xi", F.size("x").alias("p"))
    return entries.groupBy(*keys, "i", F.when(F.col("j") == F.col("p"), -1).otherwise(F.col("j")).alias("j")).agg(F.sum(F.col("xi") * F.col("xj")).alias("value"), F.count(F.lit(1)).alias("n"))


def solve(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray | None:
    """Elimination with row pivoting; None if a pivot is below ``PIVOT``."""
    a = np.column_stack([matrix, vector]).astype(float)
    for c in range(len(vector)):
        best = c + int(np.abs(a[c:, c]).argmax())
        if abs(a[best, c]) < PIVOT:
            return None
        a[[c, best]] = a[[best, c]]
        a[c] /= a[c, c]
        others = np.arange(len(a)) != c
        a[others] -= np.outer(a[others, c], a[c])
    return a[:, -1]


def _with_lags(sums: DataFrame, lags: int | DataFrame) -> DataFrame:
    """Add each model's number of lags: one for all, or a table (series_id, model, lags)."""
    return sums.withColumn("lags", F.lit(lags)) if isinstance(lags, int) else sums.join(lags, MODEL)


def nearly_proportional(sums: DataFrame, lags: int | DataFrame, with_target: bool = True) -> DataFrame:
    """(series_id, model, low, high): ranks of sources whose lagged values may be proportional, by the minors of their part of ``gram``.

    A source's lagged values are one vector; the products of two such vectors are sums of
    entries that the cross-products already hold, so nothing else is read. Two vectors are
    proportional only where their minor is 0, up to rounding.
    """
    shift = 1 if with_target else 0
    wide = _with_lags(sums.groupBy(*MODEL).agg(F.max("i").alias("_p")), lags).select(*MODEL, (F.col("_p") / F.col("lags")).cast("int").alias("_w"))
    cells = sums.where("i > 0 and j > 0").join(wide, MODEL)
    at = lambda c: F.pmod(F.col(c) - 1, F.col("_w")) + 1 - shift
    same_lag = F.floor((F.col("i") - 1) / F.col("_w")) == F.floor((F.col("j") - 1) / F.col("_w"))
    products = cells.where(same_lag).groupBy(*MODEL, at("i").cast("int").alias("low"), at("j").cast("int").alias("high")).agg(F.sum("value").alias("v")).where("low > 0 and low <= high")
    own = products.where("low = high")
    pairs = products.where("low < high").join(own.select(*MODEL, "low", F.col("v").alias("a")), [*MODEL, "low"]).join(own.select(*MODEL, "high", F.col("v").alias("b")), [*MODEL, "high"])
    return pairs.where(F.col("v") * F.col("v") >= (1 - MINOR) * F.col("a") * F.col("b")).select(*MODEL, "low", "high")


def proportional_pairs(panel: DataFrame, sources: DataFrame, lags: int | None, labels: DataFrame, candidates: DataFrame) -> DataFrame:
    """(series_id, model, low, high): those of the candidates (``nearly_proportional``) whose lagged training values have one ratio throughout.

    labels: (series_id, t) of the training rows, or with ``lags`` None (series_id, lags, t) for
    models with lags of their own. Only candidates' values are compared, so without any
    nothing is joined.
    """
    sources = sources if lags is None else sources.withColumn("lags", F.lit(lags))
    on = ["series_id", "t", *(["lags"] if lags is None else [])]
    sides = candidates.select(*MODEL, "low", "high", F.explode(F.array("low", "high")).alias("rank"))
    chosen = sides.join(sources.where("source is not null").select(*MODEL, "source", "rank", "lags"), [*MODEL, "rank"])
    past = panel.withColumnRenamed("signal", "source").join(chosen, ["series_id", "source"]).withColumn("lag", F.explode(F.sequence(F.lit(1), F.col("lags"))))
    past = past.withColumn("t", F.col("t") + F.col("lag")).join(labels.select(*on), on, "left_semi")
    side = lambda c: F.max(F.when(F.col("rank") == F.col(c), F.col("value")))
    pairs = past.groupBy(*MODEL, "low", "high", "t", "lag").agg(side("low").alias("a"), side("high").alias("b")).where("a is not null and b is not null")
    za, zb = F.abs("a") < ZERO, F.abs("b") < ZERO
    ratio = F.when(~za & ~zb, F.try_divide("a", "b"))
    found = pairs.groupBy(*MODEL, "low", "high").agg(F.count_if(za != zb).alias("lone"), F.count(ratio).alias("n"), F.min_by(ratio, F.when(ratio.isNotNull(), F.struct("t", "lag"))).alias("first"), F.max(ratio).alias("most"), F.min(ratio).alias("least"))
    return found.where((F.col("lone") == 0) & (F.col("n") > 0) & (F.greatest(F.col("most") - F.col("first"), F.col("first") - F.col("least")) <= RATIO)).select(*MODEL, "low", "high")


SOLVED = "series_id string, model string, fit_status string, coefficients array<double>, kept array<int>, dropped array<int>"


def fit(rows: DataFrame, pairs: DataFrame | None = None, lags: int = 1, with_target: bool = True) -> DataFrame:
    """Fit every model of training ``features``: (series_id, model, fit_status, coefficients, kept, dropped).

    kept and dropped hold ranks of sources. A dropped source's coefficients are 0, so that
    they fit the whole feature vector. With no source left the status is
    baseline_only_no_stable_signal, and the coefficients are NULL.
    """
    return fit_sums(gram(rows), pairs, lags, with_target)


def running_gram(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Cross-products of all ``features`` rows before each of the origins (series_id, t), as ``gram`` gives them.

    Sums run along t once, so k origins cost no more passes than one. Models are called
    ``model@t``; an origin needs features of its own.
    """
    own = origins.select("series_id", "t").distinct()
    wide = rows.select(*MODEL, "t", "x", "y", F.posexplode("x").alias("i", "xi"))
    cells = wide.select(*MODEL, "t", "i", F.posexplode(F.concat("x", F.array("y"))).alias("j", "xj"), "xi", F.size("x").alias("p"))
    cells = cells.withColumn("j", F.when(F.col("j") == F.col("p"), -1).otherwise(F.col("j")))
    before = Window.partitionBy(*MODEL, "i", "j").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.select(*MODEL, "t", "i", "j", F.sum(F.col("xi") * F.col("xj")).over(before).alias("value"), F.count(F.lit(1)).over(before).alias("n"))
    return sums.where("n > 0").join(own, ["series_id", "t"], "left_semi").select("series_id", F.concat("model", F.lit("@"), "t").alias("model"), "i", "j", "value", "n")


def fit_sums(sums: DataFrame, pairs: DataFrame | None = None, lags: int | DataFrame = 1, with_target: bool = True) -> DataFrame:
    """``fit`` from the cross-products of ``gram`` or ``running_gram``; models may have lags of their own, by a table (series_id, model, lags)."""
    table = sums.select(*MODEL, "i", "j", "value")
    if pairs is not None:  # as entries below -1
        table = table.unionByName(pairs.select(*MODEL, F.col("low").cast("int").alias("i"), (-1 - F.col("high")).cast("int").alias("j"), F.lit(0.0).alias("value")))
    shift = 1 if with_target else 0

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        linked = {(int(i), -1 - int(j)) for i, j in zip(group["i"], group["j"]) if j < -1}
        cells = group[group["j"] >= -1]
        p = int(cells["i"].max()) + 1
        m = np.zeros((p, p + 1))
        m[cells["i"], cells["j"]] = cells["value"]  # the column of y is the last
        lags = int(group["lags"].iloc[0])
        k = (p - 1) // lags - shift
        active, dropped = [*range(1, k + 1)], []

        def collinear() -> int | None:
            return next((b for n, a in enumerate(active) for b in active[n + 1 :] if (a, b) in linked), None)

        while len(active) > 1 and (worse := collinear()) is not None:
            active.remove(worse)
            dropped.append(worse)
        beta = None
        while beta is None and (active or k == 0):
            width = k + shift
            use = [0] + [1 + lag * width + place for lag in range(lags) for place in ([0] if shift else []) + [r - 1 + shift for r in active]]
            solved = solve(m[np.ix_(use, use)], m[use, -1])
            if solved is not None:
                beta = np.zeros(p)
                beta[use] = solved
            elif k == 0:
                break
            else:
                worse = collinear() or active[-1]
                active.remove(worse)
                dropped.append(worse)
        status = "baseline_only_no_stable_signal" if beta is None else "fit_after_collinearity_backoff" if dropped else "fit"
        return pd.DataFrame([{"series_id": key[0], "model": key[1], "fit_status": status, "coefficients": None if beta is None else beta.tolist(), "kept": active, "dropped": dropped}])

    return _with_lags(table, lags).groupBy(*MODEL).applyInPandas(one, SOLVED)


def predict(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(series_id, model, t, y, predicted); NULL where the model has no coefficients."""
    dot = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(models.select(*MODEL, "coefficients"), MODEL, "left").select(*MODEL, "t", "y", dot.alias("predicted"))


def feature_names(target: str, sources: list[str], lags: int) -> list[str]:
    return ["intercept", *(f"{s}_lag{lag}" for lag in range(1, lags + 1) for s in (target, *sources))]


def top_sources(relations: DataFrame, target: str, count: int, model: str = "top") -> DataFrame:
    """Sources of a model: the best ``count`` for the target, scaled by their weights."""
    order = Window.partitionBy("series_id").orderBy(F.round("score", 12).desc(), "source", "lag")
    rows = relations.where(F.col("target") == target).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return rows.select("series_id", F.lit(model).alias("model"), "source", "rank", F.col("weight").alias("scale"))
