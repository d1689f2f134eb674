"""Declared transforms of signals, and the guard against undeclared persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import stats

TRANSFORMS = ("none", "diff", "log_diff")
#: Beyond this lag-one autocorrelation of the levels a signal needs a transform.
PERSISTENCE_LIMIT = 0.95


def by_signal() -> WindowSpec:
    return Window.partitionBy("series_id", "signal").orderBy("t")


def transform(panel: DataFrame, transforms: DataFrame | dict[str, str]) -> DataFrame:
    """Replace values by the declared transform's: the first value of a differenced signal is NULL.

    transforms: a table (signal, transform), or a mapping. Raises where a signal has no
    declaration or an unknown one, and for log_diff of a value that isn't positive.
    """
    if isinstance(transforms, dict):
        if bad := sorted({v for v in transforms.values()} - {*TRANSFORMS}):
            raise ValueError(f"unknown transforms: {', '.join(bad)}")
        pairs = [F.lit(x) for kv in transforms.items() for x in kv]
        kind = F.create_map(*pairs)[F.col("signal")] if pairs else F.lit(None).cast("string")
        rows = panel.withColumn("transform", kind)
    else:
        rows = panel.join(transforms.select("signal", "transform"), "signal", "left")
    level = F.col("value")
    log = F.when(level > 0, F.ln(F.when(level > 0, level))).otherwise(F.raise_error(F.lit("log_diff needs positive values")).cast("double"))
    value = (
        F.when(F.col("transform") == "none", level)
        .when(F.col("transform") == "diff", level - F.lag("value").over(by_signal()))
        .when(F.col("transform") == "log_diff", log - F.ln(F.lag(F.when(level > 0, level)).over(by_signal())))
        .otherwise(F.raise_error(F.concat(F.lit("no transform is declared for "), F.col("signal"))).cast("double"))
    )
    return rows.select("series_id", "t", "signal", value.alias("value"), "transform")


def diagnostics(panel: DataFrame) -> DataFrame:
    """Lag-one autocorrelation of each signal's values, and whether it is beyond the limit."""
    pairs = panel.select("series_id", "signal", F.lag("value").over(by_signal()).alias("x"), F.col("value").alias("y")).where("x is not null and y is not null")
    acf = pairs.groupBy("series_id", "signal").agg(stats.pearson("x", "y").alias("lag1_acf"), F.count(F.lit(1)).alias("pairs"))
    return acf.withColumn("highly_persistent", F.abs("lag1_acf") > PERSISTENCE_LIMIT)


def undeclared_persistence(panel: DataFrame, transforms: dict[str, str]) -> DataFrame:
    """Signals whose levels are beyond the limit though they are declared ``none``."""
    plain = [s for s, kind in transforms.items() if kind == "none"]
    return diagnostics(panel).where(F.col("highly_persistent") & F.col("signal").isin(plain))


def persistent_windows(panel: DataFrame, transforms: dict[str, str], window: int) -> DataFrame:
    """(series_id, signal, step): full windows before a step in which levels declared ``none`` are beyond the limit."""
    plain = [s for s, kind in transforms.items() if kind == "none"]
    rows = panel.where(F.col("signal").isin(plain)).select("series_id", "signal", "t", F.lag("value").over(by_signal()).alias("x"), F.col("value").alias("y"))
    ends = rows.groupBy("series_id", "signal").agg((F.max("t") + 1).alias("t"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    # a pair's earlier value lies in the window as well
    frame = by_signal().rangeBetween(1 - window, -1)
    first = F.min("t").over(Window.partitionBy("series_id", "signal"))
    found = rows.unionByName(ends).withColumns({"acf": stats.pearson_over("x", "y", frame), "first": first})
    return found.where((F.col("t") - F.col("first") >= window) & (F.abs("acf") > PERSISTENCE_LIMIT)).select("series_id", "signal", F.col("t").alias("step"))


class PersistentLevels(ValueError):
    """Levels that need a transform but are declared ``none``."""


def guarded(panel: DataFrame, transforms: dict[str, str]) -> DataFrame:
    """The transformed panel; raises where a level is beyond the limit though it is declared ``none``."""
    bad = undeclared_persistence(panel, transforms).select("series_id", "signal").limit(20).collect()
    if bad:
        raise PersistentLevels("levels persist, a transform must be declared: " + ", ".join(sorted(f"{r[0]}/{r[1]}" for r in bad)))
    return transform(panel, transforms)


def label(transforms: dict[str, str]) -> str:
    """One transform's name, or the sorted names of several."""
    kinds = sorted({*transforms.values()})
    return kinds[0] if len(kinds) == 1 else "mixed:" + ",".join(kinds)
