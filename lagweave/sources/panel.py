"""Evenly spaced panels in long form: (series_id, t, signal, value).

t counts months (year * 12 + month) or days; a series is complete if it has every t between
its first and last. Missing steps are never filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import fixed10

#: The signal that relations are ranked for in the panels built here.
TARGET = "volume"


def month_index(period: Column) -> Column:
    """Months since year 0 of a date, timestamp or a YYYY-MM string; NULL for a malformed string."""
    return F.year(period) * 12 + F.month(period)


def period_index(period: Column) -> Column:
    ok = period.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.when(ok, F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int"))


def month_label(t: Column) -> Column:
    """YYYY-MM of a month index."""
    return F.format_string("%04d-%02d", F.floor((t - 1) / 12).cast("int"), ((t - 1) % 12 + 1).cast("int"))


def melt(wide: DataFrame, signals: list[str]) -> DataFrame:
    """Long form of a table with a column for each signal."""
    return wide.unpivot(["series_id", "t"], signals, "signal", "value")


def widen(panel: DataFrame, signals: list[str]) -> DataFrame:
    """A column for each signal."""
    return panel.groupBy("series_id", "t").pivot("signal", signals).agg(F.first("value"))


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    wide = rows.groupBy(F.lit("lineitem").alias("series_id"), month_index(F.col("l_shipdate")).cast("long").alias("t")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("volume"),
        F.round(F.avg("l_quantity"), 8).alias("quantity"),
        F.round(F.avg("l_discount"), 8).alias("discount"),
        F.round(F.avg("l_tax"), 8).alias("tax"),
        F.count(F.lit(1)).cast("double").alias("lines"),
    )
    return melt(wide, ["volume", "quantity", "discount", "tax", "lines"])


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_totalprice", "o_orderstatus")
    wide = rows.groupBy(F.lit("orders").alias("series_id"), month_index(F.col("o_orderdate")).cast("long").alias("t")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("volume"),
        F.count(F.lit(1)).cast("double").alias("orders"),
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("finished"),
    )
    return melt(wide, ["volume", "orders", "finished"])


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value", "user_id")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long")
    wide = rows.groupBy(F.concat(F.lit("events:"), "event_type").alias("series_id"), day.alias("t")).agg(
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.round(F.avg("value"), 8).alias("mean_value"),
        F.round(F.max("value"), 8).alias("max_value"),
        F.countDistinct("user_id").cast("double").alias("users"),
    )
    return melt(wide, ["volume", "mean_value", "max_value", "users"])


def brand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each brand, with the gaps it has."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    wide = items.join(parts, items["l_partkey"] == parts["p_partkey"]).groupBy(F.col("p_brand").alias("series_id"), month_index(F.col("l_shipdate")).cast("long").alias("t")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("volume"), F.round(F.avg("l_quantity"), 8).alias("quantity"), F.round(F.avg("l_discount"), 8).alias("discount")
    )
    return melt(wide, ["volume", "quantity", "discount"])


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands without gaps."""
    return complete_series(brand_rows(spark, sf_dir))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly and daily series of the base tables."""
    return lineitem_panel(spark, sf_dir).unionByName(orders_panel(spark, sf_dir)).unionByName(events_panel(spark, sf_dir))


def axis_audit(panel: DataFrame) -> DataFrame:
    """Per series and signal: expected and present steps, missing and repeated ones, and whether the axis is complete."""
    steps = panel.groupBy("series_id", "signal", "t").agg(F.count(F.lit(1)).alias("n"))
    axis = steps.groupBy("series_id", "signal").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("present"), F.count_if(F.col("n") > 1).alias("repeated"))
    axis = axis.withColumn("expected", F.col("last_t") - F.col("first_t") + 1).withColumn("missing", F.col("expected") - F.col("present"))
    return axis.withColumn("is_complete", (F.col("missing") == 0) & (F.col("repeated") == 0))


def missing_steps(panel: DataFrame) -> DataFrame:
    """(series_id, t) of the steps between a series' first and last that it lacks."""
    ends = panel.groupBy("series_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    expected = ends.select("series_id", F.explode(F.sequence("a", "b")).alias("t"))
    return expected.join(panel.select("series_id", "t").distinct(), ["series_id", "t"], "left_anti")


def complete_series(panel: DataFrame) -> DataFrame:
    """The series whose signals all have every step once."""
    bad = axis_audit(panel).groupBy("series_id").agg(F.bool_and("is_complete").alias("ok"), F.min("first_t").alias("a"), F.max("first_t").alias("b")).where("ok and a = b")
    return panel.join(bad.select("series_id"), "series_id", "left_semi")


def series_digest(panel: DataFrame) -> DataFrame:
    """SHA-256 of each signal's values, printed with ten decimals, a line each, in order of t."""
    line = fixed10("value")
    ordered = F.array_sort(F.collect_list(F.struct("t", line.alias("line"))))
    return panel.groupBy("series_id", "signal").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n"), F.lit("\n")), 256).alias("digest"))
