"""Bars: the canonical schema and the series derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")

#: A bar; ``seq`` is its place in the source, which fills and keep-first go by.
BAR = T.StructType([T.StructField("symbol", T.StringType(), False), T.StructField("ts", T.TimestampType(), False), *(T.StructField(c, T.DoubleType()) for c in VALUES), T.StructField("seq", T.LongType())])


def _aggregated(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Open and close by ``order``, extremes and count: one shuffle, partial sums before it."""
    first, last = F.min_by(value, order), F.max_by(value, order)
    bars = rows.groupBy("symbol", "ts").agg(first.alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), last.alias("close"), F.count("*").cast("double").alias("volume"))
    return bars


def with_seq(bars: DataFrame) -> DataFrame:
    return bars.withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).cast("long"))


def orders_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each order priority, by order date."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey", "o_totalprice")
    return _aggregated(rows, "o_totalprice", "o_orderkey")


def events_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly series for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "event_id", "value")
    return _aggregated(rows, "value", "event_id")


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders_bars with faults at fixed places: null, infinite, high below low, non-positive, repeated time."""
    bars = with_seq(orders_bars(spark, sf_dir))
    every: dict[int, Column] = {n: F.col("seq") % n == 0 for n in (97, 89, 83, 79, 71)}
    earlier = F.lag("ts").over(Window.partitionBy("symbol").orderBy("seq"))
    faulty = bars.withColumns({
        "close": F.when(every[97], None).otherwise(F.col("close")),
        "volume": F.when(every[89], F.lit(float("inf"))).otherwise(F.col("volume")),
        "high": F.when(every[83], F.col("low") - 1).otherwise(F.col("high")),
        "open": F.when(every[79], -F.col("open")).otherwise(F.col("open")),
        "ts": F.when(every[71], F.coalesce(earlier, "ts")).otherwise(F.col("ts")),
    })
    return faulty.select("symbol", "ts", *VALUES, "seq")
