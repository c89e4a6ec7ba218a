"""Checks of bars, settings and parameters; data checks are one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.operators import limits
from barwright.sources.bars import PRICES, VALUES


def violations(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each symbol: rows, nulls and bad values by column, broken price rules, unordered times."""
    order = "seq" if "seq" in bars.columns else "ts"
    back = F.coalesce(F.lag("ts").over(Window.partitionBy(*keys).orderBy(order)) > F.col("ts"), F.lit(False))
    rules = (F.col("high") < F.col("low")) | (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("open")) | (F.col("low") > F.col("close"))
    counts = [F.count("*").alias("n_rows")]
    for c in VALUES:
        counts.append(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"null_{c}"))
        counts.append(F.count_if(F.col(c) < 0 if c == "volume" else F.col(c) <= 0).alias(f"bad_{c}"))
    return bars.withColumn("_back", back).groupBy(*keys).agg(*counts, F.count_if(rules).alias("bad_rules"), F.count_if("_back").alias("unordered"))


def validate_bars(bars: DataFrame, strategy: object = True) -> None:
    """Raise ValueError with the first complaint, in the engine's order of precedence."""
    if not strategy:
        raise ValueError("Strategy cannot be None")
    missing = accepts_columns(bars.columns)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    for c in VALUES:
        if not isinstance(bars.schema[c].dataType, T.NumericType):
            raise ValueError(f"Column '{c}' must be numeric")
    if not isinstance(bars.schema["ts"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError("Data index must be DatetimeIndex")
    found = violations(bars)
    total = found.agg(F.min("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in found.columns if c not in ("symbol", "n_rows")], F.count_if(F.coalesce(F.col("symbol") == "", F.lit(True))).alias("nameless")).first()
    if total["n_rows"] is None:
        raise ValueError("Data cannot be empty")
    if total["n_rows"] < 2:
        raise ValueError("Data must have at least 2 rows for backtesting")
    for c in VALUES:
        if total[f"null_{c}"]:
            raise ValueError(f"Column '{c}' contains null values")
        if total[f"bad_{c}"]:
            raise ValueError(f"Column '{c}' contains {'non-positive' if c in PRICES else 'negative'} values")
    if total["bad_rules"]:
        raise ValueError(f"Found {total['bad_rules']} rows with invalid OHLC relationships")
    if total["nameless"]:
        raise ValueError("Symbol must be a non-empty string")
    if total["unordered"]:
        raise ValueError("Data index must be sorted in ascending order")


def validate_position_sizes(signals: DataFrame) -> None:
    """Every bar's position size counts, those of hold bars too."""
    bad = signals.where((F.col("position_size") < 0) | (F.col("position_size") > 1)).select("position_size").take(1)
    if bad:
        raise ValueError(f"Position size must be between 0 and 1, got {bad[0][0]}")


def between(bars: DataFrame, start: object, end: object) -> DataFrame:
    """Bars of [start, end); the range goes down to the Parquet scan."""
    return bars.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))


#: Fixed value: rows that walk-forward and Monte Carlo need.
LEAST_ROWS = 100


def validate_walk_forward(window_months: int, step_months: int, n_rows: int | None = None) -> None:
    limits.check({"test_window_months": window_months, "step_months": step_months}, limits.WALK_FORWARD)
    if n_rows is not None and n_rows < max(LEAST_ROWS, window_months * 30 // 7):
        raise ValueError(f"Insufficient data: {n_rows} rows")


def validate_monte_carlo(simulations: int, sample_share: float, block_rows: int, n_rows: int | None = None) -> int:
    """The block size to use: a quarter of the rows where a block would hold them all."""
    limits.check({"n_simulations": simulations, "bootstrap_sample_pct": sample_share, "block_size_days": block_rows}, limits.MONTE_CARLO)
    if n_rows is None:
        return block_rows
    if n_rows < LEAST_ROWS:
        raise ValueError(f"Insufficient data: {n_rows} rows")
    return block_rows if block_rows < n_rows else max(1, n_rows // 4)


def enough_rows(bars: DataFrame, window_months: int = 6, block_rows: int = 30) -> DataFrame:
    """(symbol, n_rows, walk_forward, monte_carlo, block_rows): whether each symbol has enough bars for either, and the block to use."""
    n = F.col("n_rows")
    block = F.when(n > block_rows, F.lit(block_rows).cast("long")).otherwise(F.greatest(F.expr("n_rows DIV 4"), F.lit(1)))
    counted = bars.groupBy("symbol").agg(F.count("*").alias("n_rows"))
    return counted.select("symbol", "n_rows", (n >= max(LEAST_ROWS, window_months * 30 // 7)).alias("walk_forward"), (n >= LEAST_ROWS).alias("monte_carlo"), block.alias("block_rows"))


def accepts_columns(columns: list[str], needed: tuple[str, ...] = VALUES) -> list[str]:
    """Needed columns that are missing, in order."""
    return [c for c in needed if c not in set(columns)]
