"""Metrics of simulated runs: one more shuffle by the run's keys, shared by all windows and sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barwright.operators.fold import Engine, Lots

YEAR = 252
ROLLING = 30
NAN = float("nan")


def _order(keys: tuple[str, ...]):  # noqa: ANN202
    return Window.partitionBy(*keys).orderBy("row_idx")


def equity_curve(simulated: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``simulated`` with portfolio_value, running_peak, drawdown (share) and ret (change since the bar before)."""
    order = _order(keys)
    worth = simulated.where("error IS NULL").withColumn("portfolio_value", F.col("cash") + F.col("position") * F.col("close"))
    peak = F.max("portfolio_value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("portfolio_value").over(order)
    curve = worth.withColumns({"running_peak": peak, "ret": F.try_divide("portfolio_value", before) - 1})
    return curve.withColumn("drawdown", (F.col("portfolio_value") - F.col("running_peak")) / F.col("running_peak"))


def rolling_statistics(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """drawdown_pct, rolling_sharpe_30d and rolling_volatility_30d; null until thirty returns."""
    frame = _order(keys).rowsBetween(-(ROLLING - 1), 0)
    full = F.count("ret").over(frame) >= ROLLING
    mean, spread = F.avg("ret").over(frame), F.stddev_samp("ret").over(frame)
    return curve.withColumns({
        "drawdown_pct": F.col("drawdown") * 100,
        "rolling_sharpe_30d": F.when(full & (spread > 0), mean * YEAR / (spread * F.sqrt(F.lit(float(YEAR))))),
        "rolling_volatility_30d": F.when(full, spread * F.sqrt(F.lit(float(YEAR))) * 100),
    })


def sharpe(ret: Column) -> Column:
    """Annual Sharpe ratio of returns, as an aggregate; 0 for fewer than two or without spread."""
    spread = F.stddev_samp(ret)
    return F.when((F.count(ret) > 1) & (spread > 0), F.sqrt(F.lit(float(YEAR))) * F.avg(ret) / spread).otherwise(0.0)


def closed_positions(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A sell closes the buy right before it; values are compared as they are, even if quantities differ."""
    order = _order(keys)
    entry = F.lag(F.struct("side", "ts", "price", "quantity", "value")).over(order)
    pairs = trades.withColumn("entry", entry).where("side = 'sell' AND entry.side = 'buy'")
    pnl = F.col("value") - F.col("entry.value")
    seconds = (F.unix_micros("ts") - F.unix_micros("entry.ts")) / 1e6
    return pairs.select(
        *keys, F.row_number().over(order).alias("position_no"), F.col("entry.ts").alias("entry_timestamp"), F.col("ts").alias("exit_timestamp"), F.col("entry.price").alias("entry_price"), F.col("price").alias("exit_price"),
        F.col("entry.quantity").alias("quantity"), F.col("entry.value").alias("entry_value"), F.col("value").alias("exit_value"), pnl.alias("pnl"), F.coalesce(F.try_divide(pnl, F.col("entry.value")) * 100, F.lit(0.0)).alias("pnl_pct"),
        (seconds / 86400).alias("duration_days"), (seconds / 3600).alias("duration_hours"), (pnl > 0).alias("is_win"))


def pnl_statistics(pnl: Column) -> dict[str, Column]:
    """Profit factor (infinite without losses, 0 without anything) and win and loss figures, as aggregates."""
    win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, -pnl)
    gain, lost = F.coalesce(F.sum(win), F.lit(0.0)), F.coalesce(F.sum(loss), F.lit(0.0))
    zero = F.lit(0.0)
    return {
        "profit_factor": F.when(lost > 0, F.try_divide(gain, lost)).when(gain > 0, F.lit(float("inf"))).otherwise(0.0),
        "average_win": F.coalesce(F.avg(win), zero), "average_loss": F.coalesce(F.avg(loss), zero), "largest_win": F.coalesce(F.max(win), zero), "largest_loss": F.coalesce(F.max(loss), zero),
        "num_winning_trades": F.count(win), "num_losing_trades": F.count(loss),
    }


def win_rate(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, pairs, wins, win_rate in percent) by first-in first-out lots.

    The fold has counted the lots of its own sells. Other trades (row_idx, side, price,
    quantity) are streamed through the same lots in order; a run's open lots are all that is held.
    """
    if {"lots_matched", "lots_won"} <= set(trades.columns):
        runs = trades.groupBy(*keys).agg(F.coalesce(F.sum("lots_matched"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("lots_won"), F.lit(0)).alias("wins"))
    else:
        rows = trades.select(*keys, "side", "price", "quantity", F.row_number().over(_order(keys)).alias("lot_place"))
        schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys] + [T.StructField(n, T.LongType()) for n in ("pairs", "wins")])
        arrow = to_arrow_schema(schema, timestamp_utc=True)

        def match(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lots, pairs, wins = Lots(), 0, 0
            for batch in batches:
                for side, price, quantity in zip(*(batch.column(c).to_pylist() for c in ("side", "price", "quantity")), strict=True):
                    if side == "buy":
                        lots.buy(price, quantity)
                    else:
                        matched, won = lots.sell(price, quantity)
                        pairs, wins = pairs + matched, wins + won
            yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], type=arrow.field(n).type) for n, k in zip(keys, key, strict=True)), pa.array([pairs]), pa.array([wins])], schema=arrow)

        runs = rows.groupBy(*keys).applyInArrow(match, schema)
    return runs.withColumn("win_rate", F.coalesce(F.try_divide(F.col("wins") * 100.0, F.col("pairs")), F.lit(0.0)))


def summarize(simulated: DataFrame, keys: tuple[str, ...] = ("symbol",), engine: Engine = Engine(), strategy: str = "Simple MA Strategy") -> DataFrame:  # noqa: B008
    """One row for each run with all its figures; a failed run has its error and nulls.

    The curve's windows, the pairing of trades and the sums share one partitioning by keys.
    """
    order = _order(keys)
    worth = simulated.withColumn("portfolio_value", F.col("cash") + F.col("position") * F.col("close"))
    peak = F.max("portfolio_value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the latest trade before this row; a sell right after a buy closes it
    last = F.last(F.when(F.col("side").isNotNull(), F.struct("side", "value")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = worth.withColumns({"peak": peak, "ret": F.try_divide("portfolio_value", F.lag("portfolio_value").over(order)) - 1, "before": last})
    pnl = F.when((F.col("side") == "sell") & (F.col("before.side") == "buy"), F.col("value") - F.col("before.value"))
    rows = rows.withColumns({"pnl": pnl, "drawdown": (F.col("portfolio_value") - F.col("peak")) / F.col("peak")})
    runs = rows.groupBy(*keys).agg(
        F.min("ts").alias("start_date"), F.max("ts").alias("end_date"), F.max_by("portfolio_value", "row_idx").alias("final_capital"), (F.min("drawdown") * 100).alias("max_drawdown"), sharpe(F.col("ret")).alias("sharpe_ratio"),
        F.count("side").alias("total_trades"), F.count("*").alias("n_bars"), *[c.alias(n) for n, c in pnl_statistics(F.col("pnl")).items()], F.sum("lots_matched").alias("pairs"), F.sum("lots_won").alias("wins"), F.max("error").alias("error"))
    capital = F.lit(float(engine.initial_capital))
    return runs.select(
        *keys, F.lit(strategy).alias("strategy_name"), "start_date", "end_date", capital.alias("initial_capital"), "final_capital", (F.col("final_capital") - capital).alias("total_return"),
        ((F.col("final_capital") - capital) / capital * 100).alias("total_return_pct"), "max_drawdown", "sharpe_ratio", F.coalesce(F.try_divide(F.col("wins"), F.col("pairs")) * 100, F.lit(0.0)).alias("win_rate"), "total_trades",
        "profit_factor", "average_win", "average_loss", "largest_win", "largest_loss", "num_winning_trades", "num_losing_trades", "n_bars", "error")
