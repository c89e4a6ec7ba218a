"""Strategies: from bars to signals in {-1, 0, 1} and position sizes."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barwright.operators import limits
from barwright.sources.bars import VALUES

if TYPE_CHECKING:
    from barwright.operators.risk import RiskManager


def in_order(df: DataFrame, keys: tuple[str, ...]) -> WindowSpec:
    """The window of a run: its rows by time, ties by the columns that say which came first."""
    return Window.partitionBy(*keys).orderBy("ts", *(c for c in ("seq", "block_no", "block_row") if c in df.columns))


def rolling_mean(column: str, rows: int, order: WindowSpec) -> Column:
    """Mean of the last ``rows`` values; null until there are so many."""
    frame = order.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(frame) >= rows, F.avg(column).over(frame))


def crossing(short: Column, long: Column, short_before: Column, long_before: Column) -> Column:
    """1 where short rises above long, -1 where it falls below; touching first counts, nulls don't cross."""
    up = (short > long) & (short_before <= long_before)
    down = (short < long) & (short_before >= long_before)
    return F.when(up, 1).when(down, -1).otherwise(0)


class Strategy(ABC):
    """``signals`` adds signal, position_size and row_idx (from 0 in each run) to the bars of each run."""

    name = "Strategy"
    risk: RiskManager | None = None

    @abstractmethod
    def signals(self, bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame: ...

    @abstractmethod
    def description(self) -> str: ...

    @staticmethod
    def accepts(bars: DataFrame) -> bool:
        return {"ts", *VALUES} <= set(bars.columns)


@dataclass
class MaCrossover(Strategy):
    short_window: int = 10
    long_window: int = 30
    position_size: float = 1.0
    risk: RiskManager | None = None
    name: str = field(default="Simple MA Strategy", init=False)

    def __post_init__(self) -> None:
        limits.check(vars(self), limits.CROSSOVER)

    def signals(self, bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
        order = in_order(bars, keys)
        means = bars.withColumns({"ma_short": rolling_mean("close", self.short_window, order), "ma_long": rolling_mean("close", self.long_window, order), "row_idx": F.row_number().over(order) - 1})
        signal = crossing(F.col("ma_short"), F.col("ma_long"), F.lag("ma_short").over(order), F.lag("ma_long").over(order))
        return means.withColumns({"signal": signal, "position_size": F.lit(float(self.position_size))})

    def description(self) -> str:
        return f"Moving average crossover of {self.short_window} and {self.long_window} bars at position size {self.position_size:.2f}"


@dataclass
class GivenSignals(Strategy):
    """Signals that are columns of the bars already."""

    risk: RiskManager | None = None
    name: str = field(default="Given signals", init=False)

    def signals(self, bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
        size = F.col("position_size") if "position_size" in bars.columns else F.lit(1.0)
        return bars.withColumns({"row_idx": F.row_number().over(in_order(bars, keys)) - 1, "signal": F.coalesce(F.col("signal"), F.lit(0)).cast("int"), "position_size": size.cast("double")})

    def description(self) -> str:
        return "Signals given with the bars"


STRATEGIES: dict[str, type[Strategy]] = {"simple_ma": MaCrossover}
