"""The portfolio fold: cash, position and stop carried from bar to bar.

``simulate`` streams each run's rows, in order, through a Python generator that holds one
Arrow batch at a time, so a run of any length fits. Its order comes from a window over the
keys, so it shares the exchange of the signals before it where there is one and makes its own
where there isn't; the fold checks it. ``dealt`` spreads runs of few symbols over all tasks.
``trades_sql`` is the same fold without risk management as one JVM expression over the rows
that carry a signal, which has to hold a run's trades in one row. Sums are kept in double and in the engine's
order: whether a full-cash order passes can hang on the last bit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barwright.operators import limits
from barwright.operators.risk import Position, RiskManager
from barwright.operators.signals import Strategy
from barwright.operators.validation import validate_bars

#: Units below which a sell ends the tracking of stop and entry.
CLOSED_UNITS = 0.005
STATE = T.StructType([T.StructField(n, T.StringType() if n in ("side", "reason", "error") else T.IntegerType() if n.startswith("lots") else T.DoubleType()) for n in ("cash", "position", "side", "quantity", "value", "reason", "lots_matched", "lots_won", "error")])
TRADE = "row_idx:int,ts:timestamp,side:string,price:double,quantity:double,value:double"


@dataclass(frozen=True)
class Engine:
    initial_capital: float = 10000.0
    commission: float = 0.001
    min_order_value: float = 1.0

    def __post_init__(self) -> None:
        limits.check(vars(self), limits.ENGINE)

    def bought(self, cash: float, size: float, price: float) -> tuple[float, float] | None:
        """Quantity and value of an accepted buy."""
        value = cash * size / (1 + self.commission)
        return (value / price, value) if value >= self.min_order_value and cash >= value + value * self.commission else None

    def sold(self, position: float, size: float, price: float) -> tuple[float, float] | None:
        quantity = position * size
        value = quantity * price
        return (quantity, value) if value >= self.min_order_value and quantity > 0 else None


class Lots:
    """Bought lots that sells eat, oldest first; every lot a sell touches is a pair, won if the sell's price is higher."""

    def __init__(self) -> None:
        self.open: deque[list[float]] = deque()

    def buy(self, price: float, quantity: float) -> None:
        self.open.append([price, quantity])

    def sell(self, price: float, quantity: float) -> tuple[int, int]:
        """Pairs and wins of a sell."""
        matched = won = 0
        while quantity > 0 and self.open:
            lot = self.open[0]
            matched += 1
            won += price > lot[0]
            if lot[1] <= quantity:
                quantity -= lot[1]
                self.open.popleft()
            else:
                lot[1] -= quantity
                quantity = 0
        return matched, won


class _Run:
    """The state of one run."""

    def __init__(self, engine: Engine, risk: RiskManager | None, symbol: str) -> None:
        self.engine, self.symbol = engine, symbol
        self.risk = risk.fresh() if risk else None
        self.cash, self.position = engine.initial_capital, 0.0
        self.stop: float | None = None
        self.entry: float | None = None
        self.direction = 0
        self.worth: float | None = None
        self.lots = Lots()

    def _forget(self) -> None:
        self.stop = self.entry = None
        self.direction = 0
        if self.risk:
            self.risk.book.pop(self.symbol, None)

    def _note(self, when: Any) -> None:
        """The book keeps units over the worth at the bar before, as the engine does."""
        if self.risk:
            if self.worth is None:
                raise RuntimeError("a risk-managed order on the first bar has no portfolio value to refer to")
            self.risk.book.put(self.symbol, Position(self.position / self.worth if self.worth > 0 else 0.0, self.entry or 0.0, self.stop, when))

    def step(self, when: Any, price: float, signal: int, size: float) -> tuple[str, float, float, str | None, int | None, int | None] | None:
        """One bar; the trade made, if any: side, quantity, value, reason of a stop, lots matched and won."""
        made = self._order(when, price, signal, size)
        if made is None:
            return None
        if made[0] == "buy":
            self.lots.buy(price, made[1])
            return (*made, None, None)
        return (*made, *self.lots.sell(price, made[1]))

    def _order(self, when: Any, price: float, signal: int, size: float) -> tuple[str, float, float, str | None] | None:
        risk, stop = self.risk, None
        if signal and risk:
            worth = self.cash + self.position * price
            decision = risk.evaluate(signal, price, worth, self.position * price / worth if worth > 0 else 0.0)
            signal, size, stop = (signal, decision.size, decision.stop) if decision.allowed else (0, 0.0, None)
        if size < 0 or size > 1:
            raise ValueError(f"Position size must be between 0 and 1, got {size}")
        made = None
        if risk and self.position != 0 and self.stop is not None:
            entry = self.entry or 0.0
            hit, reason = risk.closes(price, entry, self.stop, self.direction, (price - entry) * self.position * self.direction)
            if hit and (sale := self.engine.sold(self.position, 1.0, price)):
                self.cash += sale[1] - sale[1] * self.engine.commission
                self.position = 0.0
                self._forget()
                made = ("sell", *sale, reason)
        if made is None and signal == 1 and self.cash > 0:
            if order := self.engine.bought(self.cash, size, price):
                self.cash -= order[1] + order[1] * self.engine.commission
                self.position += order[0]
                self.entry, self.stop, self.direction = price, stop, 1
                self._note(when)
                made = ("buy", *order, None)
        elif made is None and signal == -1 and self.position > 0:
            if sale := self.engine.sold(self.position, size, price):
                self.cash += sale[1] - sale[1] * self.engine.commission
                self.position -= sale[0]
                if abs(self.position) < CLOSED_UNITS:
                    self._forget()
                else:
                    self._note(when)
                made = ("sell", *sale, None)
        self.worth = self.cash + self.position * price
        return made


def dealt(runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of runs dealt by all their keys, so that the runs of one symbol don't share its task.

    The number of tasks is given, as the fold takes far longer than its bytes suggest to AQE.
    """
    return runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def simulate(signals: DataFrame, keys: tuple[str, ...] = ("symbol",), engine: Engine = Engine(), risk: RiskManager | None = None) -> DataFrame:  # noqa: B008
    """Each bar of each run with cash and position after it and the trade made at it.

    ``signals``, in any order and partitioning, has the keys, row_idx, ts, close, signal and
    position_size; bars of a run go by row_idx. A run that fails ends with a row whose
    ``error`` says why; other runs go on. A null signal is none, a null size is 1.
    """
    columns = [*keys, "row_idx", "ts", "close"]
    # a window, not a sort: it brings the exchange and the order that it needs, wherever the rows come from
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx"))
    rows = signals.select(*columns, "signal", "position_size", place.alias("fold_place"))
    schema = T.StructType([rows.schema[c] for c in columns] + STATE.fields)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    arrow = to_arrow_schema(schema, timestamp_utc=True)
    names = [f.name for f in STATE.fields]
    none = (None,) * (len(names) - 3)

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(engine, risk, str(key[keys.index("symbol")].as_py()) if "symbol" in keys else "UNKNOWN")
        step, seen = run.step, 0
        for batch in batches:
            if (np.asarray(batch.column("fold_place")) != np.arange(seen + 1, seen + 1 + batch.num_rows)).any():
                raise RuntimeError(f"bars of run {[k.as_py() for k in key]} came out of order")
            seen += batch.num_rows
            out: list[tuple] = []
            error = None
            whens = batch.column("ts").to_pylist() if risk else [None] * batch.num_rows
            for when, price, signal, size in zip(whens, batch.column("close").to_pylist(), batch.column("signal").to_pylist(), batch.column("position_size").to_pylist(), strict=True):
                try:
                    made = step(when, price, signal or 0, 1.0 if size is None else size)
                except Exception as e:  # noqa: BLE001  a failing run is a row, not a failed job
                    error = f"{type(e).__name__}: {e}"
                    out.append((None, None, *none, error))
                    break
                out.append((run.cash, run.position, *(made or none), None))
            state = [list(c) for c in zip(*out, strict=True)]
            kept = batch.slice(0, len(out))
            yield pa.RecordBatch.from_arrays([*(kept.column(c).cast(arrow.field(c).type) for c in columns), *(pa.array(v, type=arrow.field(n).type) for n, v in zip(names, state, strict=True))], schema=arrow)
            if error:
                return

    return rows.groupBy(*keys).applyInArrow(fold, schema)


#: Events of a run that ``trades_sql`` folds at a time; its lists grow by these, not by single trades.
PIECE = 512


def trades_sql(signals: DataFrame, keys: tuple[str, ...] = ("symbol",), engine: Engine = Engine()) -> DataFrame:  # noqa: B008
    """Trades of runs without risk management, folded in the JVM over the rows with a signal only."""
    event = F.struct("row_idx", "ts", "close", F.col("signal").alias("signal"), "position_size")
    runs = signals.where("signal <> 0").groupBy(*keys).agg(F.sort_array(F.collect_list(event)).alias("events"))
    commission, least = F.lit(float(engine.commission)), F.lit(float(engine.min_order_value))
    kind = f"array<struct<{TRADE},cash:double,position:double>>"
    start = F.struct(F.lit(float(engine.initial_capital)).alias("cash"), F.lit(0.0).alias("position"), F.array().cast(f"array<{kind}>").alias("pieces"))

    def traded(e: Column, side: str, quantity: Column, value: Column, cash: Column, position: Column) -> Column:
        return F.struct(e["row_idx"].alias("row_idx"), e["ts"].alias("ts"), F.lit(side).alias("side"), e["close"].alias("price"), quantity.alias("quantity"), value.alias("value"), cash.alias("cash"), position.alias("position"))

    def step(a: Column, e: Column) -> Column:
        value = a["cash"] * e["position_size"] / (F.lit(1) + commission)
        buys = (e["signal"] == 1) & (a["cash"] > 0) & (value >= least) & (a["cash"] >= value + value * commission)
        quantity = a["position"] * e["position_size"]
        proceeds = quantity * e["close"]
        sells = (e["signal"] == -1) & (a["position"] > 0) & (proceeds >= least) & (quantity > 0)
        cash = F.when(buys, a["cash"] - (value + value * commission)).when(sells, a["cash"] + (proceeds - proceeds * commission)).otherwise(a["cash"])
        position = F.when(buys, a["position"] + value / e["close"]).when(sells, a["position"] - quantity).otherwise(a["position"])
        more = F.when(buys, F.array(traded(e, "buy", value / e["close"], value, cash, position))).when(sells, F.array(traded(e, "sell", quantity, proceeds, cash, position)))
        return F.struct(cash.alias("cash"), position.alias("position"), F.coalesce(F.concat(a["trades"], more), a["trades"]).alias("trades"))

    def piece(a: Column, events: Column) -> Column:
        begin = F.struct(a["cash"].alias("cash"), a["position"].alias("position"), F.array().cast(kind).alias("trades"))
        done = F.aggregate(events, begin, step)
        return F.struct(done["cash"].alias("cash"), done["position"].alias("position"), F.concat(a["pieces"], F.array(done["trades"])).alias("pieces"))

    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"(size(events) - 1) DIV {PIECE}").cast("int")), lambda i: F.slice("events", i * PIECE + 1, F.lit(PIECE)))
    folded = runs.select(*keys, F.explode(F.flatten(F.aggregate(pieces, start, piece)["pieces"])).alias("t"))
    return folded.select(*keys, "t.*")


def trades(simulated: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The bars at which a trade was made."""
    return simulated.where("side IS NOT NULL").select(*keys, "row_idx", "ts", "side", F.col("close").alias("price"), "quantity", "value", "cash", "position", "reason", "lots_matched", "lots_won")


def run_backtest(bars: DataFrame, strategy: Strategy, engine: Engine = Engine(), keys: tuple[str, ...] = ("symbol",), check: bool = True) -> DataFrame:  # noqa: B008
    """Validate, signal and simulate; metrics come from ``barwright.functions.metrics``."""
    if check:
        validate_bars(bars, strategy)
    return simulate(strategy.signals(bars, keys), keys, engine, strategy.risk)
