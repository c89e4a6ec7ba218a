"""Parameter search: spaces, grid and random combinations as tables, evaluation as one job, ranking."""

from __future__ import annotations

import logging
import random
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import inf, prod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions.metrics import summarize
from barwright.operators.fold import Engine, dealt, simulate
from barwright.operators.signals import crossing, in_order, rolling_mean
from barwright.sources.bars import VALUES

#: Metrics to rank by: column, and whether more is better. The worst drawdown is the lowest, and ranks first.
METRICS: dict[str, tuple[str, bool]] = {"total_return": ("total_return_pct", True), "sharpe_ratio": ("sharpe_ratio", True), "max_drawdown": ("max_drawdown", False), "win_rate": ("win_rate", True), "total_trades": ("total_trades", True)}
GRID_WARNING = 1_000_000
#: Combinations that may be broadcast; more are joined by slots of this many.
BROADCAST_COMBOS = 100_000
#: Draws for each combination wanted, draws before repeats count, and the share of repeats that ends drawing.
DRAWS, LEAST_DRAWS, REPEATS = 10, 100, 0.8


@dataclass(frozen=True)
class Parameter:
    """A line of equal steps from ``low``, or choices.

    Values, their number and what a random draw may give are all read off that line: value k
    is ``low + k * step`` in decimals. Drawn ints ignore the step, drawn floats with a step
    are multiples of it from 0, so they may lie below ``low``.
    """

    kind: str
    low: Any = None
    high: Any = None
    step: Any = None
    choices: tuple[Any, ...] = ()

    def line(self, drawn: bool = False) -> tuple[Decimal, Decimal, int]:
        """First value, step and number of values."""
        low, high = Decimal(str(self.low)), Decimal(str(self.high))
        step = Decimal(str(self.step or (1 if self.kind == "int" else 0.1)))
        if self.kind == "int":
            step = Decimal(1) if drawn else step
            return low, step, int((high - low) // step) + 1
        # multiples of the step count as drawn and as combinations
        return (low // step * step, step, int(high // step - low // step) + 1) if drawn else (low, step, int((high - low) // step) + 1)

    def values(self) -> list[Any]:
        if self.kind == "choice":
            return list(self.choices)
        first, step, n = self.line()
        return [(int if self.kind == "int" else float)(first + k * step) for k in range(n)]

    def continuous(self) -> bool:
        return self.kind == "float" and self.step is None

    def count(self) -> float:
        if self.kind == "choice":
            return len(self.choices)
        return inf if self.continuous() else self.line(drawn=self.kind == "float")[2]

    def on_grid(self) -> int:
        return len(self.choices) if self.kind == "choice" else self.line()[2]

    def at(self, place: Column, drawn: bool = False) -> Column:
        """The value at a place of the line, as an expression."""
        if self.kind == "choice":
            return F.element_at(F.array(*map(F.lit, self.choices)), (place + 1).cast("int"))
        first, step, _ = self.line(drawn)
        return (F.lit(first) + place.cast("decimal(18,0)") * F.lit(step)).cast("int" if self.kind == "int" else "double")

    def drawn(self, unit: Column) -> Column:
        """The value that a number from 0 up to 1 draws."""
        if self.continuous():
            return F.lit(float(self.low)) + unit * float(self.high - self.low)
        n = len(self.choices) if self.kind == "choice" else self.line(drawn=True)[2]
        return self.at(F.floor(unit * n), drawn=True)


class ParameterSpace:
    """Named parameters from {type, min, max, step} or {type: choice, choices}."""

    def __init__(self, parameters: dict[str, dict[str, Any]]) -> None:
        self.parameters: dict[str, Parameter] = {}
        for name, p in parameters.items():
            for complaint in self.complaints(name, p):
                raise ValueError(complaint)
            self.parameters[name] = Parameter(p["type"], p.get("min"), p.get("max"), p.get("step"), tuple(p.get("choices", ())))

    @staticmethod
    def complaints(name: str, p: dict[str, Any]) -> Iterator[str]:
        kind, who = p.get("type"), f"Parameter '{name}'"
        if kind not in ("int", "float", "choice"):
            yield f"{who} missing 'type'" if kind is None else f"{who} has unknown type '{kind}'"
        elif kind == "choice":
            if not p.get("choices"):
                yield f"{who} choices cannot be empty" if "choices" in p else f"{who} missing 'choices'"
        elif not {"min", "max"} <= p.keys():
            yield f"{who} missing 'min' or 'max'"
        elif p["min"] >= p["max"]:
            yield f"{who} min must be less than max"

    def size(self) -> float:
        return prod(p.count() for p in self.parameters.values())

    def grid(self, spark: SparkSession) -> DataFrame:
        """(combo_id, parameters): all combinations, the last parameter fastest, worked out from their numbers by each task."""
        if any(p.continuous() for p in self.parameters.values()):
            raise ValueError("Grid search needs a step for every float parameter")
        sizes = [p.on_grid() for p in self.parameters.values()]
        if prod(sizes) > GRID_WARNING:
            logging.warning("the grid has %s combinations", prod(sizes))
        rows = spark.range(prod(sizes))
        place = lambda k: F.expr(f"(id DIV {prod(sizes[k + 1 :])}) % {sizes[k]}")
        return rows.select(F.col("id").alias("combo_id"), *[p.at(place(k)).alias(name) for k, (name, p) in enumerate(self.parameters.items())])

    def random(self, spark: SparkSession, n: int, seed: int | str | None = None) -> DataFrame:
        """(combo_id, parameters): up to n different combinations, the first ones of at most 10 n draws.

        Draw d of a parameter is the hash of seed, d and the parameter's name, so any engine
        and any partitioning draw alike. Drawing ends early once, after 100 draws, more than
        0.8 of them repeat. Draws are as many as asked for, not as the data, so their running
        count may be one window.
        """
        seed = random.randrange(1 << 31) if seed is None else seed
        unit = lambda name: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.lit(name))), 1, 13), 16, 10).cast("double") / float(1 << 52)
        names = list(self.parameters)
        draws = spark.range(DRAWS * n).select("id", *[p.drawn(unit(name)).alias(name) for name, p in self.parameters.items()])
        draws = draws.withColumn("fresh", F.row_number().over(Window.partitionBy(*names).orderBy("id")) == 1)
        line = Window.partitionBy(F.lit(0)).orderBy("id")
        draws = draws.withColumn("found", F.sum(F.col("fresh").cast("long")).over(line))
        made = F.col("id") + 1
        draws = draws.withColumn("over", F.max((made > LEAST_DRAWS) & (made - F.col("found") > REPEATS * made)).over(line.rowsBetween(Window.unboundedPreceding, -1)))
        return draws.where(F.col("fresh") & (F.col("found") <= n) & ~F.coalesce("over", F.lit(False))).select((F.col("found") - 1).alias("combo_id"), *names)

    def suggested_samples(self) -> int:
        return 10_000 if self.size() == inf else min(10_000, max(10, int(0.1 * self.size())))


#: The built-in space of the crossover strategy.
MA_SPACE = ParameterSpace({"short_window": {"type": "int", "min": 5, "max": 20, "step": 1}, "long_window": {"type": "int", "min": 20, "max": 100, "step": 5}, "position_size": {"type": "float", "min": 0.5, "max": 1.0, "step": 0.1}})


def combo_table(spark: SparkSession, combos: list[dict[str, Any]]) -> DataFrame:
    """(combo_id, parameters) of combinations given one by one."""
    rows = [(n, int(c["short_window"]), int(c["long_window"]), float(c.get("position_size", 1.0))) for n, c in enumerate(combos)]
    return spark.createDataFrame(rows, "combo_id long, short_window int, long_window int, position_size double")


def _met(bars: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Each bar with each combination: by a broadcast, or slot by slot where combinations are too many for one."""
    if n <= BROADCAST_COMBOS:
        return bars.join(F.broadcast(table))
    slots, salts = -(-n // BROADCAST_COMBOS), int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = table.withColumns({"slot": F.pmod(F.col("combo_id"), F.lit(slots)).cast("int"), "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    spread = bars.withColumns({"salt": F.pmod(F.xxhash64("symbol", "row_idx"), F.lit(salts)).cast("int"), "slot": F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))})
    return spread.join(sides, ["slot", "salt"]).drop("slot", "salt")


def combo_signals(bars: DataFrame, combos: DataFrame) -> DataFrame:
    """Signals of every combination on every bar, keyed (combo_id, symbol).

    Each distinct window's mean is worked out once, before the bars meet the combinations;
    window lengths are as few as the parameters' values. Combinations whose windows are out
    of order have no strategy.
    """
    size = F.col("position_size").cast("double") if "position_size" in combos.columns else F.lit(1.0)
    table = combos.select(F.col("combo_id").cast("long").alias("combo_id"), "short_window", "long_window", size.alias("position_size"))
    table = table.where("short_window > 0 AND short_window < long_window AND position_size > 0 AND position_size <= 1")
    n, *found = table.agg(F.count("*"), F.collect_set("short_window"), F.collect_set("long_window")).first()
    windows = sorted({w for f in found for w in f}) or [1]
    held = F.array(*map(F.lit, windows))
    table = table.withColumns({"s": F.array_position(held, F.col("short_window")).cast("int"), "l": F.array_position(held, F.col("long_window")).cast("int")})
    order = in_order(bars, ("symbol",))
    ties = [c for c in ("seq", "block_no", "block_row") if c in bars.columns]
    means = bars.select("symbol", "ts", "close", *ties, (F.row_number().over(order) - 1).alias("row_idx"), F.array(*[rolling_mean("close", w, order) for w in windows]).alias("now"))
    means = means.withColumn("before", F.lag("now").over(order)).drop(*ties)
    at = lambda c, k: F.element_at(c, F.col(k))
    return _met(means, table, n).select("combo_id", "symbol", "short_window", "long_window", "position_size", "ts", "close", "row_idx", crossing(at("now", "s"), at("now", "l"), at("before", "s"), at("before", "l")).alias("signal"))


RUN = ("combo_id", "symbol", "short_window", "long_window", "size")


def combo_runs(bars: DataFrame, combos: DataFrame, engine: Engine = Engine()) -> DataFrame:  # noqa: B008
    """Each bar of each combination's run, by RUN; runs are dealt by combination and symbol."""
    signals = dealt(combo_signals(bars, combos), ("combo_id", "symbol")).withColumn("size", F.col("position_size"))
    return simulate(signals, RUN, engine)


def evaluate(bars: DataFrame, combos: DataFrame | list[dict[str, Any]], engine: Engine = Engine()) -> DataFrame:  # noqa: B008
    """A result row for each combination and symbol; failed runs are left out."""
    combos = combo_table(bars.sparkSession, combos) if isinstance(combos, list) else combos
    results = summarize(combo_runs(bars, combos, engine), RUN, engine).where("error IS NULL")
    return results.withColumnRenamed("size", "position_size")


def ranked(results: DataFrame, sort_by: str = "total_return", top: int | None = None) -> DataFrame:
    """Results by a metric, ties by combination; with ``top`` Spark keeps that many rows a task."""
    if sort_by not in METRICS:
        logging.warning("unknown metric %r, using total_return", sort_by)
    column, more = METRICS.get(sort_by, METRICS["total_return"])
    order: Column = F.desc_nulls_last(column) if more else F.asc_nulls_last(column)
    out = results.orderBy(order, *(c for c in ("combo_id", "symbol") if c in results.columns))
    return out.limit(top) if top else out


def best_by_metric(results: DataFrame, *by: str) -> DataFrame:
    """(by, metric, value, combo_id): the first combination at each metric's best."""
    picks = []
    for name, (column, more) in METRICS.items():
        pair = F.struct(F.col(column).cast("double").alias("value"), (-F.col("combo_id") if more else F.col("combo_id")).alias("n"))
        picks.append((F.max(pair) if more else F.min(pair)).alias(name))
    rows = results.groupBy(*by).agg(*picks)
    each = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name)["value"].alias("value"), F.abs(F.col(name)["n"]).alias("combo_id")) for name in METRICS])
    return rows.select(*by, F.explode(each).alias("e")).select(*by, "e.metric", "e.value", "e.combo_id")


@dataclass(frozen=True)
class SearchResult:
    """A combination with its result row, for callers that want objects."""

    parameters: dict[str, Any]
    result: Any

    def __post_init__(self) -> None:
        if not isinstance(self.parameters, dict):
            raise ValueError("Parameters must be a dictionary")
        if self.result is None:
            raise ValueError("A result is needed")


def as_objects(ranked_results: DataFrame, names: tuple[str, ...] = ("short_window", "long_window", "position_size")) -> Iterator[SearchResult]:
    """Rows of a ranked table one by one, streamed to the driver."""
    for row in ranked_results.toLocalIterator():
        yield SearchResult({n: row[n] for n in names}, row)


class Optimizer(ABC):
    """Combinations of a space, evaluated on bars and ranked."""

    def __init__(self, bars: DataFrame, space: ParameterSpace, engine: Engine = Engine(), sort_by: str = "total_return") -> None:  # noqa: B008
        if sort_by not in METRICS:
            raise ValueError(f"sort_by must be one of {sorted(METRICS)}")
        missing = [c for c in VALUES if c not in bars.columns]
        if missing:
            raise ValueError(f"Missing required columns: {missing}")
        self.bars, self.space, self.engine, self.sort_by = bars, space, engine, sort_by
        self.tag = f"search-{uuid.uuid4().hex}"

    @abstractmethod
    def combos(self) -> DataFrame: ...

    def optimize(self, top: int | None = None) -> DataFrame:
        return ranked(evaluate(self.bars, self.combos(), self.engine), self.sort_by, top)

    def best(self, top: int = 10) -> list[SearchResult]:
        """The best results, worked out under this search's tag, so that ``stop`` can cancel it."""
        spark = self.bars.sparkSession
        spark.addTag(self.tag)
        try:
            return list(as_objects(self.optimize(top), tuple(self.space.parameters)))
        finally:
            spark.removeTag(self.tag)

    def stop(self) -> None:
        """Cancel this search's jobs, and no one else's."""
        self.bars.sparkSession.interruptTag(self.tag)


class GridSearch(Optimizer):
    def combos(self) -> DataFrame:
        return self.space.grid(self.bars.sparkSession)


class RandomSearch(Optimizer):
    def __init__(self, *args: Any, n_trials: int | None = None, seed: int | None = None, **kwargs: Any) -> None:
        super().__init__(*args, **kwargs)
        self.n_trials, self.seed = n_trials, random.randrange(1 << 31) if seed is None else seed

    def combos(self) -> DataFrame:
        return self.space.random(self.bars.sparkSession, self.n_trials or self.space.suggested_samples(), self.seed)


OPTIMIZERS: dict[str, type[Optimizer]] = {"grid": GridSearch, "random": RandomSearch}
SPACES: dict[str, ParameterSpace] = {"simple_ma": MA_SPACE}


def create_optimizer(method: str, bars: DataFrame, space: ParameterSpace, **settings: Any) -> Optimizer:
    if method not in OPTIMIZERS:
        raise ValueError(f"Unknown optimizer '{method}'; there are {sorted(OPTIMIZERS)}")
    return OPTIMIZERS[method](bars, space, **settings)
