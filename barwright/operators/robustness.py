"""Walk-forward windows and block-bootstrap Monte Carlo, each one job over all symbols."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.metrics import summarize
from barwright.operators.fold import Engine, dealt, simulate
from barwright.operators.signals import Strategy, in_order

LEAST_PERIOD_ROWS = 30
LEAST_SAMPLE_ROWS = 50
#: The multipliers of the reproducible start indices.
LCG = (1103515245, 12345, 2531011)


def walk_forward_periods(bars: DataFrame, window_months: int = 6, step_months: int = 3) -> DataFrame:
    """(symbol, period, test_start, test_end, n_rows), periods from 1.

    Starts move on by adding months to the last start, so a clipped day stays clipped; a
    period counts if it ends by the last bar and holds thirty bars.
    """
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    months = F.ceil(F.months_between("last", "first") / step_months) + 2
    starts = F.aggregate(F.sequence(F.lit(1), months.cast("int")), F.array(F.col("first")), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) + F.make_ym_interval(F.lit(0), F.lit(step_months)))))
    periods = ends.select("symbol", "last", F.explode(starts).alias("test_start")).withColumn("test_end", F.col("test_start") + F.make_ym_interval(F.lit(0), F.lit(window_months))).where("test_end <= last")
    held = bars.select("symbol", "ts").join(periods.select("symbol", "test_start", "test_end"), "symbol").where("ts >= test_start AND ts < test_end")
    counted = held.groupBy("symbol", "test_start", "test_end").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= LEAST_PERIOD_ROWS)
    return counted.withColumn("period", F.row_number().over(Window.partitionBy("symbol").orderBy("test_start"))).select("symbol", "period", "test_start", "test_end", "n_rows")


def walk_forward_bars(bars: DataFrame, periods: DataFrame) -> DataFrame:
    """Each period's bars, dealt by symbol and period; a bar is in as many periods as overlap it."""
    held = bars.join(periods.select("symbol", "period", "test_start", "test_end"), "symbol").where("ts >= test_start AND ts < test_end").drop("test_start", "test_end")
    return dealt(held, ("symbol", "period"))


def walk_forward(bars: DataFrame, strategy: Strategy, engine: Engine = Engine(), window_months: int = 6, step_months: int = 3) -> DataFrame:  # noqa: B008
    """A result row for each symbol and period; indicators start anew in each."""
    periods = walk_forward_periods(bars, window_months, step_months)
    keys = ("symbol", "period")
    results = summarize(simulate(strategy.signals(walk_forward_bars(bars, periods), keys), keys, engine, strategy.risk), keys, engine, strategy.name).where("error IS NULL")
    return results.join(periods.select("symbol", "period", "test_start", "test_end", F.col("n_rows").alias("test_data_points")), list(keys))


def sample_plan(bars: DataFrame, simulations: int = 1000, share: float = 0.8, block_rows: int = 30, seed: int = 42) -> DataFrame:
    """(symbol, sim, block_no, start_idx, block_rows, n_samples) by a linear congruence, the same in any engine.

    A block as long as a symbol's series or longer becomes a quarter of it.
    """
    sizes = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    fitted = F.when(F.col("n") > block_rows, F.lit(block_rows).cast("long")).otherwise(F.greatest(F.expr("n DIV 4"), F.lit(1)))
    sizes = sizes.withColumn("block_rows", fitted).withColumn("n_samples", F.floor(F.col("n") * share))
    blocks = F.greatest(F.expr("n_samples DIV block_rows"), F.lit(1)).cast("int")
    plan = sizes.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).withColumn("block_no", F.explode(F.sequence(F.lit(0), blocks - 1)))
    a, b, c = LCG
    drawn = (F.col("sim").cast("long") * a + F.col("block_no").cast("long") * c + seed * b) % 2147483648
    return plan.select("symbol", "sim", "block_no", (drawn % (F.col("n") - F.col("block_rows") + 1)).alias("start_idx"), "block_rows", "n_samples")


def sample_plan_random(bars: DataFrame, symbol: str, simulations: int, share: float = 0.8, block_rows: int = 30, seed: int | None = None) -> DataFrame:
    """The plan of one symbol from Python's generator in sequential order: as many numbers as blocks, made on the driver."""
    n = bars.where(F.col("symbol") == symbol).count()
    block, samples = block_rows if n > block_rows else max(1, n // 4), int(n * share)
    rng = random.Random(seed)
    rows = [(symbol, sim, k, rng.randint(0, n - block), block, samples) for sim in range(simulations) for k in range(max(1, samples // block))]
    return bars.sparkSession.createDataFrame(rows, "symbol string, sim int, block_no int, start_idx long, block_rows int, n_samples long")


def samples(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """Bars of each simulation, with block_no and block_row, by an equi-join on row numbers."""
    numbered = bars.select("symbol", "ts", "close", (F.row_number().over(in_order(bars, ("symbol",))) - 1).cast("long").alias("bar_no"))
    wanted = plan.withColumn("block_row", F.explode(F.sequence(F.lit(0), F.col("block_rows").cast("int") - 1)))
    wanted = wanted.where(F.col("block_no") * F.col("block_rows") + F.col("block_row") < F.col("n_samples")).withColumn("bar_no", F.col("start_idx") + F.col("block_row"))
    return dealt(wanted.select("symbol", "sim", "block_no", "block_row", "bar_no").join(numbered, ["symbol", "bar_no"]), ("symbol", "sim"))


def plain_samples(bars: DataFrame, simulations: int, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Samples without blocks, for series shorter than one: the rows whose hashes are lowest, as (symbol, sim, ts, close)."""
    drawn = bars.select("symbol", "ts", "close").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    order = Window.partitionBy("symbol", "sim").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sim").cast("string"), F.unix_micros("ts").cast("string"))), "ts")
    total = F.count("*").over(Window.partitionBy("symbol", "sim"))
    return drawn.withColumns({"_n": F.row_number().over(order), "_of": total}).where(F.col("_n") <= F.floor(F.col("_of") * share)).drop("_n", "_of")


def drawn_bars(bars: DataFrame, simulations: int = 1000, share: float = 0.8, block_rows: int = 30, seed: int = 42, whole_blocks: bool = False) -> DataFrame:
    """(symbol, sim, block_no, block_row, ts, close) of all simulations.

    With ``whole_blocks`` blocks aren't shortened: symbols with fewer bars than a block are
    sampled by single rows instead.
    """
    if not whole_blocks:
        return samples(bars, sample_plan(bars, simulations, share, block_rows, seed))
    sizes = bars.groupBy("symbol").agg((F.count("*") < block_rows).alias("brief"))
    brief, long = (bars.join(sizes.where(c).select("symbol"), "symbol", "left_semi") for c in ("brief", "NOT brief"))
    blocks = samples(long, sample_plan(long, simulations, share, block_rows, seed)).select("symbol", "sim", "block_no", "block_row", "ts", "close")
    singles = plain_samples(brief, simulations, share, seed).withColumns({"block_no": F.lit(0), "block_row": F.lit(0)})
    return dealt(blocks.unionByName(singles), ("symbol", "sim"))


def monte_carlo(bars: DataFrame, strategy: Strategy, engine: Engine = Engine(), simulations: int = 1000, share: float = 0.8, block_rows: int = 30, seed: int = 42, plan: DataFrame | None = None, whole_blocks: bool = False) -> DataFrame:  # noqa: B008
    """A result row for each symbol and simulation; samples under fifty bars are left out."""
    keys = ("symbol", "sim")
    drawn = drawn_bars(bars, simulations, share, block_rows, seed, whole_blocks) if plan is None else samples(bars, plan)
    simulated = simulate(strategy.signals(drawn, keys), keys, engine, strategy.risk)
    return summarize(simulated, keys, engine, strategy.name).where(F.col("error").isNull() & (F.col("n_bars") >= LEAST_SAMPLE_ROWS))
