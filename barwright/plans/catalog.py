"""Registered queries over the driver's tables, each with its DuckDB oracle where SQL can tell.

Times come out as text and doubles rounded to six places, so both engines compare alike; an
infinite profit factor comes out as null.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions import metrics as M
from barwright.functions import stats as S
from barwright.operators import limits
from barwright.operators import robustness as R
from barwright.operators import validation as V
from barwright.operators.cleaning import FillNulls, GapReport, InfiniteToNull, OhlcRules, QualityRules, default_cleaner
from barwright.operators.fold import Engine, simulate, trades, trades_sql
from barwright.operators.risk import FixedRisk, book_summary
from barwright.operators.search import MA_SPACE, ParameterSpace, best_by_metric, create_optimizer, evaluate, ranked
from barwright.operators.signals import MaCrossover
from barwright.operators.validation import between, violations
from barwright.plans import sql as Q
from barwright.session import cut, discard, scratch
from barwright.sources import files, sinks
from barwright.sources.bars import VALUES, dirty_bars, events_bars, orders_bars
from barwright.sources.remote import ExchangeSource, QuoteSource

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STRATEGY = MaCrossover(10, 30, 0.2)
ENGINE = Engine()
GRID = ParameterSpace({"short_window": {"type": "int", "min": 5, "max": 7}, "long_window": {"type": "int", "min": 15, "max": 25, "step": 5}, "position_size": {"type": "float", "min": 0.2, "max": 0.5, "step": 0.3}})
RISK = (0.1, 0.05, 5, 0.02)
SIMULATIONS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Times as text, doubles rounded, infinities null, whole numbers long."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.when(F.abs(c) != float("inf"), F.round(c, 6))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        key = name or query.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return tidy(query(spark, sf_dir))

        QUERIES[key] = run
        if oracle:
            ORACLES[key] = oracle
        return query

    return add


# bars

_BAR_COLUMNS = f"symbol, {Q.when('ts')} AS ts, {Q.r6(*VALUES)}"


@register(Q.chain(Q.ORDERS_BARS) + f"SELECT {_BAR_COLUMNS} FROM bars")
def bars_orders(spark, sf_dir):
    return orders_bars(spark, sf_dir)


@register(Q.chain(Q.EVENTS_BARS) + f"SELECT {_BAR_COLUMNS} FROM bars")
def bars_events(spark, sf_dir):
    return events_bars(spark, sf_dir)


@register(Q.chain(Q.ORDERS_BARS) + f"SELECT {_BAR_COLUMNS} FROM bars WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1996-07-01'")
def bars_slice(spark, sf_dir):
    return between(orders_bars(spark, sf_dir), "1996-01-01", "1996-07-01")


# cleaning

_CLEAN = [Q.DIRTY_BARS, Q.INFINITE]
_DIRTY_COLUMNS = f"{_BAR_COLUMNS}, seq"


@register(Q.chain(*_CLEAN) + f"SELECT {_DIRTY_COLUMNS} FROM c1")
def clean_infinite(spark, sf_dir):
    return InfiniteToNull().process(dirty_bars(spark, sf_dir))


@register(Q.chain(*_CLEAN, Q.filled("c1", "c2")) + f"SELECT {_DIRTY_COLUMNS} FROM c2")
def clean_nan_fill(spark, sf_dir):
    return FillNulls().process(InfiniteToNull().process(dirty_bars(spark, sf_dir)))


@register(Q.chain(*_CLEAN, Q.price_rules("c1", "c2")) + f"SELECT {_DIRTY_COLUMNS} FROM c2")
def clean_ohlc(spark, sf_dir):
    return OhlcRules().process(InfiniteToNull().process(dirty_bars(spark, sf_dir)))


@register(Q.chain(*_CLEAN, Q.quality("c1", "c2")) + f"SELECT {_DIRTY_COLUMNS} FROM c2")
def clean_quality(spark, sf_dir):
    return QualityRules().process(InfiniteToNull().process(dirty_bars(spark, sf_dir)))


@register(Q.chain(*_CLEAN, Q.filled("c1", "c2"), Q.price_rules("c2", "c3"), Q.quality("c3", "c4")) + f"SELECT {_DIRTY_COLUMNS} FROM c4")
def clean_pipeline(spark, sf_dir):
    return default_cleaner().run(dirty_bars(spark, sf_dir))


@register(Q.chain(Q.DIRTY_BARS) + "SELECT " + ", ".join(f"count(*) FILTER (WHERE isinf({c})) AS {c}" for c in VALUES) + " FROM dirty")
def infinite_counts(spark, sf_dir):
    return InfiniteToNull().counts(dirty_bars(spark, sf_dir))


@register(Q.chain(Q.DIRTY_BARS) + f"SELECT symbol, count(*) FILTER (WHERE high < low) AS high_below_low, count(*) FILTER (WHERE high < open) AS high_below_open, count(*) FILTER (WHERE high < close) AS high_below_close, count(*) FILTER (WHERE open < low) AS open_below_low, count(*) FILTER (WHERE close < low) AS close_below_low, count(*) FILTER (WHERE {Q.BROKEN}) AS rows_broken FROM dirty GROUP BY symbol")
def ohlc_violation_counts(spark, sf_dir):
    return OhlcRules().counts(dirty_bars(spark, sf_dir), "symbol")


@register(Q.chain(Q.DIRTY_BARS) + "SELECT symbol, count(*) AS n_rows, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS null_{c}, count(*) FILTER (WHERE {c} {'<' if c == 'volume' else '<='} 0) AS bad_{c}" for c in VALUES) + f", count(*) FILTER (WHERE {Q.BROKEN}) AS bad_rules, count(*) FILTER (WHERE back) AS unordered FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) > ts AS back FROM dirty) GROUP BY symbol")
def input_validation(spark, sf_dir):
    return violations(dirty_bars(spark, sf_dir))


_STEPS = "steps AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM bars), usual AS (SELECT symbol, step FROM (SELECT symbol, step, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, step) AS n FROM (SELECT symbol, epoch_us(ts) - epoch_us(before) AS step FROM steps WHERE before IS NOT NULL) GROUP BY symbol, step) WHERE n = 1)"


@register(Q.chain(Q.EVENTS_BARS, _STEPS) + f"SELECT symbol, {Q.when('before')} AS gap_start, {Q.when('ts')} AS gap_end, epoch_us(ts) - epoch_us(before) AS gap_micros FROM steps JOIN usual USING (symbol) WHERE epoch_us(ts) - epoch_us(before) > 1.5 * step")
def time_gaps(spark, sf_dir):
    return GapReport().gaps(events_bars(spark, sf_dir))


@register(Q.chain(Q.EVENTS_BARS, _STEPS) + "SELECT symbol, count(*) AS n, max(step) AS usual_micros, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts)))::DOUBLE / max(step) + 1) * 100, 6) AS completeness FROM steps JOIN usual USING (symbol) GROUP BY symbol")
def completeness(spark, sf_dir):
    return GapReport().completeness(events_bars(spark, sf_dir))


# signals and the fold


def _signals(spark: SparkSession, sf_dir: str, strategy: MaCrossover = STRATEGY) -> DataFrame:
    return strategy.signals(orders_bars(spark, sf_dir))


def _simulated(spark: SparkSession, sf_dir: str, strategy: MaCrossover = STRATEGY) -> DataFrame:
    return simulate(_signals(spark, sf_dir, strategy), engine=ENGINE, risk=strategy.risk)


_SIG = [Q.ORDERS_BARS, Q.signals("symbol", "10", "30", "0.2")]
_TRADED = [*_SIG, Q.fold("symbol")]
_CURVE = [*_TRADED, Q.curve("symbol")]
_RESULTS = [*_CURVE, Q.pairs("symbol"), Q.fifo("symbol"), Q.results("symbol")]
_FIGURES = ("final_capital", "total_return", "total_return_pct", "max_drawdown", "sharpe_ratio", "win_rate", "profit_factor", "average_win", "average_loss", "largest_win", "largest_loss")
_RESULT_COLUMNS = f"{Q.when('start_date')} AS start_date, {Q.when('end_date')} AS end_date, {Q.r6(*_FIGURES)}, total_trades, num_winning_trades, num_losing_trades, n_bars"
_EXTRA = ("reason", "lots_matched", "lots_won")
_TRADE_COLUMNS = f"row_idx, {Q.when('ts')} AS ts, side, {Q.r6('price', 'quantity', 'value', 'cash', 'position')}"


def _results(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "start_date", "end_date", *_FIGURES, "total_trades", "num_winning_trades", "num_losing_trades", "n_bars")


@register(Q.chain(*_SIG) + f"SELECT symbol, {Q.when('ts')} AS ts, row_idx, {Q.r6('close', 'ma_short', 'ma_long', 'position_size')}, signal::BIGINT AS signal FROM sig")
def ma_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("symbol", "ts", "row_idx", "close", "ma_short", "ma_long", "position_size", "signal")


@register(Q.chain(*_TRADED) + f"SELECT symbol, {_TRADE_COLUMNS} FROM trades")
def backtest_trades(spark, sf_dir):
    return trades(_simulated(spark, sf_dir)).drop(*_EXTRA)


@register(Q.chain(*_TRADED) + f"SELECT symbol, {_TRADE_COLUMNS} FROM trades")
def backtest_trades_sql_fold(spark, sf_dir):
    return trades_sql(_signals(spark, sf_dir), engine=ENGINE)


@register(Q.chain(*_TRADED) + f"SELECT symbol, {_TRADE_COLUMNS} FROM trades")
def backtest_trades_stored_signals(spark, sf_dir):
    """Signals that were written and shuffled before: the fold orders them itself."""
    stored = cut(_signals(spark, sf_dir).repartition(7, F.xxhash64("ts")))
    return trades(simulate(stored, engine=ENGINE)).drop(*_EXTRA)


@register(Q.chain(Q.ORDERS_BARS, Q.signals("symbol", "10", "30", "1.0"), Q.fold("symbol", capital="1000.0")) + f"SELECT symbol, {_TRADE_COLUMNS} FROM trades")
def backtest_rounding_trap(spark, sf_dir):
    """A full-cash buy from 1000 fails by a last bit, and nothing is ever traded."""
    return trades(simulate(_signals(spark, sf_dir, MaCrossover(10, 30, 1.0)), engine=Engine(1000.0))).drop(*_EXTRA)


@register(Q.chain(*_CURVE) + f"SELECT symbol, row_idx, {Q.when('ts')} AS ts, {Q.r6('close', 'cash', 'position', 'portfolio_value')} FROM curve")
def backtest_equity(spark, sf_dir):
    return M.equity_curve(_simulated(spark, sf_dir)).select("symbol", "row_idx", "ts", "close", "cash", "position", "portfolio_value")


@register(Q.chain(*_RESULTS) + f"SELECT symbol, {_RESULT_COLUMNS} FROM results")
def backtest_summary(spark, sf_dir):
    return _results(M.summarize(_simulated(spark, sf_dir), engine=ENGINE), "symbol")


@register(Q.chain(Q.ORDERS_BARS, Q.signals("symbol", "10", "30", "1.0"), Q.fold_fixed_risk(*map(str, RISK))) + f"SELECT symbol, {_TRADE_COLUMNS}, stopped FROM trades")
def backtest_fixed_risk(spark, sf_dir):
    done = trades(_simulated(spark, sf_dir, MaCrossover(10, 30, 1.0, risk=FixedRisk(*RISK))))
    return done.withColumn("stopped", F.col("reason").isNotNull()).drop(*_EXTRA)


@register(Q.chain(*_SIG) + f"SELECT symbol, {Q.when('ts')} AS ts, round(want, 6) AS decided_size, round(stop, 6) AS stop_price, round(risk, 6) AS max_risk, ok AS allowed FROM (SELECT symbol, ts, CASE WHEN ok THEN want ELSE 0 END AS want, CASE WHEN ok THEN stop END AS stop, risk, ok FROM (SELECT *, want <= 0.1 AND risk <= 0.02 AND want <= 0.5 AS ok FROM (SELECT *, abs(close - stop) / close * want AS risk FROM (SELECT symbol, ts, close, CASE signal WHEN 1 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS want, CASE signal WHEN 1 THEN close * 0.95::DOUBLE ELSE close * 1.05::DOUBLE END AS stop FROM sig WHERE signal <> 0))))")
def risk_decisions(spark, sf_dir):
    rows = _signals(spark, sf_dir).where("signal <> 0")
    decided = FixedRisk(*RISK).decision_columns(F.col("signal"), F.col("close"), F.lit(0.05), F.lit(0.0), F.lit(0))
    return rows.withColumns(decided).select("symbol", "ts", *decided)


# metrics


@register(Q.chain(*_CURVE) + "SELECT symbol, row_idx, round(ret, 6) AS ret FROM curve")
def returns(spark, sf_dir):
    return M.equity_curve(_simulated(spark, sf_dir)).select("symbol", "row_idx", "ret")


@register(Q.chain(*_CURVE) + "SELECT symbol, row_idx, round(running_peak, 6) AS running_peak, round(drawdown, 6) AS drawdown FROM curve")
def drawdown_curve(spark, sf_dir):
    return M.equity_curve(_simulated(spark, sf_dir)).select("symbol", "row_idx", "running_peak", "drawdown")


_ROLL = "roll AS (SELECT *, count(ret) OVER f AS n, avg(ret) OVER f AS mean, stddev_samp(ret) OVER f AS spread FROM curve WINDOW f AS (PARTITION BY symbol ORDER BY row_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"


@register(Q.chain(*_CURVE, _ROLL) + "SELECT symbol, row_idx, round(CASE WHEN n >= 30 AND spread > 0 THEN mean * 252 / (spread * sqrt(252::DOUBLE)) END, 6) AS rolling_sharpe_30d FROM roll")
def rolling_sharpe_30(spark, sf_dir):
    return M.rolling_statistics(M.equity_curve(_simulated(spark, sf_dir))).select("symbol", "row_idx", "rolling_sharpe_30d")


@register(Q.chain(*_CURVE, _ROLL) + "SELECT symbol, row_idx, round(CASE WHEN n >= 30 THEN spread * sqrt(252::DOUBLE) * 100 END, 6) AS rolling_volatility_30d FROM roll")
def rolling_vol_30(spark, sf_dir):
    return M.rolling_statistics(M.equity_curve(_simulated(spark, sf_dir))).select("symbol", "row_idx", "rolling_volatility_30d")


@register(Q.chain(*_TRADED, Q.pairs("symbol")) + f"SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY row_idx) AS position_no, {Q.when('b_ts')} AS entry_timestamp, {Q.when('ts')} AS exit_timestamp, round(b_price, 6) AS entry_price, round(price, 6) AS exit_price, round(b_quantity, 6) AS quantity, round(b_value, 6) AS entry_value, round(value, 6) AS exit_value, round(pnl, 6) AS pnl, round(pnl / b_value * 100, 6) AS pnl_pct, round((epoch_us(ts) - epoch_us(b_ts)) / 8.64e10, 6) AS duration_days, round((epoch_us(ts) - epoch_us(b_ts)) / 3.6e9, 6) AS duration_hours, pnl > 0 AS is_win FROM pairs")
def positions(spark, sf_dir):
    return M.closed_positions(trades(_simulated(spark, sf_dir)))


@register(Q.chain(*_RESULTS) + f"SELECT symbol, {Q.r6('profit_factor')} FROM results")
def profit_factor(spark, sf_dir):
    found = M.closed_positions(trades(_simulated(spark, sf_dir)))
    return found.groupBy("symbol").agg(M.pnl_statistics(F.col("pnl"))["profit_factor"].alias("profit_factor"))


@register(Q.chain(*_RESULTS) + f"SELECT symbol, {Q.r6('average_win', 'average_loss', 'largest_win', 'largest_loss')}, num_winning_trades, num_losing_trades FROM results")
def trade_stats(spark, sf_dir):
    found = M.closed_positions(trades(_simulated(spark, sf_dir)))
    return found.groupBy("symbol").agg(*[c.alias(n) for n, c in M.pnl_statistics(F.col("pnl")).items() if n != "profit_factor"])


@register(Q.chain(*_TRADED, Q.fifo("symbol")) + "SELECT symbol, pairs, wins, round(100.0::DOUBLE * wins / pairs, 6) AS win_rate FROM fifo")
def win_rate_fifo(spark, sf_dir):
    return M.win_rate(trades(_simulated(spark, sf_dir)))


# search

_COMBOS = ", ".join(f"({n}, {s}, {l}, {p})" for n, (s, l, p) in enumerate(product(*(p.values() for p in GRID.parameters.values()))))
_GRID_MEANS = ", ".join(f"CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS m{n}" for n in (5, 6, 7, 15, 20, 25))
_PICK = lambda c, table: "CASE " + c + " " + " ".join(f"WHEN {n} THEN {table}m{n}" for n in (5, 6, 7, 15, 20, 25)) + " END"
_GRID_SIG = [
    Q.ORDERS_BARS,
    f"combos(combo_id, short_window, long_window, position_size) AS (VALUES {_COMBOS})",
    f"wide AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row_idx, {_GRID_MEANS} FROM bars)",
    f"means AS (SELECT combo_id, short_window, long_window, position_size::DOUBLE AS position_size, symbol, ts, close, row_idx, {_PICK('short_window', '')} AS ma_short, {_PICK('long_window', '')} AS ma_long FROM wide CROSS JOIN combos)",
    "sig AS MATERIALIZED (SELECT *, CASE WHEN ma_short > ma_long AND lag(ma_short) OVER w <= lag(ma_long) OVER w THEN 1 WHEN ma_short < ma_long AND lag(ma_short) OVER w >= lag(ma_long) OVER w THEN -1 ELSE 0 END AS signal FROM means WINDOW w AS (PARTITION BY combo_id, symbol ORDER BY row_idx))",
]
_GRID_KEYS = "combo_id, symbol"
_GRID_RESULTS = [*_GRID_SIG, Q.fold(_GRID_KEYS), Q.curve(_GRID_KEYS), Q.pairs(_GRID_KEYS), Q.fifo(_GRID_KEYS), Q.results(_GRID_KEYS)]


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(orders_bars(spark, sf_dir), GRID.grid(spark), ENGINE)


@register(Q.chain(*_GRID_RESULTS) + f"SELECT combo_id::BIGINT AS combo_id, symbol, {_RESULT_COLUMNS} FROM results")
def grid_results(spark, sf_dir):
    return _results(_grid(spark, sf_dir), "combo_id", "symbol")


@register(Q.chain(*_GRID_RESULTS) + f"SELECT combo_id::BIGINT AS combo_id, symbol, {_RESULT_COLUMNS} FROM results ORDER BY results.total_return_pct DESC, combo_id, symbol LIMIT 10")
def grid_top_k(spark, sf_dir):
    return _results(ranked(_grid(spark, sf_dir), "total_return", 10), "combo_id", "symbol")


@register(Q.chain(*_GRID_RESULTS) + "SELECT symbol, metric, round(value, 6) AS value, combo_id::BIGINT AS combo_id FROM (SELECT *, row_number() OVER (PARTITION BY symbol, metric ORDER BY CASE WHEN metric = 'max_drawdown' THEN value ELSE -value END, combo_id) AS n FROM (SELECT combo_id, symbol, unnest(['total_return', 'sharpe_ratio', 'max_drawdown', 'win_rate', 'total_trades']) AS metric, unnest([total_return_pct, sharpe_ratio, max_drawdown, win_rate, total_trades::DOUBLE]) AS value FROM results)) WHERE n = 1")
def grid_best_by_metric(spark, sf_dir):
    return best_by_metric(_grid(spark, sf_dir), "symbol")


@register(Q.chain(*_GRID_RESULTS) + "SELECT c.short_window::BIGINT AS short_window, count(*) AS n, round(avg(total_return_pct), 6) AS avg_return_pct, round(stddev_samp(total_return_pct), 6) AS std_return_pct FROM results r JOIN combos c USING (combo_id) GROUP BY c.short_window")
def grid_sensitivity(spark, sf_dir):
    return _grid(spark, sf_dir).groupBy("short_window").agg(F.count("*").alias("n"), F.avg("total_return_pct").alias("avg_return_pct"), F.stddev_samp("total_return_pct").alias("std_return_pct"))


@register("SELECT 'simple_ma' AS space, count(*) AS combinations, least(10000, greatest(10, floor(0.1 * count(*))))::BIGINT AS suggested FROM range(5, 21) a CROSS JOIN range(20, 101, 5) b CROSS JOIN range(5, 11) c")
def parameter_space_size(spark, sf_dir):
    """The combinations that the space makes, counted, and the sample that it suggests."""
    return MA_SPACE.grid(spark).agg(F.lit("simple_ma").alias("space"), F.count("*").alias("combinations"), F.lit(MA_SPACE.suggested_samples()).alias("suggested"))


@register("SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS combo_id, a AS short_window, b AS long_window, round(c / 10::DOUBLE, 6) AS position_size FROM range(5, 21) s(a) CROSS JOIN range(20, 101, 5) l(b) CROSS JOIN range(5, 11) p(c)")
def grid_combinations(spark, sf_dir):
    return MA_SPACE.grid(spark)


def _drawn(n: int, seed: int) -> list[str]:
    """``combos``: the random combinations of the built-in space, drawn by the same hashes."""
    unit = lambda name: f"('0x' || substr(md5('{seed}|' || id || '|{name}'), 1, 13))::BIGINT / 4503599627370496::DOUBLE"
    at = lambda name, k: f"floor({unit(name)} * {k})::INT"
    return [
        f"draws AS (SELECT id, 5 + {at('short_window', 16)} AS short_window, 20 + {at('long_window', 81)} AS long_window, (5 + {at('position_size', 6)}) / 10::DOUBLE AS position_size FROM range({10 * n}) t(id))",
        "fresh AS (SELECT *, row_number() OVER (PARTITION BY short_window, long_window, position_size ORDER BY id) = 1 AS is_new FROM draws)",
        "counted AS (SELECT *, sum(is_new::INT) OVER (ORDER BY id) AS found FROM fresh)",
        "ended AS (SELECT *, coalesce(bool_or(id + 1 > 100 AND id + 1 - found > 0.8 * (id + 1)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM counted)",
        f"combos AS MATERIALIZED (SELECT (found - 1)::BIGINT AS combo_id, short_window::BIGINT AS short_window, long_window::BIGINT AS long_window, position_size FROM ended WHERE is_new AND found <= {n} AND NOT done)",
    ]


@register(Q.chain(*_drawn(100, 42)) + "SELECT combo_id, short_window, long_window, round(position_size, 6) AS position_size FROM combos")
def random_combinations(spark, sf_dir):
    return MA_SPACE.random(spark, 100, seed=42)


_RANDOM_SIG = [
    Q.ORDERS_BARS,
    *_drawn(MA_SPACE.suggested_samples(), 42),
    "lines AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS row_idx FROM bars)",
    "lengths AS (SELECT DISTINCT unnest([short_window, long_window]) AS n FROM combos)",
    "averages AS MATERIALIZED (SELECT a.symbol, a.row_idx, n, avg(b.close) AS mean FROM lines a CROSS JOIN lengths JOIN lines b ON b.symbol = a.symbol AND b.row_idx BETWEEN a.row_idx - n + 1 AND a.row_idx WHERE a.row_idx >= n - 1 GROUP BY 1, 2, 3)",
    "means AS (SELECT c.combo_id, c.short_window, c.long_window, c.position_size, l.symbol, l.ts, l.close, l.row_idx, s.mean AS ma_short, m.mean AS ma_long FROM lines l CROSS JOIN combos c LEFT JOIN averages s ON s.symbol = l.symbol AND s.row_idx = l.row_idx AND s.n = c.short_window LEFT JOIN averages m ON m.symbol = l.symbol AND m.row_idx = l.row_idx AND m.n = c.long_window WHERE c.short_window < c.long_window)",
    _GRID_SIG[-1],
]
_RANDOM_RESULTS = [*_RANDOM_SIG, Q.fold(_GRID_KEYS), Q.curve(_GRID_KEYS), Q.pairs(_GRID_KEYS), Q.fifo(_GRID_KEYS), Q.results(_GRID_KEYS)]


@register(Q.chain(*_RANDOM_RESULTS) + f"SELECT combo_id, symbol, {_RESULT_COLUMNS} FROM results ORDER BY results.sharpe_ratio DESC NULLS LAST, combo_id, symbol LIMIT 10")
def random_search_top_k(spark, sf_dir):
    combos = MA_SPACE.random(spark, MA_SPACE.suggested_samples(), seed=42)
    return _results(ranked(evaluate(orders_bars(spark, sf_dir), combos, ENGINE), "sharpe_ratio", 10), "combo_id", "symbol")


# walk-forward

_PERIODS = """spans AS (SELECT symbol, min(ts) AS first, max(ts) AS last FROM bars GROUP BY symbol),
starts AS (SELECT symbol, last, first AS test_start FROM spans UNION ALL SELECT symbol, last, test_start + INTERVAL 3 MONTH FROM starts WHERE test_start + INTERVAL 3 MONTH <= last),
periods AS MATERIALIZED (SELECT symbol, test_start, test_end, n_rows, row_number() OVER (PARTITION BY symbol ORDER BY test_start) AS period FROM (
  SELECT s.symbol, test_start, test_start + INTERVAL 6 MONTH AS test_end, count(*) AS n_rows FROM starts s JOIN bars b ON b.symbol = s.symbol AND b.ts >= test_start AND b.ts < test_start + INTERVAL 6 MONTH
  WHERE test_start + INTERVAL 6 MONTH <= last GROUP BY 1, 2, 3) WHERE n_rows >= 30)"""
_WF_KEYS = "symbol, period"
_WF = [Q.ORDERS_BARS, _PERIODS, "wf_bars AS (SELECT b.*, p.period FROM bars b JOIN periods p ON p.symbol = b.symbol AND b.ts >= p.test_start AND b.ts < p.test_end)", Q.signals(_WF_KEYS, "5", "15", "0.2", "wf_bars"), Q.fold(_WF_KEYS), Q.curve(_WF_KEYS)]
_WF_RESULTS = [*_WF, Q.pairs(_WF_KEYS), Q.fifo(_WF_KEYS), Q.results(_WF_KEYS)]
_WF_STRATEGY = MaCrossover(5, 15, 0.2)


@register(Q.chain(Q.ORDERS_BARS, _PERIODS) + f"SELECT symbol, period, {Q.when('test_start')} AS test_start, {Q.when('test_end')} AS test_end, n_rows FROM periods")
def walk_forward_periods(spark, sf_dir):
    return R.walk_forward_periods(orders_bars(spark, sf_dir))


@register(Q.chain(*_WF_RESULTS) + f"SELECT symbol, period, {_RESULT_COLUMNS} FROM results")
def walk_forward_results(spark, sf_dir):
    return _results(R.walk_forward(orders_bars(spark, sf_dir), _WF_STRATEGY), "symbol", "period")


_COMBINED = "avg(total_return) AS {m}_return, quantile_cont(total_return, 0.5) AS median_return, stddev_pop(total_return) AS std_return, avg(total_return_pct) AS {m}_return_pct, quantile_cont(total_return_pct, 0.5) AS median_return_pct, stddev_pop(total_return_pct) AS std_return_pct"
_WF_DOUBLES = ("avg_return", "median_return", "std_return", "avg_return_pct", "median_return_pct", "std_return_pct", "avg_sharpe_ratio", "avg_max_drawdown", "worst_max_drawdown", "best_max_drawdown", "avg_win_rate", "avg_trades_per_period", "positive_return_pct", "profitable_periods_pct", "combined_sharpe_ratio")


@register(
    Q.chain(
        *_WF_RESULTS,
        f"combined AS (SELECT symbol, count(*) AS total_periods, {_COMBINED.format(m='avg')}, avg(sharpe_ratio) AS avg_sharpe_ratio, avg(max_drawdown) AS avg_max_drawdown, max(max_drawdown) AS worst_max_drawdown, min(max_drawdown) AS best_max_drawdown, avg(win_rate) AS avg_win_rate, avg(total_trades) AS avg_trades_per_period, count(*) FILTER (WHERE total_return > 0) AS positive_return_periods, count(*) FILTER (WHERE total_return > 0) / count(*) * 100 AS positive_return_pct, count(*) FILTER (WHERE total_return_pct > 0) AS profitable_periods, count(*) FILTER (WHERE total_return_pct > 0) / count(*) * 100 AS profitable_periods_pct FROM results GROUP BY symbol)",
        "whole AS (SELECT symbol, CASE WHEN count(ret) > 1 AND stddev_samp(ret) > 0 THEN sqrt(252::DOUBLE) * avg(ret) / stddev_samp(ret) ELSE 0 END AS combined_sharpe_ratio FROM curve GROUP BY symbol)",
    )
    + f"SELECT symbol, total_periods, {Q.r6(*_WF_DOUBLES)}, positive_return_periods, profitable_periods FROM combined JOIN whole USING (symbol)"
)
def wf_combined(spark, sf_dir):
    bars = orders_bars(spark, sf_dir)
    keys = ("symbol", "period")
    simulated = simulate(_WF_STRATEGY.signals(R.walk_forward_bars(bars, R.walk_forward_periods(bars)), keys), keys, ENGINE)
    return S.walk_forward_metrics(M.summarize(simulated, keys, ENGINE), M.equity_curve(simulated, keys).select("symbol", "ret"))


_TURNS = """ups AS (SELECT symbol, period, total_return, total_return - lag(total_return) OVER (PARTITION BY symbol ORDER BY period) > 0 AS up FROM results),
turns AS (SELECT *, up <> lag(up) OVER (PARTITION BY symbol ORDER BY period) AS turned FROM ups),
temporal AS (SELECT symbol, CASE WHEN count(turned) > 0 THEN 1 - count(*) FILTER (WHERE turned) / count(turned) ELSE 1 END AS temporal_stability, count(*) AS n FROM turns GROUP BY symbol),
sized AS (SELECT r.symbol, period, total_return, least(4, n // 2) AS width, row_number() OVER (PARTITION BY r.symbol ORDER BY period) AS place FROM results r JOIN temporal USING (symbol)),
rolled AS (SELECT a.symbol, a.place, avg(b.total_return) AS mean FROM sized a JOIN sized b ON b.symbol = a.symbol AND b.place BETWEEN a.place - a.width + 1 AND a.place WHERE a.place >= a.width GROUP BY 1, 2)"""


@register(Q.chain(*_WF_RESULTS, _TURNS) + "SELECT symbol, round(stddev_pop(total_return), 6) AS return_volatility, round(stddev_pop(total_return_pct), 6) AS return_pct_volatility, round(stddev_pop(sharpe_ratio), 6) AS sharpe_volatility, round(coalesce(CASE WHEN stddev_pop(total_return) > 0 THEN avg(total_return) / stddev_pop(total_return) END, 0), 6) AS return_consistency, round(coalesce(CASE WHEN stddev_pop(total_return_pct) > 0 THEN avg(total_return_pct) / stddev_pop(total_return_pct) END, 0), 6) AS return_pct_consistency, round(any_value(temporal_stability), 6) AS temporal_stability, round(any_value(CASE WHEN n >= 4 THEN rolling END), 6) AS rolling_mean_stability, round(any_value(CASE WHEN n >= 4 THEN temporal_stability END), 6) AS trend_consistency FROM results JOIN temporal USING (symbol) LEFT JOIN (SELECT symbol, 1 / (1 + stddev_pop(mean)) AS rolling FROM rolled GROUP BY symbol) USING (symbol) GROUP BY symbol")
def wf_stability(spark, sf_dir):
    return S.stability_metrics(R.walk_forward(orders_bars(spark, sf_dir), _WF_STRATEGY))


@register(Q.chain(*_WF_RESULTS) + "SELECT symbol, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS count FROM (SELECT symbol, unnest(['total_return', 'sharpe_ratio', 'max_drawdown', 'win_rate']) AS metric, unnest([total_return, sharpe_ratio, max_drawdown, win_rate]) AS value FROM results) GROUP BY symbol, metric")
def wf_summary_statistics(spark, sf_dir):
    return S.summary_statistics(R.walk_forward(orders_bars(spark, sf_dir), _WF_STRATEGY))


@register(Q.chain(*_WF_RESULTS) + "SELECT symbol, round(coalesce(CASE WHEN stddev_samp(total_return) > 0 THEN avg(total_return) / stddev_samp(total_return) END, 0), 6) AS consistency_ratio, round(count(*) FILTER (WHERE total_return > 0) / count(*) * 100, 6) AS positive_periods_pct FROM results GROUP BY symbol")
def wf_consistency(spark, sf_dir):
    return S.consistency(R.walk_forward(orders_bars(spark, sf_dir), _WF_STRATEGY))


# Monte Carlo

_A, _B, _C = R.LCG
_PLAN = f"""nums AS (SELECT symbol, count(*) AS n, CASE WHEN count(*) > 30 THEN 30 ELSE greatest(count(*) // 4, 1) END AS block_rows, floor(count(*) * 0.8::DOUBLE)::BIGINT AS n_samples FROM bars GROUP BY symbol),
plan AS (SELECT symbol, sim, block_no, ((sim * {_A} + block_no * {_C} + 42 * {_B}) % 2147483648) % (n - block_rows + 1) AS start_idx, block_rows, n_samples
  FROM nums CROSS JOIN range({SIMULATIONS}) s(sim) CROSS JOIN range(2000) k(block_no) WHERE block_no < greatest(n_samples // block_rows, 1)),
mc_bars AS MATERIALIZED (SELECT p.symbol, p.sim, p.block_no, k.block_row, b.ts, b.close FROM plan p JOIN range(30) k(block_row) ON k.block_row < p.block_rows AND p.block_no * p.block_rows + k.block_row < p.n_samples
  JOIN (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM bars) b ON b.symbol = p.symbol AND b.bar_no = p.start_idx + k.block_row)"""
_MC_KEYS = "symbol, sim"
_MC_RESULTS = [Q.ORDERS_BARS, _PLAN, Q.signals(_MC_KEYS, "5", "15", "0.2", "mc_bars", "ts, block_no, block_row"), Q.fold(_MC_KEYS), Q.curve(_MC_KEYS), Q.pairs(_MC_KEYS), Q.fifo(_MC_KEYS), Q.results(_MC_KEYS)]


def _monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.monte_carlo(orders_bars(spark, sf_dir), _WF_STRATEGY, simulations=SIMULATIONS)


@register(Q.chain(Q.ORDERS_BARS, _PLAN) + f"SELECT symbol, sim, block_no, block_row, {Q.when('ts')} AS ts, round(close, 6) AS close FROM mc_bars")
def mc_samples(spark, sf_dir):
    bars = orders_bars(spark, sf_dir)
    return R.samples(bars, R.sample_plan(bars, SIMULATIONS)).select("symbol", "sim", "block_no", "block_row", "ts", "close")


@register(Q.chain(*_MC_RESULTS) + f"SELECT symbol, sim, {_RESULT_COLUMNS} FROM results")
def mc_results(spark, sf_dir):
    return _results(_monte_carlo(spark, sf_dir), "symbol", "sim")


_MC_DOUBLES = ("mean_return", "median_return", "std_return", "mean_return_pct", "median_return_pct", "std_return_pct", "mean_sharpe", "median_sharpe", "std_sharpe", "mean_max_drawdown", "worst_max_drawdown", "best_max_drawdown", "mean_win_rate", "mean_trades_per_simulation", "positive_return_pct", "profitable_simulations_pct")


@register(Q.chain(*_MC_RESULTS, f"combined AS (SELECT symbol, {_COMBINED.format(m='mean')}, avg(sharpe_ratio) AS mean_sharpe, quantile_cont(sharpe_ratio, 0.5) AS median_sharpe, stddev_pop(sharpe_ratio) AS std_sharpe, avg(max_drawdown) AS mean_max_drawdown, max(max_drawdown) AS worst_max_drawdown, min(max_drawdown) AS best_max_drawdown, avg(win_rate) AS mean_win_rate, avg(total_trades) AS mean_trades_per_simulation, count(*) FILTER (WHERE total_return > 0) AS positive_return_simulations, count(*) FILTER (WHERE total_return > 0) / count(*) * 100 AS positive_return_pct, count(*) FILTER (WHERE total_return_pct > 0) AS profitable_simulations, count(*) FILTER (WHERE total_return_pct > 0) / count(*) * 100 AS profitable_simulations_pct, count(*) AS total_simulations FROM results GROUP BY symbol)") + f"SELECT symbol, {Q.r6(*_MC_DOUBLES)}, positive_return_simulations, profitable_simulations, total_simulations FROM combined")
def mc_combined(spark, sf_dir):
    return S.monte_carlo_metrics(_monte_carlo(spark, sf_dir))


_LEVELS = [("var_5pct", 0.05), ("var_1pct", 0.01)] + [x for c in S.CONFIDENCE for x in ((f"ci_{int(c * 100)}_lower", (1 - c) / 2), (f"ci_{int(c * 100)}_upper", 1 - (1 - c) / 2))]
_MOMENTS = lambda n, c: f"coalesce(skewness({c}), 0) AS {n}_skewness, coalesce(kurtosis({c}), 0) AS {n}_kurtosis"
_DIST = "dist AS (SELECT symbol, " + ", ".join([_MOMENTS("return", "total_return"), _MOMENTS("return_pct", "total_return_pct"), _MOMENTS("sharpe", "sharpe_ratio")] + [f"quantile_cont({c}, {p!r}::DOUBLE) AS {n}_{label}" for n, c in (("return", "total_return"), ("return_pct", "total_return_pct")) for label, p in _LEVELS]) + " FROM results GROUP BY symbol)"
_DIST_NAMES = [f"{n}_{k}" for n in ("return", "return_pct", "sharpe") for k in ("skewness", "kurtosis")] + [f"{n}_{label}" for n in ("return", "return_pct") for label, _ in _LEVELS]
_TAILS = ", ".join(f"round(avg({c}) FILTER (WHERE {c} <= {n}_var_{p}pct), 6) AS {n}_cvar_{p}pct" for n, c in (("return", "total_return"), ("return_pct", "total_return_pct")) for p in (5, 1))


@register(Q.chain(*_MC_RESULTS, _DIST) + "SELECT symbol, " + ", ".join(f"round(any_value({n}), 6) AS {n}" for n in _DIST_NAMES) + f", {_TAILS} FROM results JOIN dist USING (symbol) GROUP BY symbol")
def mc_distribution(spark, sf_dir):
    return S.distribution(_monte_carlo(spark, sf_dir))


@register(Q.chain(*_MC_RESULTS) + "SELECT symbol, metric, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM (SELECT symbol, unnest(['total_return', 'total_return_pct', 'sharpe_ratio', 'max_drawdown', 'win_rate']) AS metric, unnest([total_return, total_return_pct, sharpe_ratio, max_drawdown, win_rate]) AS value FROM results) GROUP BY symbol, metric")
def mc_percentiles(spark, sf_dir):
    return S.percentile_table(_monte_carlo(spark, sf_dir))


# dashboards and export frames


@register(Q.chain(*_RESULTS) + "SELECT 'Simple MA Strategy' AS strategy_name, round(avg(total_return_pct), 6) AS avg_return_pct, count(*) AS runs FROM results")
def avg_return_by_strategy(spark, sf_dir):
    return S.return_by_strategy(M.summarize(_simulated(spark, sf_dir), engine=ENGINE))


@register(Q.chain(*_CURVE) + f"SELECT symbol, {Q.when('bucket')} AS bucket, round(avg(portfolio_value), 6) AS avg_value FROM (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS bucket, portfolio_value FROM curve) GROUP BY symbol, bucket")
def portfolio_by_bucket(spark, sf_dir):
    return S.value_by_bucket(M.equity_curve(_simulated(spark, sf_dir)))


@register(Q.chain(*_TRADED) + f"SELECT {Q.when('bucket')} AS bucket, count(*) AS n_trades FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket FROM trades) GROUP BY bucket")
def trade_count_by_day(spark, sf_dir):
    return S.trades_by_bucket(trades(_simulated(spark, sf_dir)), "day")


@register(Q.chain(*_TRADED) + "SELECT symbol, side, count(*) AS n_trades, round(avg(price), 6) AS avg_price, round(avg(quantity), 6) AS avg_quantity, round(sum(value), 6) AS total_value FROM trades GROUP BY symbol, side")
def side_distribution(spark, sf_dir):
    return S.trade_panels(trades(_simulated(spark, sf_dir)))


@register(Q.chain(*_TRADED) + f"SELECT {Q.when('bucket')} AS bucket, count(*) FILTER (WHERE side = 'buy') AS buy, count(*) FILTER (WHERE side = 'sell') AS sell FROM (SELECT date_trunc('year', ts)::TIMESTAMP AS bucket, side FROM trades) GROUP BY bucket")
def side_heatmap(spark, sf_dir):
    return S.side_heatmap(trades(_simulated(spark, sf_dir)))


@register(Q.chain(*_TRADED) + "SELECT count(*) AS total_positions, round(coalesce(sum(abs(size)), 0), 6) AS total_exposure, count(*) FILTER (WHERE size > 0) AS long_positions, count(*) FILTER (WHERE size < 0) AS short_positions, round(coalesce(avg(abs(size)), 0), 6) AS average_position_size FROM (SELECT symbol, arg_max(position, row_idx) AS size FROM trades GROUP BY symbol) WHERE abs(size) >= 1e-10::DOUBLE")
def exposure_summary(spark, sf_dir):
    """The book's summary, of the positions left at the end."""
    last = trades(_simulated(spark, sf_dir)).groupBy("symbol").agg(F.max_by("position", "row_idx").alias("size"))
    return book_summary(last)


@register(Q.chain(*_CURVE, _ROLL) + f"SELECT 'run-1' AS backtest_id, symbol, {Q.when('ts')} AS timestamp, round(portfolio_value, 6) AS portfolio_value, round(drawdown * 100, 6) AS drawdown_pct, round(CASE WHEN n >= 30 AND spread > 0 THEN mean * 252 / (spread * sqrt(252::DOUBLE)) END, 6) AS rolling_sharpe_30d, round(CASE WHEN n >= 30 THEN spread * sqrt(252::DOUBLE) * 100 END, 6) AS rolling_volatility_30d FROM roll")
def export_portfolio(spark, sf_dir):
    return sinks.portfolio_frame(M.equity_curve(_simulated(spark, sf_dir)), "run-1").drop("created_at")


_META = "backtest_id, strategy_name, symbol, start_date, end_date, initial_capital, final_capital, total_return, total_return_pct, max_drawdown, sharpe_ratio, win_rate, total_trades, profit_factor, average_win, average_loss, largest_win, largest_loss, num_winning_trades, num_losing_trades, commission"
_META_SQL = f"SELECT 'run-1' AS backtest_id, 'Simple MA Strategy' AS strategy_name, symbol, 10000.0::DOUBLE AS initial_capital, 0.001::DOUBLE AS commission, {_RESULT_COLUMNS} FROM results"


@register(Q.chain(*_RESULTS) + f"SELECT {_META} FROM ({_META_SQL})")
def export_metadata(spark, sf_dir):
    return sinks.metadata_frame(M.summarize(_simulated(spark, sf_dir), engine=ENGINE), "run-1").drop("created_at")


_TRADES_SQL = f"SELECT 'run-1' AS backtest_id, {Q.when('ts')} AS timestamp, symbol, side, {Q.r6('price', 'quantity', 'value')} FROM trades"


@register(Q.chain(*_TRADED) + _TRADES_SQL)
def export_trades(spark, sf_dir):
    return sinks.trades_frame(trades(_simulated(spark, sf_dir)), "run-1").drop("created_at")


@register(Q.chain(*_TRADED, Q.pairs("symbol")) + f"SELECT 'run-1' AS backtest_id, 'run-1-pos-' || row_number() OVER (PARTITION BY symbol ORDER BY row_idx) AS position_id, symbol, {Q.when('b_ts')} AS entry_timestamp, {Q.when('ts')} AS exit_timestamp, round(b_price, 6) AS entry_price, round(price, 6) AS exit_price, round(b_quantity, 6) AS quantity, round(b_value, 6) AS entry_value, round(value, 6) AS exit_value, round(pnl, 6) AS pnl, round(pnl / b_value * 100, 6) AS pnl_pct, round((epoch_us(ts) - epoch_us(b_ts)) / 8.64e10, 6) AS duration_days, round((epoch_us(ts) - epoch_us(b_ts)) / 3.6e9, 6) AS duration_hours, pnl > 0 AS is_win FROM pairs")
def export_positions(spark, sf_dir):
    return sinks.positions_frame(trades(_simulated(spark, sf_dir)), "run-1").drop("created_at")


@register(Q.chain(*_RESULTS) + f"SELECT t.backtest_id, t.timestamp, t.symbol, side, price, quantity, value, strategy_name, initial_capital, final_capital, total_trades FROM ({_TRADES_SQL}) t JOIN ({_META_SQL}) m ON m.backtest_id = t.backtest_id AND m.symbol = t.symbol")
def trades_with_run(spark, sf_dir):
    """Trades with what their run's metadata says."""
    simulated = _simulated(spark, sf_dir)
    runs = sinks.metadata_frame(M.summarize(simulated, engine=ENGINE), "run-1").select("backtest_id", "symbol", "strategy_name", "initial_capital", "final_capital", "total_trades")
    return sinks.with_run(sinks.trades_frame(trades(simulated), "run-1").drop("created_at"), runs, ("backtest_id", "symbol"))


@register(Q.chain(*_WF_RESULTS) + f"SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY start_date) AS period, {Q.when('start_date')} AS start_date, {Q.when('end_date')} AS end_date, {Q.r6('total_return', 'total_return_pct', 'sharpe_ratio', 'max_drawdown', 'win_rate', 'final_capital')}, total_trades, 10000.0::DOUBLE AS initial_capital FROM results")
def wf_result_table(spark, sf_dir):
    return S.result_table(R.walk_forward(orders_bars(spark, sf_dir), _WF_STRATEGY), "start_date")


_VECTORS = {"total_returns": "total_return", "sharpe_ratios": "sharpe_ratio", "max_drawdowns": "max_drawdown", "win_rates": "win_rate"}


@register(Q.chain(*_WF_RESULTS) + "SELECT symbol, " + ", ".join(f"array_to_string(list(round(coalesce({c}, 0) * 10000)::BIGINT ORDER BY period), ',') AS {n}" for n, c in _VECTORS.items()) + " FROM results GROUP BY symbol")
def wf_result_vectors(spark, sf_dir):
    """The vectors, in ten-thousandths, as text."""
    vectors = S.result_vectors(R.walk_forward(orders_bars(spark, sf_dir), _WF_STRATEGY), "period")
    return vectors.select("symbol", *[F.array_join(F.transform(n, lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias(n) for n in _VECTORS])


@register(Q.chain(*_MC_RESULTS) + f"SELECT symbol, count(*) AS completed, round(count(*) / {SIMULATIONS} * 100, 6) AS success_rate FROM results GROUP BY symbol")
def mc_success_rate(spark, sf_dir):
    return S.success_rate(_monte_carlo(spark, sf_dir), SIMULATIONS, ("symbol",))


@register(Q.chain(Q.ORDERS_BARS) + "SELECT symbol, count(*) AS n_rows, count(*) >= 100 AS walk_forward, count(*) >= 100 AS monte_carlo, CASE WHEN count(*) > 30 THEN 30 ELSE greatest(count(*) // 4, 1) END AS block_rows FROM bars GROUP BY symbol")
def enough_rows(spark, sf_dir):
    return V.enough_rows(orders_bars(spark, sf_dir))


# files and sinks, written and read again


def _again(spark: SparkSession, name: str, write: Callable[[str], object], read: Callable[[str], DataFrame]) -> DataFrame:
    """What comes back from a folder that is gone afterwards."""
    folder = scratch(spark, name)
    try:
        write(folder)
        return cut(read(folder))
    finally:
        discard(spark, folder)


_ONE = "1-URGENT"


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_bars(spark, sf_dir).where(F.col("symbol") == _ONE)


@register(Q.chain(Q.ORDERS_BARS) + f"SELECT {_BAR_COLUMNS}, row_number() OVER (ORDER BY ts) AS seq FROM bars WHERE symbol = '{_ONE}'")
def csv_scan_backtest(spark, sf_dir):
    return _again(spark, "csv", lambda f: files.write_csv(_one(spark, sf_dir), f), lambda f: files.load_for_backtest(spark, f, symbol=_ONE).drop("file"))


@register(Q.chain(Q.ORDERS_BARS) + f"SELECT {_BAR_COLUMNS}, row_number() OVER (ORDER BY ts) AS seq FROM bars WHERE symbol = '{_ONE}'")
def csv_scan_search(spark, sf_dir):
    return _again(spark, "csv", lambda f: files.write_csv(_one(spark, sf_dir), f), lambda f: files.load_for_search(spark, f, symbol=_ONE).drop("file"))


@register(Q.chain(Q.ORDERS_BARS) + f"SELECT {_BAR_COLUMNS}, row_number() OVER (ORDER BY ts) AS seq FROM bars WHERE symbol = '{_ONE}'")
def csv_scan_analyze(spark, sf_dir):
    return _again(spark, "csv", lambda f: files.write_csv(_one(spark, sf_dir), f), lambda f: files.load_for_analysis(spark, f, symbol=_ONE).drop("file"))


@register(Q.chain(*_CLEAN, Q.filled("c1", "c2"), Q.price_rules("c2", "c3"), Q.quality("c3", "c4")) + f"SELECT {_BAR_COLUMNS} FROM c4 WHERE symbol = '{_ONE}'")
def csv_scan_clean(spark, sf_dir):
    """Dirty bars in source order, written as they are, read and cleaned."""
    dirty = dirty_bars(spark, sf_dir).where(F.col("symbol") == _ONE)
    write = lambda f: dirty.coalesce(1).sortWithinPartitions("seq").select(F.col("ts").alias("timestamp"), *VALUES).write.options(**files.CSV).csv(f)
    return _again(spark, "csv", write, lambda f: files.load_for_backtest(spark, f, clean=True, symbol=_ONE).select("symbol", "ts", *VALUES))


def _run_one(spark: SparkSession, sf_dir: str) -> sinks.Run:
    simulated = cut(_simulated(spark, sf_dir).where(F.col("symbol") == _ONE))
    return sinks.Run(M.summarize(simulated, engine=ENGINE), trades(simulated), M.equity_curve(simulated))


def _csv_sink(spark: SparkSession, sf_dir: str, part: str, schema: str) -> DataFrame:
    read = lambda f: spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(f"{f}/*_{part}")
    return _again(spark, "sink", lambda f: sinks.CsvSink(f).export(_run_one(spark, sf_dir), "run-1", {"symbol": _ONE, "strategy_name": "ma"}), read)


@register(Q.chain(*_CURVE) + f"SELECT {Q.when('ts')} AS timestamp, round(portfolio_value, 6) AS portfolio_value, 'run-1' AS backtest_id FROM curve WHERE symbol = '{_ONE}'")
def csv_sink_equity(spark, sf_dir):
    return _csv_sink(spark, sf_dir, "equity", "timestamp timestamp, portfolio_value double, backtest_id string")


@register(Q.chain(*_TRADED) + f"SELECT {Q.when('ts')} AS timestamp, symbol, side, {Q.r6('price', 'quantity', 'value')}, 'run-1' AS backtest_id FROM trades WHERE symbol = '{_ONE}'")
def csv_sink_trades(spark, sf_dir):
    return _csv_sink(spark, sf_dir, "trades", "timestamp timestamp, symbol string, side string, price double, quantity double, value double, backtest_id string")


def _documents(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    def write(folder: str) -> None:
        sinks.DocumentSink(path=folder.removeprefix("file://")).export(_run_one(spark, sf_dir), "run-1", {})

    return _again(spark, "index", write, lambda f: spark.read.schema(sinks.MAPPINGS[kind]).option("pathGlobFilter", "*.jsonl").json(f"{f}/barwright-{kind}")).drop("created_at")


@register(Q.chain(*_TRADED) + f"SELECT * FROM ({_TRADES_SQL}) WHERE symbol = '{_ONE}'")
def document_sink_trades(spark, sf_dir):
    """Trades of a run, sent in bulk to a document store and read from it."""
    return _documents(spark, sf_dir, "trades")


@register(Q.chain(*_RESULTS) + f"SELECT {_META} FROM ({_META_SQL}) WHERE symbol = '{_ONE}'")
def document_sink_metadata(spark, sf_dir):
    return _documents(spark, sf_dir, "backtests")


@register(Q.chain(Q.ORDERS_BARS) + f"SELECT symbol, {Q.when('ts')} AS ts, {Q.r6(*VALUES)} FROM bars")
def parquet_by_symbol(spark, sf_dir):
    """The download sink's table, a folder a symbol."""
    return _again(spark, "bars", lambda f: files.write_parquet(orders_bars(spark, sf_dir), f), lambda f: spark.read.parquet(f).select("symbol", "ts", *VALUES))


@register("SELECT DISTINCT split_part(o_orderpriority, '-', 2) AS symbol, count(*) AS n FROM orders GROUP BY 1")
def symbol_from_name(spark, sf_dir):
    """Symbols of file names made of the priorities."""
    names = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("/data/x/"), F.element_at(F.split("o_orderpriority", "-"), 2), F.lit("_1d.csv")).alias("path"))
    return names.groupBy(files.symbol_of(F.col("path")).alias("symbol")).agg(F.count("*").alias("n"))


# settings, a set for each supplier


def _settings(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select("s_suppkey", *[F.expr(e).alias(n) for n, e in columns.items()])


def _complaint_sql(columns: dict[str, str], rules: list[tuple[str, str]]) -> str:
    made = ", ".join(f"{e.replace(' DIV ', ' // ')} AS {n}" for n, e in columns.items())
    return f"SELECT s_suppkey, CASE " + " ".join(f"WHEN NOT ({rule}) THEN '{message}'" for rule, message in rules) + f" END AS complaint FROM (SELECT s_suppkey, {made} FROM supplier)"


_ENGINE_SETTINGS = {"initial_capital": "s_acctbal", "commission": "cast(s_suppkey % 5 - 1 AS double)", "min_order_value": "cast(s_suppkey % 7 - 1 AS double)"}


@register(_complaint_sql(_ENGINE_SETTINGS, [("initial_capital > 0", "Initial capital must be positive"), ("commission >= 0", "Commission cannot be negative"), ("min_order_value >= 0", "Minimum order value cannot be negative")]))
def engine_settings_check(spark, sf_dir):
    return limits.first_complaint(_settings(spark, sf_dir, **_ENGINE_SETTINGS), limits.ENGINE).select("s_suppkey", "complaint")


_RISK_SETTINGS = {"position_size_pct": "cast(s_suppkey % 12 AS double) / 10", "stop_loss_pct": "cast(s_suppkey % 5 AS double) / 4 - 0.25", "max_positions": "s_nationkey - 2", "max_risk_per_trade": "cast(s_suppkey % 11 AS double) / 10"}


@register(_complaint_sql(_RISK_SETTINGS, [("position_size_pct > 0 AND position_size_pct <= 1", "position_size_pct must be between 0 and 1"), ("stop_loss_pct >= 0 AND stop_loss_pct <= 1", "stop_loss_pct must be between 0 and 1"), ("max_positions > 0", "max_positions must be positive"), ("max_risk_per_trade > 0 AND max_risk_per_trade <= 1", "max_risk_per_trade must be between 0 and 1"), ("position_size_pct * stop_loss_pct <= max_risk_per_trade", "Position size ({position_size_pct}) * stop loss ({stop_loss_pct}) exceeds max risk per trade ({max_risk_per_trade})")]))
def risk_settings_check(spark, sf_dir):
    return limits.first_complaint(_settings(spark, sf_dir, **_RISK_SETTINGS), limits.FIXED_RISK).select("s_suppkey", "complaint")


_ANALYSIS_SETTINGS = {"test_window_months": "s_suppkey % 4", "step_months": "s_suppkey % 3", "n_simulations": "s_nationkey", "bootstrap_sample_pct": "cast(s_suppkey % 6 AS double) / 4", "block_size_days": "s_suppkey % 9"}


@register(_complaint_sql(_ANALYSIS_SETTINGS, [("test_window_months > 0", "test_window_months must be positive"), ("step_months > 0", "step_months must be positive"), ("n_simulations > 0", "n_simulations must be positive"), ("bootstrap_sample_pct > 0 AND bootstrap_sample_pct <= 1", "bootstrap_sample_pct must be between 0 and 1"), ("block_size_days > 0", "block_size_days must be positive")]))
def analysis_settings_check(spark, sf_dir):
    return limits.first_complaint(_settings(spark, sf_dir, **_ANALYSIS_SETTINGS), (*limits.WALK_FORWARD, *limits.MONTE_CARLO)).select("s_suppkey", "complaint")


_CROSSOVER_SETTINGS = {"short_window": "s_suppkey % 20 - 1", "long_window": "s_nationkey", "position_size": "cast(s_suppkey % 13 AS double) / 10"}


@register(_complaint_sql(_CROSSOVER_SETTINGS, [("short_window > 0 AND long_window > 0", "Window sizes must be positive"), ("short_window < long_window", "Short window must be less than long window"), ("position_size > 0 AND position_size <= 1", "Position size must be between 0 and 1")]))
def strategy_settings_check(spark, sf_dir):
    return limits.first_complaint(_settings(spark, sf_dir, **_CROSSOVER_SETTINGS), limits.CROSSOVER).select("s_suppkey", "complaint")


_KELLY_SETTINGS = {"lookback_periods": "s_suppkey % 6", "min_trades_for_kelly": "s_nationkey % 5", "max_positions": "s_suppkey % 4", "max_kelly_fraction": "cast(s_suppkey % 13 AS double) / 10", "max_risk_per_trade": "cast(s_nationkey % 12 AS double) / 10", "fractional_kelly": "cast(s_suppkey % 7 AS double) / 4", "stop_loss_pct": "cast(s_suppkey % 9 AS double) / 6 - 0.2"}
_FRACTION = lambda n: (f"{n} > 0 AND {n} <= 1", f"{n} must be between 0 and 1")
_POSITIVE = lambda n: (f"{n} > 0", f"{n} must be positive")


@register(_complaint_sql(_KELLY_SETTINGS, [*map(_POSITIVE, ("lookback_periods", "min_trades_for_kelly", "max_positions")), *map(_FRACTION, ("max_kelly_fraction", "max_risk_per_trade", "fractional_kelly")), ("stop_loss_pct >= 0 AND stop_loss_pct <= 1", "stop_loss_pct must be between 0 and 1")]))
def kelly_settings_check(spark, sf_dir):
    return limits.first_complaint(_settings(spark, sf_dir, **_KELLY_SETTINGS), limits.KELLY_RISK).select("s_suppkey", "complaint")


_BASE_SETTINGS = {"max_position_size": "cast(s_suppkey % 12 AS double) / 10", "max_risk_per_trade": "cast(s_nationkey % 12 AS double) / 10"}


@register(_complaint_sql(_BASE_SETTINGS, [*map(_FRACTION, ("max_position_size", "max_risk_per_trade")), ("max_risk_per_trade <= max_position_size", "max_risk_per_trade ({max_risk_per_trade}) cannot exceed max_position_size ({max_position_size})")]))
def risk_relationship_check(spark, sf_dir):
    return limits.first_complaint(_settings(spark, sf_dir, **_BASE_SETTINGS), limits.RISK_BASE).select("s_suppkey", "complaint")


@register("SELECT l_linestatus, CASE WHEN NOT l_shipdate::DATE <= DATE '1993-01-01' + (l_orderkey % 1500)::INT THEN 'start date must not be after end date' END AS complaint, count(*) AS n FROM lineitem GROUP BY 1, 2")
def date_range_check(spark, sf_dir):
    dates = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", F.col("l_shipdate").cast("date").alias("start"), F.expr("date_add(DATE '1993-01-01', cast(l_orderkey % 1500 AS int))").alias("end"))
    return limits.first_complaint(dates, limits.DATES).groupBy("l_linestatus", "complaint").agg(F.count("*").alias("n"))


@register(Q.chain(*_GRID_RESULTS) + f"SELECT combo_id::BIGINT AS combo_id, symbol, {_RESULT_COLUMNS} FROM results ORDER BY results.win_rate DESC, combo_id, symbol LIMIT 5")
def grid_optimizer_top_k(spark, sf_dir):
    """The search object, made by its factory."""
    return _results(create_optimizer("grid", orders_bars(spark, sf_dir), GRID, engine=ENGINE, sort_by="win_rate").optimize(5), "combo_id", "symbol")


@register(Q.chain(*_WF_RESULTS) + f"SELECT r.symbol, r.period, {Q.when('p.test_start')} AS test_start, {Q.when('p.test_end')} AS test_end, p.n_rows AS test_data_points FROM results r JOIN periods p ON p.symbol = r.symbol AND p.period = r.period")
def walk_forward_metadata(spark, sf_dir):
    return R.walk_forward(orders_bars(spark, sf_dir), _WF_STRATEGY).select("symbol", "period", "test_start", "test_end", "test_data_points")


@register(Q.chain(Q.ORDERS_BARS) + "SELECT symbol, sim, count(*) AS n, round(sum(close), 4) AS total FROM (SELECT symbol, sim, close, row_number() OVER (PARTITION BY symbol, sim ORDER BY md5('42|' || sim || '|' || epoch_us(ts))) AS place, count(*) OVER (PARTITION BY symbol, sim) AS whole FROM bars CROSS JOIN range(3) s(sim)) WHERE place <= floor(whole * 0.8::DOUBLE) GROUP BY symbol, sim")
def mc_plain_samples(spark, sf_dir):
    """Samples of single rows, as series shorter than a block get them."""
    return R.plain_samples(orders_bars(spark, sf_dir), 3).groupBy("symbol", "sim").agg(F.count("*").alias("n"), F.round(F.sum("close"), 4).alias("total"))


@register(Q.chain(*_TRADED) + f"SELECT symbol, {_TRADE_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_idx) AS place FROM trades) WHERE place <= 5")
def first_trades(spark, sf_dir):
    return sinks.first_trades(trades(_simulated(spark, sf_dir))).drop(*_EXTRA)


@register(Q.chain(Q.DIRTY_BARS) + f"SELECT symbol, {Q.when('ts')} AS ts, " + ", ".join(f"round(CASE WHEN NOT isinf({c}) AND NOT isnan({c}) THEN {c} END, 6) AS {c}" for c in VALUES) + ", seq FROM dirty")
def export_without_infinities(spark, sf_dir):
    return sinks.without_infinities(dirty_bars(spark, sf_dir))


@register(Q.chain(*_GRID_RESULTS) + f"SELECT combo_id::BIGINT AS combo_id, symbol, {Q.r6('final_capital', 'sharpe_ratio', 'win_rate')}, total_trades FROM results ORDER BY results.total_return_pct DESC, combo_id, symbol LIMIT 10")
def search_json(spark, sf_dir):
    """A search's results file, read again."""
    found = ranked(_grid(spark, sf_dir), "total_return", 10)
    schema = "results array<struct<combo_id:bigint,symbol:string,final_capital:double,sharpe_ratio:double,win_rate:double,total_trades:bigint>>"
    write = lambda f: (os.makedirs(f.removeprefix("file://")), sinks.results_json(found, f"{f.removeprefix('file://')}/found.json"))
    return _again(spark, "json", write, lambda f: spark.read.schema(schema).option("multiLine", True).json(f).select(F.explode("results").alias("r")).select("r.*"))


@register(Q.chain(*_RESULTS) + f"SELECT symbol, {Q.r6('final_capital', 'max_drawdown', 'win_rate')}, total_trades, 'run-1' AS backtest_id FROM results WHERE symbol = '{_ONE}'")
def csv_sink_metadata(spark, sf_dir):
    """The CSV sink's JSON file: metadata of the run's result."""
    schema = "symbol string, final_capital double, max_drawdown double, win_rate double, total_trades bigint, backtest_id string"

    def write(folder: str) -> None:
        manager = sinks.SinkManager()
        manager.add_named(["csv"], output_dir=folder.removeprefix("file://"))
        manager.export(_run_one(spark, sf_dir), "run-1")

    return _again(spark, "sink", write, lambda f: spark.read.schema(schema).option("multiLine", True).json(f"{f}/*_metadata.json"))


@register(Q.chain(*_CURVE, Q.pairs("symbol")) + f"SELECT 'barwright-backtests' AS index, 1::BIGINT AS n UNION ALL SELECT 'barwright-portfolio', count(*) FROM curve WHERE symbol = '{_ONE}' UNION ALL SELECT 'barwright-trades', count(*) FROM trades WHERE symbol = '{_ONE}' UNION ALL SELECT 'barwright-positions', count(*) FROM pairs WHERE symbol = '{_ONE}'")
def document_index_counts(spark, sf_dir):
    """What the index admin sees of an export."""
    folder = scratch(spark, "index")
    try:
        sinks.DocumentSink(path=folder.removeprefix("file://")).export(_run_one(spark, sf_dir), "run-1", {})
        counts = sinks.IndexAdmin(sinks.FolderIndex(folder.removeprefix("file://"))).counts()
    finally:
        discard(spark, folder)
    return spark.createDataFrame(sorted(counts.items()), "index string, n long")


# downloads through clients that make up their candles


def _candles(symbol: str, frame: str, since: int, limit: int) -> list[list[float]]:
    """Daily candles of 2024 from ``since`` on."""
    first, day = 1_704_067_200_000, 86_400_000
    start = max(0, -(-(since - first) // day))
    return [[first + day * n, 100 + n % 7, 110 + n % 7, 90 + n % 7, 101 + n % 5, 1000 + n] for n in range(start, min(366, start + limit))]


_CANDLES_SQL = "SELECT '{s}' AS symbol, strftime(TIMESTAMP '2024-01-01' + to_days(n::INT), '%Y-%m-%d %H:%M:%S') AS ts, (100 + n % 7)::DOUBLE AS open, (110 + n % 7)::DOUBLE AS high, (90 + n % 7)::DOUBLE AS low, (101 + n % 5)::DOUBLE AS close, (1000 + n)::DOUBLE AS volume FROM range({a}, {b}) t(n)"


@register(_CANDLES_SQL.format(s="BTC/USDT", a=31, b=335))
def exchange_download(spark, sf_dir):
    """Pages of a hundred candles, put together."""
    day, first = 86_400_000, 1_704_067_200_000
    source = ExchangeSource({"made": _candles})
    return source.download(spark, "made", "BTC/USDT", source.timeframes()[-3], first + 31 * day, first + 334 * day, limit=100)


@register("SELECT strftime(TIMESTAMP '2024-01-01' + to_days(n::INT), '%Y-%m-%d %H:%M:%S') AS Date, (100 + n % 7)::DOUBLE AS Open, (110 + n % 7)::DOUBLE AS High, (90 + n % 7)::DOUBLE AS Low, (101 + n % 5)::DOUBLE AS Close, (1000 + n)::DOUBLE AS Volume FROM range(366) t(n)")
def quote_download(spark, sf_dir):
    """Daily quotes whose columns come in two levels and another order."""

    def fetch(ticker: str, start: str, end: str, interval: str) -> pd.DataFrame:
        rows = _candles(ticker, interval, 0, 366)
        names = ("Open", "High", "Low", "Close", "Volume")
        frame = pd.DataFrame([[float(x) for x in r[:0:-1]] for r in rows], index=pd.to_datetime([r[0] for r in rows], unit="ms"))
        frame.columns = pd.MultiIndex.from_tuples([(n, ticker) for n in reversed(names)])
        return frame

    return QuoteSource(fetch).download(spark, "MADE", "2024-01-01", "2024-12-31", "1d")


@register(Q.chain(*_CLEAN, Q.filled("c1", "c2"), Q.price_rules("c2", "c3"), Q.quality("c3", "c4")) + f"SELECT {Q.when('ts')} AS ts, {Q.r6(*VALUES)} FROM c4 WHERE symbol = '{_ONE}'")
def csv_clean_file(spark, sf_dir):
    """A dirty file cleaned into another one."""
    dirty = dirty_bars(spark, sf_dir).where(F.col("symbol") == _ONE)

    def write(folder: str) -> None:
        dirty.coalesce(1).sortWithinPartitions("seq").select(F.col("ts").alias("timestamp"), *VALUES).write.options(**files.CSV).csv(f"{folder}/dirty")
        if not files.clean_file(spark, f"{folder}/dirty", f"{folder}/clean"):
            raise ValueError("the file can't be cleaned")

    return _again(spark, "csv", write, lambda f: files.load_for_backtest(spark, f"{f}/clean", symbol=_ONE).select("ts", *VALUES))
