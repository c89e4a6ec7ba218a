"""Steps, fold, risk, search and robustness on small frames, with the engine's known values and traps."""

import datetime as dt
import math
import random
import sys
import time
import warnings

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barwright.functions import metrics as M
from barwright.functions import stats as S
from barwright.operators import robustness as R
from barwright.operators.cleaning import Cleaner, FillNulls, GapReport, InfiniteToNull, OhlcRules, QualityRules, Step, default_cleaner
from barwright.operators.fold import Engine, dealt, run_backtest, simulate, trades, trades_sql
from barwright.operators import limits
from barwright.operators.risk import FixedRisk, KellyRisk, Position, RiskManager, book_summary
from barwright.operators.search import MA_SPACE, METRICS, GridSearch, ParameterSpace, RandomSearch, Parameter, SearchResult, as_objects, best_by_metric, combo_runs, combo_table, create_optimizer, evaluate, ranked
from barwright.operators.signals import GivenSignals, MaCrossover
from barwright.operators.validation import validate_bars, validate_monte_carlo, validate_position_sizes, validate_walk_forward

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this file
BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, seq long"
DAY = dt.datetime(2024, 1, 1)
INF = float("inf")


def five(**changes):
    """Five clean daily bars, with cells replaced: name={row: value}."""
    rows = [{"symbol": "X", "ts": DAY + dt.timedelta(days=i), "open": 100.0 + i, "high": 105.0 + i, "low": 95.0 + i, "close": 102.0 + i, "volume": 1000.0 + 100 * i, "seq": i} for i in range(5)]
    for name, cells in changes.items():
        for i, v in cells.items():
            rows[i][name] = v
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in BAR.split(", ")) for r in rows], BAR)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("seq").collect()]


# cleaning


def test_infinite(spark):
    df = frame(spark, five(high={0: INF}, low={1: -INF}, close={2: float("nan")}))
    assert InfiniteToNull().counts(df).first().asDict() == {"open": 0, "high": 1, "low": 1, "close": 0, "volume": 0}
    out = rows_of(InfiniteToNull().process(df), "high", "low", "close")
    assert out[0][0] is None and out[1][1] is None and out[2][2] is None and out[3] == (108.0, 98.0, 105.0)


def test_fill(spark):
    assert [r[0] for r in rows_of(FillNulls().process(frame(spark, five(high={1: None}, close={2: None}))), "high")] == [105.0, 105.0, 107.0, 108.0, 109.0]
    assert rows_of(FillNulls().process(frame(spark, five(open={0: None}, high={0: None}))), "open", "high")[0] == (101.0, 106.0)
    assert FillNulls().process(frame(spark, five(open={i: None for i in range(5)}))).count() == 0
    assert FillNulls().process(frame(spark, five(open={0: float("nan")})[:1])).count() == 0


def test_fill_goes_by_source_order(spark):
    rows = five(ts={0: DAY + dt.timedelta(days=9)}, close={1: None})
    assert rows_of(FillNulls().process(frame(spark, rows)), "close")[1] == (102.0,)


def test_ohlc(spark):
    df = frame(spark, five(high={0: 90.0, 1: None}))
    assert OhlcRules().process(df).count() == 4  # a null price breaks no rule
    assert OhlcRules().counts(df).first()["rows_broken"] == 1
    assert not OhlcRules().fits(df.drop("high")) and OhlcRules().process(df.drop("high")).count() == 5
    assert OhlcRules().fits(df.withColumnRenamed("high", "High"))


def test_quality(spark):
    q = QualityRules()
    assert q.process(frame(spark, five(open={0: -10.0}, high={1: -5.0}))).count() == 3
    assert q.process(frame(spark, five(open={0: 0.0}))).count() == 4
    assert q.process(frame(spark, five(volume={0: -1.0, 1: 0.0}))).count() == 4
    assert q.process(frame(spark, five(open={0: None}, volume={1: None}))).count() == 5  # nulls stay where nothing is bad
    assert q.process(frame(spark, five(open={0: None, 1: -1.0}))).count() == 3  # and go where something is
    assert q.process(frame(spark, five(open={0: -1.0}, high={0: -1.0, 1: None}))).count() == 4  # judged on what is left
    kept = q.process(frame(spark, five(ts={3: DAY})))
    assert sorted(r.seq for r in kept.collect()) == [0, 1, 2, 4]


def test_gaps(spark):
    df = frame(spark, [r for i, r in enumerate(five()) if i != 2])
    gaps = GapReport().gaps(df).collect()
    assert [(g.gap_start, g.gap_end, g.gap_micros) for g in gaps] == [(DAY + dt.timedelta(days=1), DAY + dt.timedelta(days=3), 2 * 86_400_000_000)]
    assert GapReport().completeness(df).first()["completeness"] == 80.0
    assert not GapReport().can_process(df.limit(1))
    uneven = frame(spark, five(ts={1: DAY + dt.timedelta(hours=1), 2: DAY + dt.timedelta(hours=3)})[:3])
    assert GapReport().completeness(uneven).first()["usual_micros"] == 3_600_000_000  # the smaller step on a tie


def test_cleaner(spark):
    class Broken(Step):
        name = "broken"

        def process(self, df):
            raise RuntimeError("no")

    step = InfiniteToNull()
    cleaner = Cleaner(step, step, Broken(), OhlcRules())
    assert cleaner.names() == ["infinite values", "broken", "price rules"] and cleaner.add(step) is cleaner
    assert cleaner.run(frame(spark, five(high={0: 90.0}))).count() == 4
    assert cleaner.remove(step) and not cleaner.remove(step)
    assert cleaner.runnable(frame(spark, five()).drop("low")) == ["broken"]
    cleaner.clear()
    assert cleaner.names() == []
    assert default_cleaner().names() == ["infinite values", "missing values", "price rules", "quality", "time gaps"]
    mixed = frame(spark, five(high={0: INF, 3: 90.0}, low={1: None}, close={2: -10.0}))
    assert sorted(r.seq for r in default_cleaner(audit=True).run(mixed).collect()) == [0, 1, 4]


# validation


@pytest.mark.parametrize(
    "changes, message",
    [({"open": {0: None}}, "Column 'open' contains null values"), ({"close": {1: 0.0}}, "Column 'close' contains non-positive values"), ({"volume": {1: -1.0}}, "Column 'volume' contains negative values"), ({"high": {0: 90.0, 1: 90.0}}, "Found 2 rows with invalid OHLC relationships"), ({"ts": {0: DAY + dt.timedelta(days=9)}}, "Data index must be sorted in ascending order"), ({"symbol": dict.fromkeys(range(5), "")}, "Symbol must be a non-empty string")],
)
def test_validation_messages(spark, changes, message):
    with pytest.raises(ValueError, match=message):
        validate_bars(frame(spark, five(**changes)))


def test_validation_order(spark):
    df = frame(spark, five())
    validate_bars(df)
    validate_bars(frame(spark, five(ts={1: DAY})))  # equal times are in order
    for bad, message in ((df.limit(0), "empty"), (df.limit(1), "at least 2 rows"), (df.drop("low"), "Missing required columns"), (df.withColumn("open", F.lit("x")), "must be numeric"), (df.withColumn("ts", F.lit("x")), "DatetimeIndex")):
        with pytest.raises(ValueError, match=message):
            validate_bars(bad)
    with pytest.raises(ValueError, match="Strategy"):
        validate_bars(df, None)
    with pytest.raises(ValueError, match="null values"):  # the first column's complaint comes before later ones
        validate_bars(frame(spark, five(open={0: None}, volume={0: -1.0}, high={0: 1.0})))
    with pytest.raises(ValueError, match="got 1.5"):
        validate_position_sizes(df.withColumn("position_size", F.lit(1.5)))
    for call in (lambda: validate_walk_forward(0, 3), lambda: validate_walk_forward(6, 0), lambda: validate_walk_forward(6, 3, 99), lambda: validate_monte_carlo(0, 0.8, 30), lambda: validate_monte_carlo(1, 1.5, 30), lambda: validate_monte_carlo(1, 0.8, 0), lambda: validate_monte_carlo(1, 0.8, 30, 50)):
        with pytest.raises(ValueError):
            call()
    assert validate_monte_carlo(10, 0.8, 60, 100) == 60 and validate_monte_carlo(10, 0.8, 100, 100) == 25  # shortened only where it would hold all rows


# signals and fold


def ramp(n=10, **cells):
    rows = [{"symbol": "X", "ts": DAY + dt.timedelta(days=i), "open": 100.0 + i, "high": 101.0 + i, "low": 99.0 + i, "close": 100.5 + i, "volume": 1000.0, "seq": i, "signal": cells.get("signal", {}).get(i, 0), "position_size": cells.get("size", {}).get(i, 1.0)} for i in range(n)]
    for i, v in cells.get("close", {}).items():
        rows[i] |= {"close": v, "low": min(v, rows[i]["low"]), "high": max(v, rows[i]["high"])}
    return rows


def given(spark, rows):
    names = [*(c.split(" ")[0] for c in BAR.split(", ")), "signal", "position_size"]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], BAR + ", signal int, position_size double")


def test_crossover_earliest_row(spark):
    close = [10, 9, 8, 7, 6, 7, 9, 12, 15, 11, 8, 5, 3, 2.0]
    df = spark.createDataFrame([("X", DAY + dt.timedelta(days=i), float(c)) for i, c in enumerate(close)], "symbol string, ts timestamp, close double")
    out = MaCrossover(2, 4, 0.5).signals(df).orderBy("row_idx").collect()
    mean = lambda i, n: sum(close[i - n + 1 : i + 1]) / n if i >= n - 1 else None
    for i, r in enumerate(out):
        want = 0
        if i >= 4:
            s, l, ps, pl = mean(i, 2), mean(i, 4), mean(i - 1, 2), mean(i - 1, 4)
            want = 1 if s > l and ps <= pl else -1 if s < l and ps >= pl else 0
        assert r.signal == want and r.position_size == 0.5
    assert {r.signal for r in out} == {-1, 0, 1}
    for bad in ((0, 5, 1.0), (5, 5, 1.0), (5, 10, 1.5)):
        with pytest.raises(ValueError):
            MaCrossover(*bad)


def test_two_trades(spark):
    sim = run_backtest(given(spark, ramp(signal={1: 1, 5: -1})), GivenSignals())
    done = trades(sim).orderBy("row_idx").collect()
    assert [(t.side, t.price) for t in done] == [("buy", 101.5), ("sell", 105.5)]
    r = M.summarize(sim).first()
    assert r.total_trades == 2 and r.total_return > 0 and r.win_rate == 100 and math.isinf(r.profit_factor) and r.max_drawdown <= 0


def test_order_cases():
    e = Engine()
    assert e.bought(10000.0, 0.5, 100.0)[1] == pytest.approx(4995.005, abs=1e-3)
    assert e.bought(50.0, 1.0, 100.0) is None and e.bought(1000.0, 1.0, 100.0) is None  # the last bit
    assert e.bought(10000.0, 1.0, 100.0) is not None
    assert e.sold(10.0, 0.5, 100.0) == (5.0, 500.0) and e.sold(0.001, 1.0, 100.0) is None
    for bad in ((0, 0.001, 1), (1, -1, 1), (1, 0, -1)):
        with pytest.raises(ValueError):
            Engine(*bad)


def test_bad_size_is_a_failed_run(spark):
    rows = given(spark, ramp(size={3: 1.5})).unionByName(given(spark, ramp(signal={1: 1})).withColumn("symbol", F.lit("Y")))
    out = {r.symbol: r for r in M.summarize(simulate(GivenSignals().signals(rows))).collect()}
    assert "1.5" in out["X"].error and out["Y"].error is None and out["Y"].total_trades == 1


class Allow(RiskManager):
    """Always this size and stop."""

    def __init__(self, size, stop=None):
        self.size, self.stop = size, stop
        super().__init__({"max_risk_per_trade": 1.0})

    def position_size(self, signal, price, value, held, choose=None):
        return self.size

    def stop_price(self, entry, signal, choose=None):
        return self.stop

    def closes(self, price, entry, stop, signal, pnl=0.0):
        return price <= stop, "stop"


def test_risk_managed(spark):
    made = lambda risk, **cells: trades(run_backtest(given(spark, ramp(**cells)), GivenSignals(risk))).orderBy("row_idx").collect()
    assert abs(made(Allow(0.3), signal={1: 1})[0].value - 10000 * 0.3 / 1.001) < 1e-9
    assert made(Allow(1.5), signal={1: 1}) == []  # blocked
    hit = made(Allow(0.5, 102.0), signal={1: 1}, close={4: 101.0})
    assert [(t.row_idx, t.side, t.reason) for t in hit] == [(1, "buy", None), (4, "sell", "stop")]
    assert hit[-1].price == 101.0  # at the close, not at the stop


def test_first_bar_order_under_risk_fails(spark):
    out = M.summarize(run_backtest(given(spark, ramp(signal={0: 1})), GivenSignals(Allow(0.3)))).first()
    assert "first bar" in out.error


def test_fixed_sell_closes_a_share_of_the_position(spark):
    """A sell's size is the held share of the portfolio, taken of the position."""
    done = trades(run_backtest(given(spark, ramp(signal={1: 1, 5: -1})), GivenSignals(FixedRisk(0.2, 0.05)))).orderBy("row_idx").collect()
    assert len(done) == 1  # the share has grown over the limit by then, so the sell is blocked
    done = trades(run_backtest(given(spark, ramp(signal={1: 1, 5: -1}, close={5: 100.0})), GivenSignals(FixedRisk(0.2, 0.05)))).orderBy("row_idx").collect()
    assert len(done) == 2 and done[1].quantity < 0.25 * done[0].quantity


def brute_fold(rows, e):
    cash, pos, out = e.initial_capital, 0.0, []
    for r in rows:
        p, s, z = r["close"], r["signal"], r["position_size"]
        if s == 1 and cash > 0:
            v = cash * z / (1 + e.commission)
            if v >= e.min_order_value and cash >= v + v * e.commission:
                cash -= v + v * e.commission
                pos += v / p
                out.append(("buy", v / p, v, cash, pos))
        elif s == -1 and pos > 0:
            q = pos * z
            if q * p >= e.min_order_value and q > 0:
                cash += q * p - q * p * e.commission
                pos -= q
                out.append(("sell", q, q * p, cash, pos))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_folds_agree_and_hold_their_invariants(spark, seed):
    g = random.Random(seed)
    rows = ramp(120, signal={i: g.choice((-1, 0, 0, 1)) for i in range(120)}, size={i: g.choice((0.2, 0.5, 0.9, 1.0)) for i in range(120)}, close={i: g.uniform(5, 500) for i in range(120)})
    engine = Engine(g.choice((10000.0, 1000.0, 777.7)), g.choice((0.001, 0.0, 0.002)))
    signals = GivenSignals().signals(given(spark, rows))
    sim = simulate(signals, engine=engine)
    cells = ("side", "quantity", "value", "cash", "position")
    one = [tuple(t[c] for c in cells) for t in trades(sim).orderBy("row_idx").collect()]
    two = [tuple(t[c] for c in cells) for t in trades_sql(signals, engine=engine).orderBy("row_idx").collect()]
    assert one == two == brute_fold(rows, engine)
    for r in M.equity_curve(sim).collect():
        assert r.portfolio_value == r.cash + r.position * r.close and r.cash >= -1e-9 and r.position >= 0
    pairs, wins = fifo([(t[0], r["close"], t[1]) for t, r in zip(one, [rows[t.row_idx] for t in trades(sim).orderBy("row_idx").collect()])])
    got = M.win_rate(trades(sim)).first()
    assert (got.pairs, got.wins) == (pairs, wins)


def fifo(events):
    lots, pairs, wins = [], 0, 0
    for side, price, quantity in events:
        if side == "buy":
            lots.append([price, quantity])
            continue
        left = quantity
        while left > 0 and lots:
            pairs += 1
            wins += price > lots[0][0]
            if lots[0][1] <= left:
                left -= lots.pop(0)[1]
            else:
                lots[0][1] -= left
                left = 0
    return pairs, wins


def test_fold_orders_stored_signals(spark, tmp_path):
    """Signals that were shuffled and written give the same trades, whatever partitions they come back in."""
    rows = ramp(400, signal={i: (1, -1, 0)[i % 3] for i in range(400)}, size=dict.fromkeys(range(400), 0.3))
    both = given(spark, rows).unionByName(given(spark, rows).withColumn("symbol", F.lit("Y")))
    signals = GivenSignals().signals(both)
    signals.repartition(5, F.xxhash64("ts")).write.parquet(str(tmp_path / "signals"))
    stored = spark.read.parquet(str(tmp_path / "signals"))
    cells = ("symbol", "row_idx", "side", "quantity", "cash")
    want = [tuple(t[c] for c in cells) for t in trades(simulate(signals)).orderBy("symbol", "row_idx").collect()]
    assert want and [tuple(t[c] for c in cells) for t in trades(simulate(stored)).orderBy("symbol", "row_idx").collect()] == want
    assert {t[0] for t in want} == {"X", "Y"}


def test_runs_of_one_symbol_are_dealt_to_many_tasks(spark):
    bars = saw(spark, 400)
    combos = [{"short_window": s, "long_window": l, "position_size": p} for s in (3, 4, 5) for l in (8, 10, 15) for p in (0.5, 0.9)]
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(combo_runs(bars, combo_table(spark, combos))) > 1
    periods = R.walk_forward_periods(bars, 2, 1)
    keys = ("symbol", "period")
    assert tasks(simulate(MaCrossover(3, 12, 0.5).signals(R.walk_forward_bars(bars, periods), keys), keys)) > 1
    assert tasks(dealt(bars.withColumn("n", F.col("seq") % 20), ("symbol", "n"))) > 1


def test_long_runs_take_linear_time(spark):
    """Twenty thousand buys, then as many sells: lots, trades and the JVM fold within seconds each."""
    n = 20_000
    events = spark.range(2 * n).select(F.lit("X").alias("symbol"), F.col("id").cast("int").alias("row_idx"), F.when(F.col("id") < n, "buy").otherwise("sell").alias("side"), (100.0 + F.col("id") % 7).alias("price"), F.lit(1.0).alias("quantity"))
    r = M.win_rate(events).first()
    assert (r.pairs, r.wins) == (n, sum((100 + (n + i) % 7) > (100 + i % 7) for i in range(n)))
    signals = spark.range(2 * n).select(F.lit("X").alias("symbol"), F.col("id").cast("int").alias("row_idx"), F.timestamp_seconds("id").alias("ts"), (100.0 + F.col("id") % 7).alias("close"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("signal"), F.lit(0.01).alias("position_size"))
    began = time.perf_counter()
    assert trades_sql(signals).agg(F.count("*"), F.sum("value")).first() == trades(simulate(signals)).agg(F.count("*"), F.sum("value")).first()
    assert time.perf_counter() - began < 60


def test_lots_of_the_fold_equal_those_of_its_trades(spark):
    rows = ramp(300, signal={i: (1, 1, 0, -1)[i % 4] for i in range(300)}, size=dict.fromkeys(range(300), 0.4), close={i: 50.0 + (i * 37) % 91 for i in range(300)})
    done = trades(simulate(GivenSignals().signals(given(spark, rows))))
    counted, matched = M.win_rate(done).first(), M.win_rate(done.drop("lots_matched", "lots_won")).first()
    assert counted == matched and counted.pairs > 50


def test_settings_tables(spark):
    table = spark.createDataFrame([(1.0, 0.0, 1.0), (0.0, -1.0, 1.0), (1.0, 0.0, -1.0), (None, 0.0, 0.0)], "initial_capital double, commission double, min_order_value double")
    got = [r.complaint for r in limits.first_complaint(table, limits.ENGINE).collect()]
    assert got == [None, "Initial capital must be positive", "Minimum order value cannot be negative", None]
    held = spark.createDataFrame([("A", 0.1), ("B", -0.2), ("C", 0.0)], "symbol string, size double")
    assert book_summary(held).first().asDict() == {"total_positions": 2, "total_exposure": pytest.approx(0.3), "long_positions": 1, "short_positions": 1, "average_position_size": pytest.approx(0.15)}
    decided = spark.createDataFrame([(1, 100.0, 0.0), (-1, 100.0, 0.05), (-1, 100.0, 0.2), (0, 100.0, 0.0)], "signal int, price double, held double")
    f = FixedRisk(0.1, 0.05)
    rows = decided.withColumns(f.decision_columns(F.col("signal"), F.col("price"), F.col("held"), F.lit(0.0), F.lit(0))).collect()
    for r in rows:
        d = f.evaluate(r.signal, r.price, 1.0, r.held)
        assert (r.decided_size, r.stop_price, r.max_risk, r.allowed) == (d.size, d.stop, d.max_risk, d.allowed)


def test_win_rate_by_lots(spark):
    def rate(*events):
        df = spark.createDataFrame([("X", i, s, float(p), float(q)) for i, (s, q, p) in enumerate(events)], "symbol string, row_idx int, side string, price double, quantity double")
        return M.win_rate(df).first()["win_rate"]

    assert rate(("buy", 10, 100), ("sell", 10, 110), ("buy", 5, 120), ("sell", 5, 115)) == 50
    assert rate(("buy", 10, 100), ("sell", 5, 110), ("sell", 5, 90)) == 50
    assert rate(("buy", 10, 100), ("buy", 5, 120), ("sell", 12, 115)) == 50
    assert rate(("buy", 10, 100)) == 0


def test_pairing_and_pnl(spark):
    rows = [("X", 0, "buy", 1.0, 100.0), ("X", 1, "buy", 1.0, 80.0), ("X", 2, "sell", 1.0, 90.0), ("X", 3, "sell", 1.0, 70.0), ("X", 4, "buy", 1.0, 50.0), ("X", 5, "sell", 1.0, 20.0)]
    df = spark.createDataFrame([(s, i, DAY + dt.timedelta(days=i), side, 1.0, q, v) for s, i, side, q, v in rows], "symbol string, row_idx int, ts timestamp, side string, price double, quantity double, value double")
    got = M.closed_positions(df).orderBy("position_no").collect()
    assert [(p.position_no, p.pnl, p.is_win, p.duration_days) for p in got] == [(1, 10.0, True, 1.0), (2, -30.0, False, 1.0)]
    assert M.closed_positions(df).agg(*[c.alias(n) for n, c in M.pnl_statistics(F.col("pnl")).items()]).first().asDict() == {"profit_factor": 10 / 30, "average_win": 10.0, "average_loss": 30.0, "largest_win": 10.0, "largest_loss": 30.0, "num_winning_trades": 1, "num_losing_trades": 1}


def test_curve_statistics(spark):
    values = [100.0, 110.0, 99.0, 120.0] + [120.0 + i % 7 for i in range(40)]
    sim = spark.createDataFrame([("X", i, DAY + dt.timedelta(days=i), 1.0, v, 0.0, None, None) for i, v in enumerate(values)], "symbol string, row_idx int, ts timestamp, close double, cash double, position double, side string, error string")
    curve = M.rolling_statistics(M.equity_curve(sim)).orderBy("row_idx").collect()
    ret = np.diff(values) / values[:-1]
    assert curve[2].drawdown_pct == pytest.approx(-10) and curve[29].rolling_sharpe_30d is None and curve[30].rolling_sharpe_30d is not None
    last = ret[-30:]
    assert curve[-1].rolling_volatility_30d == pytest.approx(last.std(ddof=1) * math.sqrt(252) * 100)
    assert curve[-1].rolling_sharpe_30d == pytest.approx(last.mean() * 252 / (last.std(ddof=1) * math.sqrt(252)))


# risk


def test_fixed_risk_values():
    f = FixedRisk(0.1, 0.05)
    d = f.evaluate(1, 100.0, 10000.0)
    assert d.allowed and d.size == 0.1 and d.stop == 95.0 and d.max_risk == pytest.approx(0.005)
    d = f.evaluate(-1, 100.0, 10000.0, 0.05)
    assert d.stop == 105.0 and d.max_risk == pytest.approx(0.0025) and d.size == 0.05
    assert not f.evaluate(0, 100.0, 1.0).allowed and not f.evaluate(-1, 100.0, 1.0, 0.2).allowed
    assert f.closes(95.0, 100.0, 95.0, 1)[0] and not f.closes(96.0, 100.0, 95.0, 1)[0] and f.closes(105.0, 100.0, 105.0, -1)[0]
    assert f.closes(1.0, 2.0, None, 1) == (False, "No stop loss set")
    for s, v in (("A", 0.1), ("B", -0.2), ("C", 0.05)):
        f.book.put(s, Position(v, 100.0))
    assert f.book.exposure() == pytest.approx(0.35) and f.book.summary()["long_positions"] == 2 and f.book.get("B").size == -0.2
    f.book.put("A", Position(0.0, 100.0))
    f.book.pop("B")
    assert list(f.book) == ["C"] and f.metrics()["current_positions"] == 1 and f.fresh().book == {}
    for i in range(5):
        f.book.put(str(i), Position(0.01, 1.0))
    assert not f.evaluate(1, 100.0, 1.0).allowed  # too many positions


def test_risk_settings():
    for bad in ((0, 0.05), (1.5, 0.05), (0.1, -0.1), (0.5, 0.5)):
        with pytest.raises(ValueError):
            FixedRisk(*bad)
    with pytest.raises(ValueError, match="cannot exceed"):
        FixedRisk(0.01, 0.05, 5, 0.02)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        FixedRisk(0.06, 0.3, 40, 0.05)
    assert len(caught) == 2
    k = KellyRisk()
    for call in (lambda: k.position_size(1, 1.0, 1.0, 0.0), lambda: k.stop_price(1.0, 1), lambda: k.closes(1.0, 1.0, None, 1)):
        with pytest.raises(NotImplementedError):
            call()
    assert k.metrics()["max_kelly_fraction"] == 0.25
    with pytest.raises(ValueError):
        KellyRisk(lookback_periods=0)


# search


def test_parameter_space(spark):
    assert MA_SPACE.size() == 1632 and MA_SPACE.suggested_samples() == 163
    assert Parameter("float", 0.1, 0.5, 0.1).values() == [0.1, 0.2, 0.3, 0.4, 0.5] and Parameter("int", 1, 6, 2).values() == [1, 3, 5]
    space = ParameterSpace({"a": {"type": "int", "min": 1, "max": 6, "step": 2}, "b": {"type": "choice", "choices": ["x", "y"]}})
    assert [(r.a, r.b) for r in space.grid(spark).orderBy("combo_id").limit(3).collect()] == [(1, "x"), (1, "y"), (3, "x")]
    free = ParameterSpace({"a": {"type": "float", "min": 0.0, "max": 1.0}})
    assert free.size() == math.inf and free.suggested_samples() == 10_000
    with pytest.raises(ValueError):
        free.grid(spark)
    assert all(0 <= r.a < 1 for r in free.random(spark, 20, seed=1).collect())
    for bad in ({"a": {}}, {"a": {"type": "int", "min": 1}}, {"a": {"type": "int", "min": 2, "max": 1}}, {"a": {"type": "choice"}}, {"a": {"type": "choice", "choices": []}}, {"a": {"type": "x"}}):
        with pytest.raises(ValueError):
            ParameterSpace(bad)
    drawn = MA_SPACE.random(spark, 50, seed=1).orderBy("combo_id").collect()
    assert drawn == MA_SPACE.random(spark, 50, seed=1).orderBy("combo_id").collect() and len({tuple(r)[1:] for r in drawn}) == 50 and [r.combo_id for r in drawn] == list(range(50))
    assert ParameterSpace({"b": {"type": "choice", "choices": [1, 2]}}).random(spark, 30, seed=1).count() == 2  # stops on repeats
    stepped = ParameterSpace({"a": {"type": "float", "min": 0.25, "max": 1.0, "step": 0.2}}).random(spark, 5, seed=0).collect()
    assert {r.a for r in stepped} <= {0.2, 0.4, 0.6, 0.8, 1.0}  # multiples of the step, even below the minimum


def saw(spark, n=100):
    rows = [("X", DAY + dt.timedelta(days=i), (c := 100 + 0.1 * i + 0.5 * (i % 10)) + 0.1, c + 0.5, c - 0.5, c, 1000.0 + 10 * i, i) for i in range(n)]
    return spark.createDataFrame(rows, BAR)


def test_search(spark):
    bars = saw(spark)
    combos = [{"short_window": s, "long_window": l, "position_size": p} for s in (3, 5) for l in (4, 15) for p in (0.5, 0.9)]
    found = evaluate(bars, combos).cache()
    assert {r.combo_id for r in found.collect()} == {0, 1, 2, 3, 6, 7}  # 5 over 4 is no strategy
    for r in found.collect():
        c = combos[r.combo_id]
        alone = M.summarize(run_backtest(bars, MaCrossover(**c))).first()
        assert (r.final_capital, r.total_trades, r.sharpe_ratio, r.win_rate) == (alone.final_capital, alone.total_trades, alone.sharpe_ratio, alone.win_rate)
    values = [r.max_drawdown for r in ranked(found, "max_drawdown").collect()]
    assert values == sorted(values)  # the worst comes first
    assert [r.total_return_pct for r in ranked(found, "nonsense", 2).collect()] == sorted([r.total_return_pct for r in found.collect()], reverse=True)[:2]
    one = next(as_objects(ranked(found, "win_rate")))
    assert set(one.parameters) == {"short_window", "long_window", "position_size"}
    for wrong in ((None, 1), ({}, None)):
        with pytest.raises(ValueError):
            SearchResult(*wrong)
    best = {r.metric: r for r in best_by_metric(found).collect()}
    assert set(best) == set(METRICS) and best["total_trades"].value == max(r.total_trades for r in found.collect())
    space = ParameterSpace({"short_window": {"type": "int", "min": 3, "max": 4}, "long_window": {"type": "int", "min": 10, "max": 11}})
    assert GridSearch(bars, space).optimize().count() == 4
    search = GridSearch(bars, space)
    assert len(search.best(3)) == 3 and search.stop() is None and search.tag not in spark.getTags()
    for limit in (100_000, 3):  # by broadcast, and by slots
        mp = pytest.MonkeyPatch()
        mp.setattr("barwright.operators.search.BROADCAST_COMBOS", limit)
        assert sorted((r.combo_id, r.final_capital) for r in evaluate(bars, combos).collect()) == sorted((r.combo_id, r.final_capital) for r in found.collect())
        mp.undo()
    assert create_optimizer("random", bars, space, n_trials=2, seed=3).optimize(1).count() == 1
    assert isinstance(create_optimizer("random", bars, space), RandomSearch)
    for bad in (lambda: create_optimizer("x", bars, space), lambda: GridSearch(bars, space, sort_by="x"), lambda: GridSearch(bars.drop("low"), space)):
        with pytest.raises(ValueError):
            bad()


# robustness


def test_periods_clip_month_ends(spark):
    rows = [("X", dt.datetime(2023, 12, 31) + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0, i) for i in range(240)]
    got = [(p.period, p.test_start.date().isoformat(), p.test_end.date().isoformat()) for p in R.walk_forward_periods(spark.createDataFrame(rows, BAR), 2, 1).orderBy("period").collect()]
    assert got[:4] == [(1, "2023-12-31", "2024-02-29"), (2, "2024-01-31", "2024-03-31"), (3, "2024-02-29", "2024-04-29"), (4, "2024-03-29", "2024-05-29")]
    assert R.walk_forward_periods(spark.createDataFrame(rows[:20], BAR), 2, 1).count() == 0


def test_walk_forward_restarts_indicators(spark):
    bars = saw(spark, 400)
    got = R.walk_forward(bars, MaCrossover(3, 12, 0.5), window_months=3, step_months=3).orderBy("period").collect()
    for r in got:
        part = bars.where((F.col("ts") >= F.lit(r.test_start)) & (F.col("ts") < F.lit(r.test_end)))
        alone = M.summarize(run_backtest(part, MaCrossover(3, 12, 0.5))).first()
        assert (r.final_capital, r.total_trades, r.n_bars) == (alone.final_capital, alone.total_trades, r.test_data_points)
    assert len(got) >= 3


def test_monte_carlo(spark):
    bars = saw(spark, 200)
    plan = R.sample_plan(bars, 4)
    assert {(r.block_rows, r.n_samples) for r in plan.collect()} == {(30, 160)} and plan.count() == 4 * 5
    drawn = R.samples(bars, plan)
    assert drawn.groupBy("sim").count().select("count").distinct().collect()[0][0] == 150
    first = R.monte_carlo(bars, MaCrossover(3, 12, 0.5), simulations=4).orderBy("sim").collect()
    assert [r.final_capital for r in first] == [r.final_capital for r in R.monte_carlo(bars.repartition(3), MaCrossover(3, 12, 0.5), simulations=4).orderBy("sim").collect()]
    seeded = R.sample_plan_random(bars, "X", 2, seed=7)
    g = random.Random(7)
    assert [r.start_idx for r in seeded.orderBy("sim", "block_no").collect()] == [g.randint(0, 170) for _ in range(10)]
    assert R.monte_carlo(bars, MaCrossover(3, 12, 0.5), plan=seeded).count() == 2
    assert R.plain_samples(bars, 2).groupBy("sim").count().first()["count"] == 160
    assert R.monte_carlo(saw(spark, 55), MaCrossover(3, 12, 0.5), simulations=2).count() == 0  # under fifty bars
    short = saw(spark, 120).withColumn("symbol", F.lit("Y")).unionByName(saw(spark, 300))
    whole = R.drawn_bars(short, 2, block_rows=150, whole_blocks=True)  # Y is shorter than a block: single rows
    assert {(r.symbol, r.n) for r in whole.groupBy("symbol", "sim").agg(F.count("*").alias("n")).collect()} == {("X", 150), ("Y", 96)}
    assert R.monte_carlo(short, MaCrossover(3, 12, 0.5), simulations=2, block_rows=150, whole_blocks=True).count() == 4


def results(spark, values):
    rows = [("X", i + 1, float(v), v / 100.0, v / 50.0, -abs(v) / 10.0, 50.0, 4, DAY, DAY, 1.0, 2.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, period int, total_return double, total_return_pct double, sharpe_ratio double, max_drawdown double, win_rate double, total_trades int, start_date timestamp, end_date timestamp, initial_capital double, final_capital double")


def test_statistics(spark):
    df = results(spark, [100, 200, 300, 400, 500])
    s = S.stability_metrics(df).first()
    assert s.temporal_stability == 1.0 and s.return_consistency == pytest.approx(300 / np.std([100, 200, 300, 400, 500]))
    assert s.rolling_mean_stability == pytest.approx(1 / (1 + np.std([150, 250, 350, 450])))
    assert S.stability_metrics(results(spark, [1, 5, 1, 5, 1])).first().temporal_stability == 0.0
    assert S.stability_metrics(results(spark, [1, 5])).first().temporal_stability == 1.0 and S.stability_metrics(results(spark, [1, 5])).first().rolling_mean_stability is None
    long = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3]
    assert S.stability_metrics(results(spark, long)).first().rolling_mean_stability == pytest.approx(1 / (1 + np.std([np.mean(long[i : i + 4]) for i in range(7)])))
    m = S.monte_carlo_metrics(df).first()
    assert m.mean_return == 300 and m.median_return == 300 and m.positive_return_pct == 100 and m.worst_max_drawdown == -10 and m.best_max_drawdown == -50
    x = np.array(long, dtype=float)
    d = S.distribution(results(spark, long)).first()
    n, z = len(x), (x - x.mean()) / x.std(ddof=1)
    assert d.return_skewness == pytest.approx(n / ((n - 1) * (n - 2)) * (z**3).sum())
    assert d.return_kurtosis == pytest.approx(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (z**4).sum() - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    assert d.return_var_5pct == pytest.approx(np.percentile(x, 5)) and d.return_cvar_5pct == pytest.approx(x[x <= np.percentile(x, 5)].mean()) and d.return_ci_95_upper == pytest.approx(np.percentile(x, 97.5))
    assert S.distribution(results(spark, [1, 1])).first().return_skewness == 0
    assert {r.metric: r.p25 for r in S.percentile_table(df).collect()}["total_return"] == 200
    t = {r.metric: r for r in S.summary_statistics(df).collect()}["total_return"]
    assert (t["mean"], t["median"], t["count"]) == (300, 300, 5) and t["std"] == pytest.approx(np.std([100, 200, 300, 400, 500], ddof=1))
    assert S.summary_statistics(results(spark, [1])).first()["std"] is None
    assert S.consistency(df).first().positive_periods_pct == 100
    assert [r.period for r in S.result_table(df, "total_return").orderBy("period").collect()] == [1, 2, 3, 4, 5]
    assert S.success_rate(df, 10).first().success_rate == 50
    assert S.long_form(S.consistency(df)).count() == 2
    v = S.result_vectors(df, "period").first()
    assert v.total_returns == [100, 200, 300, 400, 500] and len(v.sharpe_ratios) == 5
    w = S.walk_forward_metrics(df, spark.createDataFrame([("X", 0.1), ("X", 0.2), ("X", None)], "symbol string, ret double")).first()
    assert w.total_periods == 5 and w.combined_sharpe_ratio == pytest.approx(math.sqrt(252) * 0.15 / np.std([0.1, 0.2], ddof=1))
