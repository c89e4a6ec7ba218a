"""DuckDB fragments for the oracles: each is one or more common table expressions."""

from __future__ import annotations

ORDERS_BARS = """bars AS MATERIALIZED (
  SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
  FROM orders GROUP BY 1, 2)"""

EVENTS_BARS = """bars AS MATERIALIZED (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""

DIRTY_BARS = (
    ORDERS_BARS.replace("bars AS", "clean_bars AS")
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS seq FROM clean_bars),
dirty AS MATERIALIZED (
  SELECT symbol, CASE WHEN seq % 71 = 0 THEN coalesce(lag(ts) OVER (PARTITION BY symbol ORDER BY seq), ts) ELSE ts END AS ts,
         CASE WHEN seq % 79 = 0 THEN -open ELSE open END AS open, CASE WHEN seq % 83 = 0 THEN low - 1 ELSE high END AS high, low,
         CASE WHEN seq % 97 = 0 THEN NULL ELSE close END AS close, CASE WHEN seq % 89 = 0 THEN 'inf'::DOUBLE ELSE volume END AS volume, seq
  FROM numbered)"""
)

VALUES = ("open", "high", "low", "close", "volume")

#: Cleaning steps, each from the table before.
INFINITE = "c1 AS (SELECT symbol, ts, " + ", ".join(f"CASE WHEN isinf({c}) OR isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in VALUES) + ", seq FROM dirty)"


def filled(source: str, name: str) -> str:
    fill = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in VALUES
    )
    some = " AND ".join(f"{c} IS NOT NULL" for c in VALUES)
    return f"{name} AS (SELECT * FROM (SELECT symbol, ts, {fill}, seq FROM {source}) WHERE {some})"


BROKEN = "(high < low OR high < open OR high < close OR low > open OR low > close)"


def price_rules(source: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM {source} WHERE NOT coalesce({BROKEN}, false))"


def quality(source: str, name: str) -> str:
    out, last = [], source
    for i, c in enumerate(VALUES):
        good = f"{c} >= 0" if c == "volume" else f"{c} > 0"
        out.append(f"{name}_{i} AS (SELECT symbol, ts, open, high, low, close, volume, seq FROM (SELECT *, bool_or(coalesce(NOT ({good}), false)) OVER (PARTITION BY symbol) AS bad FROM {last}) WHERE NOT bad OR coalesce({good}, false))")
        last = f"{name}_{i}"
    out.append(f"{name} AS (SELECT symbol, ts, open, high, low, close, volume, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) AS n FROM {last}) WHERE n = 1)")
    return ", ".join(out)


def signals(keys: str, short: str, long: str, size: str, source: str = "bars", order: str = "ts") -> str:
    """``sig``: bars with means, row_idx, signal and position size."""
    def mean(n: str) -> str:
        frame = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count(close) {frame} >= {n} THEN avg(close) {frame} END"

    w = f"OVER (PARTITION BY {keys} ORDER BY {order})"
    return f"""means AS (SELECT *, {mean(short)} AS ma_short, {mean(long)} AS ma_long, row_number() {w} - 1 AS row_idx FROM {source}),
sig AS MATERIALIZED (SELECT *, CASE WHEN ma_short > ma_long AND lag(ma_short) {w} <= lag(ma_long) {w} THEN 1
         WHEN ma_short < ma_long AND lag(ma_short) {w} >= lag(ma_long) {w} THEN -1 ELSE 0 END AS signal, {size}::DOUBLE AS position_size FROM means)"""


def fold(keys: str, capital: str = "10000.0", commission: str = "0.001", least: str = "1.0") -> str:
    """``trades`` of ``sig`` without risk management, folded over the rows with a signal."""
    same = " AND ".join(f"e.{k} = f.{k}" for k in keys.split(", "))
    e_keys = ", ".join(f"e.{k}" for k in keys.split(", "))
    return f"""ev AS MATERIALIZED (SELECT {keys}, row_idx, ts, close, signal, position_size AS ps, row_number() OVER (PARTITION BY {keys} ORDER BY row_idx) AS i FROM sig WHERE signal <> 0),
folded AS (
  SELECT DISTINCT {keys}, 0::BIGINT AS i, NULL::BIGINT AS row_idx, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS price, 0 AS act, {capital}::DOUBLE AS cash, 0.0::DOUBLE AS position, 0.0::DOUBLE AS quantity, 0.0::DOUBLE AS value FROM ev
  UNION ALL
  SELECT {keys}, i, row_idx, ts, close, act, CASE act WHEN 1 THEN cash - (tv + tv * {commission}::DOUBLE) WHEN -1 THEN cash + (sq * close - sq * close * {commission}::DOUBLE) ELSE cash END,
         CASE act WHEN 1 THEN position + tv / close WHEN -1 THEN position - sq ELSE position END,
         CASE act WHEN 1 THEN tv / close WHEN -1 THEN sq ELSE 0 END, CASE act WHEN 1 THEN tv WHEN -1 THEN sq * close ELSE 0 END
  FROM (SELECT *, CASE WHEN signal = 1 AND cash > 0 AND tv >= {least}::DOUBLE AND cash >= tv + tv * {commission}::DOUBLE THEN 1
                       WHEN signal = -1 AND position > 0 AND sq * close >= {least}::DOUBLE AND sq > 0 THEN -1 ELSE 0 END AS act
        FROM (SELECT {e_keys}, e.i, e.row_idx, e.ts, e.close, e.signal, f.cash, f.position, f.cash * e.ps / (1 + {commission}::DOUBLE) AS tv, f.position * e.ps AS sq
              FROM folded f JOIN ev e ON {same} AND e.i = f.i + 1))),
trades AS MATERIALIZED (SELECT {keys}, row_idx, ts, CASE act WHEN 1 THEN 'buy' ELSE 'sell' END AS side, price, quantity, value, cash, position FROM folded WHERE act <> 0)"""


def fold_fixed_risk(size: str, stop: str, most: str, risk: str, capital: str = "10000.0", commission: str = "0.001", least: str = "1.0") -> str:
    """``trades`` of ``sig`` under a fixed risk manager: the whole state, bar by bar."""
    return f"""ev AS MATERIALIZED (SELECT symbol, row_idx, ts, close, signal FROM sig),
folded AS (
  SELECT DISTINCT symbol, -1::BIGINT AS row_idx, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS price, 0 AS act, {capital}::DOUBLE AS cash, 0.0::DOUBLE AS position, NULL::DOUBLE AS stop, NULL::DOUBLE AS book, {capital}::DOUBLE AS worth, 0.0::DOUBLE AS quantity, 0.0::DOUBLE AS value FROM ev
  UNION ALL
  SELECT symbol, row_idx, ts, close, act, cash, position,
         CASE WHEN act = 1 THEN new_stop WHEN act = -2 OR (act = -1 AND abs(position) < 0.005) THEN NULL ELSE stop END,
         CASE WHEN act = 1 OR (act = -1 AND abs(position) >= 0.005) THEN CASE WHEN abs(CASE WHEN worth > 0 THEN position / worth ELSE 0 END) < 1e-10::DOUBLE THEN NULL ELSE CASE WHEN worth > 0 THEN position / worth ELSE 0 END END
              WHEN act IN (-1, -2) THEN NULL ELSE book END,
         cash + position * close, quantity, value
  FROM (SELECT symbol, row_idx, ts, close, act, new_stop, stop, book, worth,
               CASE act WHEN 1 THEN cash - (tv + tv * {commission}::DOUBLE) WHEN 0 THEN cash ELSE cash + (CASE act WHEN -2 THEN position ELSE position * ps END * close - CASE act WHEN -2 THEN position ELSE position * ps END * close * {commission}::DOUBLE) END AS cash,
               CASE act WHEN 1 THEN position + tv / close WHEN -2 THEN 0 WHEN -1 THEN position - position * ps ELSE position END AS position,
               CASE act WHEN 1 THEN tv / close WHEN -2 THEN position WHEN -1 THEN position * ps ELSE 0 END AS quantity,
               CASE act WHEN 1 THEN tv WHEN -2 THEN position * close WHEN -1 THEN position * ps * close ELSE 0 END AS value
        FROM (SELECT *, CASE WHEN position <> 0 AND stop IS NOT NULL AND close <= stop AND position * close >= {least}::DOUBLE AND position > 0 THEN -2
                             WHEN s = 1 AND cash > 0 AND tv >= {least}::DOUBLE AND cash >= tv + tv * {commission}::DOUBLE THEN 1
                             WHEN s = -1 AND position > 0 AND position * ps * close >= {least}::DOUBLE AND position * ps > 0 THEN -1 ELSE 0 END AS act
              FROM (SELECT *, CASE WHEN ok THEN signal ELSE 0 END AS s, CASE WHEN ok THEN want ELSE 0 END AS ps, cash * CASE WHEN ok THEN want ELSE 0 END / (1 + {commission}::DOUBLE) AS tv
                    FROM (SELECT *, signal <> 0 AND want <= {size}::DOUBLE AND abs(close - new_stop) / close * want <= {risk}::DOUBLE AND abs(coalesce(book, 0)) + want <= {most} * {size}::DOUBLE AND (CASE WHEN book IS NULL THEN 0 ELSE 1 END) < {most} AS ok
                          FROM (SELECT e.symbol, e.row_idx, e.ts, e.close, e.signal, f.cash, f.position, f.stop, f.book, f.worth,
                                       CASE e.signal WHEN 1 THEN {size}::DOUBLE WHEN -1 THEN abs(CASE WHEN f.cash + f.position * e.close > 0 THEN f.position * e.close / (f.cash + f.position * e.close) ELSE 0 END) ELSE 0 END AS want,
                                       CASE e.signal WHEN 1 THEN e.close * (1 - {stop}::DOUBLE) WHEN -1 THEN e.close * (1 + {stop}::DOUBLE) END AS new_stop
                                FROM folded f JOIN ev e ON e.symbol = f.symbol AND e.row_idx = f.row_idx + 1)))))),
trades AS MATERIALIZED (SELECT symbol, row_idx, ts, CASE act WHEN 1 THEN 'buy' ELSE 'sell' END AS side, price, quantity, value, cash, position, act = -2 AS stopped FROM folded WHERE act <> 0)"""


def curve(keys: str, capital: str = "10000.0") -> str:
    """``curve``: every bar of ``sig`` with worth, peak, drawdown and return."""
    w = f"OVER (PARTITION BY {keys} ORDER BY row_idx)"
    join = " AND ".join(f"t.{k} = s.{k}" for k in keys.split(", "))
    s_keys = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""held AS (SELECT {s_keys}, s.row_idx, s.ts, s.close, t.side, t.quantity, t.value, coalesce(last_value(t.cash IGNORE NULLS) OVER (PARTITION BY {s_keys} ORDER BY s.row_idx), {capital}::DOUBLE) AS cash, coalesce(last_value(t.position IGNORE NULLS) OVER (PARTITION BY {s_keys} ORDER BY s.row_idx), 0) AS position
  FROM sig s LEFT JOIN trades t ON {join} AND t.row_idx = s.row_idx),
worths AS (SELECT *, cash + position * close AS portfolio_value FROM held),
curve AS MATERIALIZED (SELECT *, max(portfolio_value) {w} AS running_peak, (portfolio_value - max(portfolio_value) {w}) / max(portfolio_value) {w} AS drawdown, portfolio_value / nullif(lag(portfolio_value) {w}, 0) - 1 AS ret FROM worths)"""


def pairs(keys: str) -> str:
    """``pairs``: sells right after a buy, with the buy."""
    w = f"OVER (PARTITION BY {keys} ORDER BY row_idx)"
    return f"""befores AS (SELECT *, lag(side) {w} AS b_side, lag(ts) {w} AS b_ts, lag(price) {w} AS b_price, lag(quantity) {w} AS b_quantity, lag(value) {w} AS b_value FROM trades),
pairs AS (SELECT *, value - b_value AS pnl FROM befores WHERE side = 'sell' AND b_side = 'buy')"""


def fifo(keys: str) -> str:
    """``fifo``: lots and sales overlap in cumulative quantity."""
    on = " AND ".join(f"b.{k} = s.{k}" for k in keys.split(", "))
    b_keys = ", ".join(f"b.{k}" for k in keys.split(", "))
    run = f"sum(quantity) OVER (PARTITION BY {keys}, side ORDER BY row_idx)"
    return f"""cum AS (SELECT *, {run} AS hi, {run} - quantity AS lo FROM trades),
fifo AS (SELECT {b_keys}, count(*) AS pairs, count(*) FILTER (WHERE s.price > b.price) AS wins FROM cum b JOIN cum s ON {on} AND b.side = 'buy' AND s.side = 'sell'
  AND least(b.hi, s.hi) - greatest(b.lo, s.lo) > 1e-12::DOUBLE * greatest(b.hi, 1e-6) GROUP BY {b_keys})"""


def results(keys: str, capital: str = "10000.0") -> str:
    """``results`` from curve, pairs and fifo: one row for each run."""
    on = lambda t: " AND ".join(f"{t}.{k} = c.{k}" for k in keys.split(", "))
    c_keys = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""c AS (SELECT {keys}, min(ts) AS start_date, max(ts) AS end_date, arg_max(portfolio_value, row_idx) AS final_capital, min(drawdown) * 100 AS max_drawdown,
         CASE WHEN count(ret) > 1 AND stddev_samp(ret) > 0 THEN sqrt(252::DOUBLE) * avg(ret) / stddev_samp(ret) ELSE 0 END AS sharpe_ratio, count(side) AS total_trades, count(*) AS n_bars FROM curve GROUP BY {keys}),
p AS (SELECT {keys}, sum(pnl) FILTER (WHERE pnl > 0) AS gain, -sum(pnl) FILTER (WHERE pnl < 0) AS loss, avg(pnl) FILTER (WHERE pnl > 0) AS average_win, -avg(pnl) FILTER (WHERE pnl < 0) AS average_loss,
         max(pnl) AS top, -min(pnl) AS low, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses FROM pairs GROUP BY {keys}),
results AS (SELECT {c_keys}, start_date, end_date, final_capital, final_capital - {capital}::DOUBLE AS total_return, (final_capital - {capital}::DOUBLE) / {capital}::DOUBLE * 100 AS total_return_pct, max_drawdown, sharpe_ratio,
         coalesce(100.0::DOUBLE * f.wins / f.pairs, 0) AS win_rate, total_trades, CASE WHEN p.loss > 0 THEN coalesce(p.gain, 0) / p.loss WHEN p.gain > 0 THEN NULL ELSE 0 END AS profit_factor,
         coalesce(p.average_win, 0) AS average_win, coalesce(p.average_loss, 0) AS average_loss, greatest(coalesce(CASE WHEN p.wins > 0 THEN p.top END, 0), 0) AS largest_win, greatest(coalesce(CASE WHEN p.losses > 0 THEN p.low END, 0), 0) AS largest_loss,
         coalesce(p.wins, 0) AS num_winning_trades, coalesce(p.losses, 0) AS num_losing_trades, n_bars
  FROM c LEFT JOIN p ON {on("p")} LEFT JOIN fifo f ON {on("f")})"""


def chain(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def when(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
