"""Streaming extension: bars from ticks under a watermark, and the fold carried between batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barwright.operators.fold import Engine, _Run

TRADES = "symbol string, ts timestamp, side string, price double, quantity double, value double, cash double, position double, late_rows long"
STATE = "cash double, position double, last timestamp"


def ticks(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of (symbol, ts, event_id, value)."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def stream_bars(rows: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars of fixed windows; a window's bar comes once the watermark has passed it."""
    held = rows.withWatermark("ts", late).groupBy("symbol", F.window("ts", width))
    bars = held.agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_fold(signals: DataFrame, engine: Engine = Engine()) -> DataFrame:  # noqa: B008
    """Trades of a stream of (symbol, ts, close, signal, position_size), cash and position held as state.

    Rows of a batch go in order of time. Rows no newer than the last one folded can't be
    folded any more; a batch that has some gives one more row, without a side, with their
    number in ``late_rows``. A null signal is none, a null size is 1.
    """

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = _Run(engine, None, str(key[0]))
        last = None
        if state.exists:
            run.cash, run.position, last = state.get
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        if last is not None:
            late = rows["ts"] <= pd.Timestamp(last)
            if late.any():
                out.append((key[0], pd.Timestamp(last), None, None, None, None, run.cash, run.position, int(late.sum())))
            rows = rows[~late]
        for r in rows.itertuples(index=False):
            made = run.step(r.ts, r.close, 0 if pd.isna(r.signal) else int(r.signal), 1.0 if pd.isna(r.position_size) else float(r.position_size))
            if made:
                out.append((key[0], r.ts, made[0], r.close, made[1], made[2], run.cash, run.position, 0))
        if len(rows):
            last = rows["ts"].iloc[-1].to_pydatetime()
        state.update((run.cash, run.position, last))
        yield pd.DataFrame(out, columns=["symbol", "ts", "side", "price", "quantity", "value", "cash", "position", "late_rows"])

    return signals.groupBy("symbol").applyInPandasWithState(fold, TRADES, STATE, "append", GroupStateTimeout.NoTimeout)
