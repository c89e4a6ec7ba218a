"""Remote sources of bars behind injected clients, and a Python data source for paged ones.

Nothing here opens a connection: a client is a callable, so pages can come from an exchange,
a file or a test.
"""

from __future__ import annotations

import json
import logging
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barwright.session import cut

#: The time frames of either source.
EXCHANGE_FRAMES = ["1m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w", "1M"]
QUOTE_FRAMES = ["1m", "2m", "5m", "15m", "30m", "60m", "90m", "1h", "1d", "5d", "1wk", "1mo", "3mo"]
CANDLE = "ts_ms long, open double, high double, low double, close double, volume double"
Fetch = Callable[[str, str, int, int], list[list[float]]]


class Source(ABC):
    frames: list[str] = []

    @abstractmethod
    def download(self, spark: SparkSession, *args: Any, **kwargs: Any) -> DataFrame | None: ...

    def supports(self, timeframe: str) -> bool:
        return timeframe in self.frames

    def timeframes(self) -> list[str]:
        return list(self.frames)


def pages(fetch: Fetch, symbol: str, timeframe: str, start_ms: int, end_ms: int, limit: int = 1000) -> Iterator[list[float]]:
    """Candles up to ``end_ms``; the next page starts one after the last time, and an empty, short or late page is the last."""
    since = start_ms
    while True:
        page = fetch(symbol, timeframe, since, limit)
        yield from (c for c in page if c[0] <= end_ms)
        if not page or page[-1][0] >= end_ms or len(page) < limit:
            return
        since = int(page[-1][0]) + 1


class ExchangeSource(Source):
    """Exchange candles by page; repeated candles stay, and any failure gives None."""

    frames = EXCHANGE_FRAMES

    def __init__(self, clients: dict[str, Fetch] | None = None) -> None:
        self.clients = clients or {}

    def exchanges(self) -> list[str]:
        return sorted(self.clients)

    def download(self, spark: SparkSession, exchange: str, symbol: str, timeframe: str, start_ms: int, end_ms: int, limit: int = 1000) -> DataFrame | None:
        if not self.supports(timeframe):
            logging.error("unknown time frame %r; there are %s", timeframe, self.frames)
            return None
        try:
            fetch = self.clients[exchange]
            candles = cut(self.fetched(spark, fetch, symbol, timeframe, start_ms, end_ms, limit))
            if not candles.take(1):
                return None
        except Exception as error:  # noqa: BLE001
            logging.error("can't download from %s: %s", exchange, error)
            return None
        return candles.select(F.lit(symbol).alias("symbol"), F.timestamp_millis("ts_ms").alias("ts"), "open", "high", "low", "close", "volume")


    @staticmethod
    def fetched(spark: SparkSession, fetch: Fetch, symbol: str, timeframe: str, start_ms: int, end_ms: int, limit: int) -> DataFrame:
        """Candles of one task, which follows the pages in turn and hands them on one by one; the driver holds none."""

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = pages(fetch, symbol, timeframe, start_ms, end_ms, limit) if batch.num_rows else ()
                candles = ((int(c[0]), *map(float, c[1:6])) for c in found if c[0] >= start_ms)
                while part := list(islice(candles, limit)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=[f.split(" ")[0] for f in CANDLE.split(", ")])

        return spark.range(1, numPartitions=1).mapInArrow(follow, CANDLE)


class QuoteSource(Source):
    """Daily quotes: names flattened to their first level, in the fixed order, those that are there."""

    frames = QUOTE_FRAMES
    ORDER = ("Open", "High", "Low", "Close", "Volume")

    def __init__(self, fetch: Callable[[str, str, str, str], Any] | None = None, normalize: bool = True) -> None:
        self.fetch, self.normalize = fetch, normalize

    def download(self, spark: SparkSession, ticker: str, start: str, end: str, interval: str) -> DataFrame | None:
        if not self.supports(interval) or self.fetch is None:
            logging.error("unknown interval %r or no client", interval)
            return None
        try:
            frame = self.fetch(ticker, start, end, interval)
        except Exception as error:  # noqa: BLE001
            logging.error("can't download %s: %s", ticker, error)
            return None
        if frame is None or not len(frame):
            return None
        frame = frame.copy()
        frame.columns = [c[0] if isinstance(c, tuple) else c for c in frame.columns]
        frame.index.name = "Date"
        return self.projected(spark.createDataFrame(frame.reset_index()))

    def projected(self, df: DataFrame) -> DataFrame:
        kept = [c for c in self.ORDER if c in df.columns] if self.normalize else [c for c in df.columns if c != "Date"]
        return df.select("Date", *kept)


class CandleSource(DataSource):
    """``spark.read.format("candles")``: pages from JSON files, one partition each, read on executors.

    Options: paths (comma-joined), start_ms, end_ms. Each file holds a list of candles.
    """

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return CANDLE

    def reader(self, schema: Any) -> DataSourceReader:
        return _CandleReader(self.options)


class _CandleReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options.get("paths", "").split(",") if p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = int(self.options.get("start_ms", 0)), int(self.options.get("end_ms", 1 << 62))
        with open(partition.value) as f:
            for c in json.load(f):
                if low <= c[0] <= high:
                    yield (int(c[0]), *map(float, c[1:6]))
