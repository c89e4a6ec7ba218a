"""Sinks: export frames, console, files, document index, and their registry.

A run's results, trades and equity are DataFrames; the document frames have the same shape
whether they go to an index or to files.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import os
import re
import shutil
import time
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.functions.metrics import closed_positions, rolling_statistics

#: The fields of the four document types.
MAPPINGS: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(f, t()) for f, t in fields.items()])
    for name, fields in {
        "backtests": {"backtest_id": T.StringType, "strategy_name": T.StringType, "symbol": T.StringType, "start_date": T.TimestampType, "end_date": T.TimestampType, "initial_capital": T.DoubleType, "final_capital": T.DoubleType, "total_return": T.DoubleType, "total_return_pct": T.DoubleType, "max_drawdown": T.DoubleType, "sharpe_ratio": T.DoubleType, "win_rate": T.DoubleType, "total_trades": T.LongType, "profit_factor": T.DoubleType, "average_win": T.DoubleType, "average_loss": T.DoubleType, "largest_win": T.DoubleType, "largest_loss": T.DoubleType, "num_winning_trades": T.LongType, "num_losing_trades": T.LongType, "commission": T.DoubleType, "created_at": T.TimestampType},
        "portfolio": {"backtest_id": T.StringType, "timestamp": T.TimestampType, "portfolio_value": T.DoubleType, "drawdown_pct": T.DoubleType, "rolling_sharpe_30d": T.DoubleType, "rolling_volatility_30d": T.DoubleType, "created_at": T.TimestampType},
        "trades": {"backtest_id": T.StringType, "timestamp": T.TimestampType, "symbol": T.StringType, "side": T.StringType, "price": T.DoubleType, "quantity": T.DoubleType, "value": T.DoubleType, "created_at": T.TimestampType},
        "positions": {"backtest_id": T.StringType, "position_id": T.StringType, "symbol": T.StringType, "entry_timestamp": T.TimestampType, "exit_timestamp": T.TimestampType, "entry_price": T.DoubleType, "exit_price": T.DoubleType, "quantity": T.DoubleType, "entry_value": T.DoubleType, "exit_value": T.DoubleType, "pnl": T.DoubleType, "pnl_pct": T.DoubleType, "duration_days": T.DoubleType, "duration_hours": T.DoubleType, "is_win": T.BooleanType, "created_at": T.TimestampType},
    }.items()
}


@dataclass
class Run:
    """What a sink gets: one-row results, trades (with symbol), and the equity curve."""

    results: DataFrame
    trades: DataFrame
    equity: DataFrame


def run_id() -> str:
    """Made once on the driver; never inside a plan, which may run again."""
    return str(uuid.uuid4())


def without_infinities(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null, inside structs and arrays of structs too."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        return c

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _stamped(df: DataFrame, backtest_id: str, created_at: dt.datetime | None) -> DataFrame:
    return df.withColumns({"backtest_id": F.lit(backtest_id), "created_at": F.lit(created_at or dt.datetime.now(dt.timezone.utc)).cast("timestamp")})


def metadata_frame(results: DataFrame, backtest_id: str, commission: float = 0.001, created_at: dt.datetime | None = None) -> DataFrame:
    rows = _stamped(results, backtest_id, created_at).withColumn("commission", F.lit(float(commission)))
    return without_infinities(rows.select(*[c for c in MAPPINGS["backtests"].names if c in rows.columns]))


def portfolio_frame(curve: DataFrame, backtest_id: str, created_at: dt.datetime | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    rows = _stamped(rolling_statistics(curve, keys), backtest_id, created_at).withColumnRenamed("ts", "timestamp")
    return without_infinities(rows.select("backtest_id", *keys, "timestamp", "portfolio_value", "drawdown_pct", "rolling_sharpe_30d", "rolling_volatility_30d", "created_at"))


def trades_frame(trades: DataFrame, backtest_id: str, created_at: dt.datetime | None = None) -> DataFrame:
    return _stamped(trades, backtest_id, created_at).withColumnRenamed("ts", "timestamp").select(*MAPPINGS["trades"].names)


def positions_frame(trades: DataFrame, backtest_id: str, created_at: dt.datetime | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    rows = _stamped(closed_positions(trades, keys), backtest_id, created_at).withColumn("position_id", F.concat(F.lit(f"{backtest_id}-pos-"), F.col("position_no")))
    return without_infinities(rows.select(*MAPPINGS["positions"].names))


def first_trades(trades: DataFrame, n: int = 5, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The first trades of each run."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx"))
    return trades.withColumn("trade_place", place).where(F.col("trade_place") <= n).drop("trade_place")


def validate_run(run: Run) -> bool:
    """False without equity; a run without trades only warns."""
    if not run.equity.take(1):
        logging.warning("no portfolio values to export")
        return False
    if not run.trades.take(1):
        logging.warning("no trades to export")
    return True


class Sink(ABC):
    name = "sink"

    def __init__(self, **config: Any) -> None:
        self.config = config

    @abstractmethod
    def export(self, run: Run, backtest_id: str, metadata: dict[str, Any]) -> None: ...


class ConsoleSink(Sink):
    name = "console"

    def export(self, run: Run, backtest_id: str, metadata: dict[str, Any]) -> None:
        for row in run.results.limit(20).collect():
            print(f"{row['strategy_name']} on {row['symbol']}: {row['start_date']:%Y-%m-%d} to {row['end_date']:%Y-%m-%d}")
            for c in ("initial_capital", "final_capital", "total_return", "total_return_pct", "max_drawdown", "sharpe_ratio", "win_rate", "total_trades"):
                print(f"  {c}: {row[c]:,.2f}" if isinstance(row[c], float) else f"  {c}: {row[c]}")
        for t in first_trades(run.trades).orderBy("symbol", "row_idx").limit(20).collect():
            print(f"  {t['ts']:%Y-%m-%d} {t['side'].upper()} {t['quantity']:.4f} at {t['price']:.2f}")


class CsvSink(Sink):
    """metadata.json, equity and trades as CSV folders; ``single`` writes one file each."""

    name = "csv"

    def __init__(self, output_dir: str = ".", single: bool = False, **config: Any) -> None:
        super().__init__(**config)
        self.output_dir, self.single = output_dir, single

    def set_output_directory(self, output_dir: str) -> None:
        self.output_dir = output_dir

    def base_name(self, metadata: dict[str, Any], backtest_id: str) -> str:
        day = lambda v: v.strftime("%Y%m%d") if hasattr(v, "strftime") else str(v)
        parts = [metadata.get("symbol") or "UNKNOWN", metadata.get("strategy_name") or "strategy", day(metadata.get("start_date", "")), day(metadata.get("end_date", "")), backtest_id[:8]]
        return "_".join(re.sub(r"[^\w.-]+", "-", str(p)) for p in parts)

    def export(self, run: Run, backtest_id: str, metadata: dict[str, Any]) -> None:
        if not validate_run(run):
            raise ValueError("invalid backtest result")
        base = f"{self.output_dir}/{self.base_name(metadata, backtest_id)}"
        stamp = F.lit(backtest_id).alias("backtest_id")
        self._write(run.equity.select(F.col("ts").alias("timestamp"), "portfolio_value", stamp), f"{base}_equity")
        if run.trades.take(1):
            self._write(run.trades.select(F.col("ts").alias("timestamp"), "symbol", "side", "price", "quantity", "value", stamp), f"{base}_trades")
        os.makedirs(self.output_dir, exist_ok=True)
        with open(f"{base}_metadata.json", "w") as f:
            json.dump(metadata | {"backtest_id": backtest_id}, f, indent=2, default=str)

    def _write(self, df: DataFrame, path: str) -> None:
        (df.coalesce(1) if self.single else df).write.mode("overwrite").option("header", True).csv(path)


class IndexClient(Protocol):
    """What a document store has to offer; an Elasticsearch client is wrapped in this."""

    def ping(self) -> bool: ...
    def indices(self) -> list[str]: ...
    def create(self, index: str, mapping: dict[str, Any]) -> None: ...
    def bulk(self, index: str, documents: Iterable[dict[str, Any]]) -> int: ...
    def count(self, index: str) -> int: ...
    def size(self, index: str) -> int: ...
    def delete(self, index: str) -> None: ...


class FolderIndex:
    """An index client over a shared folder: one folder an index, its mapping, and a file of JSON lines for each bulk write."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _files(self, index: str) -> list[str]:
        folder = os.path.join(self.path, index)
        return sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".jsonl")) if os.path.isdir(folder) else []

    def ping(self) -> bool:
        try:
            os.makedirs(self.path, exist_ok=True)
        except OSError:
            return False
        return os.access(self.path, os.W_OK)

    def indices(self) -> list[str]:
        return sorted(n for n in os.listdir(self.path) if os.path.isdir(os.path.join(self.path, n))) if os.path.isdir(self.path) else []

    def create(self, index: str, mapping: dict[str, Any]) -> None:
        os.makedirs(os.path.join(self.path, index), exist_ok=True)
        with open(os.path.join(self.path, index, "mapping.json"), "w") as f:
            json.dump(mapping, f, indent=2)

    def bulk(self, index: str, documents: Iterable[dict[str, Any]]) -> int:
        """Write under a name of its own, then rename, so a task that is run again leaves no half file."""
        written, name = 0, os.path.join(self.path, index, uuid.uuid4().hex)
        with open(f"{name}.part", "w") as f:
            for document in documents:
                f.write(json.dumps(document, default=str) + "\n")
                written += 1
        os.replace(f"{name}.part", f"{name}.jsonl")
        return written

    def count(self, index: str) -> int:
        return sum(1 for name in self._files(index) for _ in open(name))

    def size(self, index: str) -> int:
        return sum(os.path.getsize(name) for name in self._files(index))

    def delete(self, index: str) -> None:
        shutil.rmtree(os.path.join(self.path, index))


#: Field types of the document store.
FIELD_TYPES = {T.StringType: "keyword", T.TimestampType: "date", T.DoubleType: "double", T.LongType: "long", T.BooleanType: "boolean"}


def mapping(kind: str) -> dict[str, Any]:
    """The mapping of a document type."""
    return {"mappings": {"properties": {f.name: {"type": FIELD_TYPES[type(f.dataType)]} for f in MAPPINGS[kind].fields}}}


def document_id(df: DataFrame) -> Column:
    """A document's id by its contents, so that a bulk write that is repeated overwrites itself."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), 256)


class DocumentSink(Sink):
    """The four document frames, written in bulk by the tasks that hold them.

    ``connect`` makes a client; it is called on the driver for indices and in each task for
    its documents. Without one documents go to the folder ``path``, which all must share.
    """

    name = "elasticsearch"

    def __init__(self, path: str | None = None, prefix: str | None = None, connect: Callable[[], IndexClient] | None = None, commission: float = 0.001, chunk: int = 500, **config: Any) -> None:
        super().__init__(**config)
        path = path or os.environ.get("BARWRIGHT_INDEX_PATH")
        if connect is None and path is None:
            raise ValueError("a document sink needs a client or a shared folder")
        self.connect: Callable[[], IndexClient] = connect or partial(FolderIndex, path)
        self.prefix = prefix or os.environ.get("BARWRIGHT_INDEX_PREFIX", "barwright")
        self.commission, self.chunk = commission, chunk

    def export(self, run: Run, backtest_id: str, metadata: dict[str, Any]) -> None:
        self.create_indices()
        now = dt.datetime.now(dt.timezone.utc)
        frames = {"backtests": metadata_frame(run.results, backtest_id, self.commission, now), "portfolio": portfolio_frame(run.equity, backtest_id, now), "trades": trades_frame(run.trades, backtest_id, now), "positions": positions_frame(run.trades, backtest_id, now)}
        for kind, df in frames.items():
            self.write(f"{self.prefix}-{kind}", df)

    def write(self, index: str, df: DataFrame) -> None:
        connect, chunk = self.connect, self.chunk

        def send(rows: Iterator[Row]) -> None:
            client = None
            while part := list(islice(rows, chunk)):
                client = client or connect()
                client.bulk(index, [r.asDict(recursive=True) for r in part])

        df.withColumn("_id", document_id(df)).foreachPartition(send)

    def create_indices(self) -> list[str]:
        """Create the indices that aren't there yet, with their mappings."""
        client = self.connect()
        wanted = {f"{self.prefix}-{kind}": kind for kind in MAPPINGS}
        made = [name for name in wanted if name not in client.indices()]
        for name in made:
            client.create(name, mapping(wanted[name]))
        return made

    def available(self) -> bool:
        """Whether the store answers."""
        try:
            return self.connect().ping()
        except Exception as error:  # noqa: BLE001
            logging.error("no document store: %s", error)
            return False

    def indices(self) -> list[str]:
        return [n for n in self.connect().indices() if n.startswith(f"{self.prefix}-")]


SINKS: dict[str, type[Sink]] = {"console": ConsoleSink, "csv": CsvSink, "elasticsearch": DocumentSink}


def _together(rows: list[dict[str, Any]]) -> dict[str, Any]:
    """Metadata of several results: what they share, the span of their dates, and each of them."""
    if not rows:
        return {}
    shared = {k: v for k, v in rows[0].items() if all(r[k] == v for r in rows)}
    return shared | {"symbol": "MULTI", "start_date": min(r["start_date"] for r in rows), "end_date": max(r["end_date"] for r in rows), "results": rows}


class SinkManager:
    """Fans a run out to its sinks; one that fails doesn't stop the others."""

    def __init__(self) -> None:
        self.sinks: list[Sink] = []

    @staticmethod
    def available() -> list[str]:
        return sorted(SINKS)

    @staticmethod
    def create(name: str, **settings: Any) -> Sink:
        key = name.strip().lower()
        if key not in SINKS:
            raise ValueError(f"Unknown sink '{name}'; there are {sorted(SINKS)}")
        return SINKS[key](**settings)

    def add(self, sink: Sink) -> None:
        self.sinks.append(sink)

    def add_named(self, names: list[str], **settings: Any) -> None:
        for name in names:
            try:
                self.add(self.create(name, **settings))
            except ValueError as error:
                logging.warning("%s", error)

    def count(self) -> int:
        return len(self.sinks)

    def names(self) -> list[str]:
        return [s.name for s in self.sinks]

    def clear(self) -> None:
        self.sinks.clear()

    def export(self, run: Run, backtest_id: str | None = None, **metadata: Any) -> str:
        """Send a run, of one symbol or many, to all sinks under one id; metadata of several results lists them all."""
        backtest_id = backtest_id or run_id()
        rows = [r.asDict() for r in run.results.orderBy("symbol").toLocalIterator()]
        described = (rows[0] if len(rows) == 1 else _together(rows)) | metadata
        for sink in self.sinks:
            try:
                sink.export(run, backtest_id, described)
            except Exception as error:  # noqa: BLE001  one sink must not stop the others
                logging.error("sink %s failed: %s", sink.name, error)
        return backtest_id


def results_json(ranked: DataFrame, path: str, metadata: dict[str, Any] | None = None) -> None:
    """A search's or analysis's rows, with metadata, in one file; the rows are few."""
    rows = [{k: (None if isinstance(v, float) and v != v else v) for k, v in r.asDict().items()} for r in ranked.toLocalIterator()]
    with open(path, "w") as f:
        json.dump({"metadata": metadata or {}, "results": rows}, f, indent=2, default=str)


def with_run(child: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("backtest_id",)) -> DataFrame:
    """Rows of a child frame with what their run's metadata says, by id, and by symbol where an id holds several; clashing columns stay the child's."""
    extra = [c for c in runs.columns if c in keys or c not in child.columns]
    return child.join(runs.select(*extra), list(keys))


def data_views(prefix: str = "barwright") -> list[dict[str, str]]:
    """Dashboard views of the documents: title, index pattern and time field."""
    times = {"backtests": "created_at", "portfolio": "timestamp", "trades": "timestamp", "positions": "exit_timestamp"}
    return [{"title": f"{prefix} {kind}", "pattern": f"{prefix}-{kind}*", "time_field": field} for kind, field in times.items()]


def wait_for(client: IndexClient, attempts: int = 30, delay: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether a store answers within some attempts."""
    for n in range(attempts):
        try:
            if client.ping():
                return True
        except Exception as error:  # noqa: BLE001  it may still be starting
            logging.info("not yet: %s", error)
        if n + 1 < attempts:
            sleep(delay)
    return False


def set_up_views(views: Callable[[], Iterable[str]], create: Callable[[dict[str, str]], None], prefix: str = "barwright") -> list[str]:
    """Create the dashboard views that aren't there yet; titles of those made. One that fails doesn't stop the others."""
    held, made = set(views()), []
    for view in data_views(prefix):
        if view["title"] in held:
            continue
        try:
            create(view)
        except Exception as error:  # noqa: BLE001
            logging.error("view %s failed: %s", view["title"], error)
        else:
            made.append(view["title"])
    return made


class IndexAdmin:
    """The indices that a document sink writes: list with counts and bytes, and delete after a dry run."""

    def __init__(self, client: IndexClient, prefix: str = "barwright") -> None:
        self.client, self.prefix = client, prefix

    def indices(self) -> list[str]:
        return [n for n in self.client.indices() if n.startswith(f"{self.prefix}-")]

    def counts(self) -> dict[str, int]:
        return {n: self.client.count(n) for n in self.indices()}

    def sizes(self) -> dict[str, str]:
        return {n: readable_size(self.client.size(n)) for n in self.indices()}

    def drop(self, confirm: bool = False) -> list[str]:
        """Indices that are, or with ``confirm`` were, deleted."""
        found = self.indices()
        for name in found if confirm else ():
            self.client.delete(name)
        return found


def readable_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} PB"
