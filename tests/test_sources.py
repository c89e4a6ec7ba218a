"""Files, remote sources, sinks, streaming and the command line."""

import datetime as dt
import json
import os
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barwright import cli
from barwright.functions import metrics as M
from barwright.operators.fold import run_backtest, simulate, trades
from barwright.operators.signals import GivenSignals, MaCrossover
from barwright.sources import bars as B
from barwright.sources import files, remote, sinks
from barwright.streaming import live

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this file
DAY = dt.datetime(2024, 1, 1)


def write(path, time="timestamp", caps=False, n=60, bad=False):
    frame = pd.DataFrame({time: [(DAY + dt.timedelta(days=i)).strftime("%Y-%m-%d") for i in range(n)], "open": [100 + i % 9 for i in range(n)], "high": [112 + i % 9 for i in range(n)], "low": [90 + i % 9 for i in range(n)], "close": [101.5 + (i * 7) % 9 for i in range(n)], "volume": [1000 + i for i in range(n)]})
    if bad:
        frame.loc[3, "close"] = float("inf")
        frame.loc[5, "open"] = -1
    if caps:
        frame.columns = [c.capitalize() if c != time else c for c in frame.columns]
    frame.to_csv(path, index=False)
    return str(path)


def test_loaders(spark, tmp_path):
    one = write(tmp_path / "BTCUSD_x_1d.csv")
    df = files.load_for_backtest(spark, one)
    assert df.count() == 60 and df.first().symbol == "BTCUSD" and [r.seq for r in df.orderBy("seq").limit(3).collect()] == [1, 2, 3]
    assert files.load_for_backtest(spark, write(tmp_path / "a_1.csv", "Date", caps=True)).count() == 60  # lower-cased
    assert files.load_and_clean(spark, write(tmp_path / "a_2.csv", "Date", caps=True)) is None  # cleaned loads keep the case
    with pytest.raises(ValueError, match="time column"):
        files.load_for_search(spark, write(tmp_path / "b.csv", "date"))
    assert files.load_for_search(spark, one, symbol="Z").first().symbol == "Z"
    unnamed = tmp_path / "c.csv"
    pd.read_csv(one).set_index("timestamp").rename_axis(None).to_csv(unnamed)
    assert files.load_for_analysis(spark, str(unnamed)).where("ts IS NOT NULL").count() == 60
    bad = tmp_path / "d.csv"
    pd.DataFrame({"timestamp": ["2024-01-01"], "open": [1]}).to_csv(bad, index=False)
    with pytest.raises(ValueError, match="Missing required"):
        files.load_for_backtest(spark, str(bad))
    dirty = write(tmp_path / "e.csv", bad=True)
    assert files.load_for_backtest(spark, dirty).where("close = double('inf')").count() == 1
    assert files.load_for_backtest(spark, dirty, clean=True).count() == 59


def test_clean_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("AAA_1d", "AAA_1h", "BBB_1d"):
        write(source / f"{name}.csv", bad=name == "AAA_1d")
    write(source / "CCC_1d.csv", "Date", caps=True)  # another header
    (source / "DDD_1d.csv").write_text("timestamp,open\n2024-01-01,1\n")  # can't be used
    counts = {r.file: (r.n_rows, r.error) for r in files.clean_directory(spark, str(source), str(tmp_path / "out")).collect()}
    assert "Missing required" in counts.pop("DDD_1d_cleaned")[1]
    assert counts == {"AAA_1d_cleaned": (59, None), "AAA_1h_cleaned": (60, None), "BBB_1d_cleaned": (60, None), "CCC_1d_cleaned": (60, None)}
    assert files.cleaned_name("/x/a.csv") == "/x/a_cleaned.csv"
    assert files.clean_file(spark, str(source / "AAA_1d.csv"), str(tmp_path / "one")) and not files.clean_file(spark, str(tmp_path / "none.csv"), str(tmp_path / "two"))
    assert files.load_for_backtest(spark, str(tmp_path / "one")).count() == 59
    assert files.download_name("BTC/USDT", "exchange", "1d", "2024-01-01", "2024-02-01") == "BTCUSDT_exchange_1d_20240101_20240201.csv"
    bars = files.load_for_backtest(spark, str(source / "BBB_1d.csv"))
    files.write_parquet(bars, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).where("symbol = 'BBB'").count() == 60


def test_parameters(tmp_path):
    bare = {"short_window": 10, "long_window": 20}
    assert files.read_parameters(json.dumps(bare)) == bare
    for content in (bare, {"parameters": bare}, {"results": [{"parameters": bare}]}, {"results": [{**bare, "combo_id": 1}]}):
        path = tmp_path / "p.json"
        path.write_text(json.dumps(content))
        assert files.read_parameters(str(path)) == bare


def test_exchange_pages(spark):
    def fetch(symbol, frame, since, limit):
        return [[1000, 1, 2, 0.5, 1.5, since]] * 1000 if since == 0 else [[2000, 1, 2, 0.5, 1.5, since]]

    source = remote.ExchangeSource({"ex": fetch})
    df = source.download(spark, "ex", "A/B", "1d", 0, 5000)
    assert df.count() == 1001 and {r.volume for r in df.select("volume").distinct().collect()} == {0.0, 1001.0}  # the second page begins after the last time
    assert source.download(spark, "ex", "A/B", "7x", 0, 1) is None and source.download(spark, "no", "A/B", "1d", 0, 1) is None
    assert remote.ExchangeSource({"ex": lambda *a: []}).download(spark, "ex", "A", "1d", 0, 1) is None
    assert remote.ExchangeSource({"ex": lambda *a: 1 / 0}).download(spark, "ex", "A", "1d", 0, 1) is None
    late = remote.ExchangeSource({"ex": lambda *a: [[1, 1, 1, 1, 1, 1], [9, 1, 1, 1, 1, 1]]})
    assert late.download(spark, "ex", "A", "1d", 0, 5, 2).count() == 1
    assert source.exchanges() == ["ex"] and len(source.timeframes()) == 14 and len(remote.QuoteSource().timeframes()) == 13


def test_quotes(spark):
    index = pd.DatetimeIndex(["2024-01-01", "2024-01-02"])
    frame = pd.DataFrame({("Close", "T"): [1.0, 2.0], ("Open", "T"): [1.0, 2.0], ("Volume", "T"): [5, 6], ("Other", "T"): [0, 0]}, index=index)
    frame.columns = pd.MultiIndex.from_tuples(frame.columns)
    source = remote.QuoteSource(lambda *a: frame)
    assert source.download(spark, "T", "2024-01-01", "2024-01-03", "1d").columns == ["Date", "Open", "Close", "Volume"]
    assert source.download(spark, "T", "a", "b", "7x") is None
    assert remote.QuoteSource(lambda *a: frame[:0]).download(spark, "T", "a", "b", "1d") is None


def test_candle_data_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n}.json").write_text(json.dumps([[n * 1000 + i, 1, 2, 0.5, 1.5, 10] for i in range(5)]))
    spark.dataSource.register(remote.CandleSource)
    df = spark.read.format("candles").options(paths=f"{tmp_path}/1.json,{tmp_path}/2.json", start_ms="1002", end_ms="2001").load()
    assert sorted(r.ts_ms for r in df.collect()) == [1002, 1003, 1004, 2000, 2001]


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    sim = run_backtest(B.orders_bars(spark, sf_dir).where("symbol = '1-URGENT'"), MaCrossover(3, 8, 0.2)).cache()
    return sinks.Run(M.summarize(sim), trades(sim), M.equity_curve(sim))


def test_csv_and_document_sinks(spark, run, tmp_path, capsys):
    manager = sinks.SinkManager()
    manager.add_named([" CSV ", "nonsense"], output_dir=str(tmp_path / "csv"))
    manager.add(sinks.DocumentSink(path=str(tmp_path / "index")))
    manager.add(sinks.ConsoleSink())

    class Failing(sinks.Sink):
        name = "failing"

        def export(self, *a):
            raise RuntimeError("no")

    manager.add(Failing())
    assert manager.names() == ["csv", "elasticsearch", "console", "failing"] and manager.count() == 4 and sinks.SinkManager.available() == ["console", "csv", "elasticsearch"]
    made = manager.export(run, symbol="A/B")
    names = os.listdir(tmp_path / "csv")
    meta = json.loads((tmp_path / "csv" / next(n for n in names if n.endswith(".json"))).read_text())
    assert meta["backtest_id"] == made and all(n.startswith("A-B_") for n in names)
    equity = spark.read.option("header", True).csv(str(tmp_path / "csv" / next(n for n in names if n.endswith("_equity"))))
    assert equity.columns == ["timestamp", "portfolio_value", "backtest_id"] and equity.count() == run.equity.count()
    index = sinks.DocumentSink(path=str(tmp_path / "index"))
    assert index.indices() == [f"barwright-{k}" for k in ("backtests", "portfolio", "positions", "trades")]
    admin = sinks.IndexAdmin(sinks.FolderIndex(str(tmp_path / "index")))
    assert admin.counts()["barwright-trades"] == run.trades.count() and admin.counts()["barwright-portfolio"] == run.equity.count()
    held = json.loads((tmp_path / "index" / "barwright-trades" / "mapping.json").read_text())
    assert held["mappings"]["properties"]["timestamp"] == {"type": "date"} and set(held["mappings"]["properties"]) == set(sinks.MAPPINGS["trades"].names)
    assert index.create_indices() == [] and set(admin.sizes()) == set(admin.indices())
    assert admin.drop() == admin.indices() and admin.drop(confirm=True) and admin.indices() == []
    assert "total_trades" in capsys.readouterr().out
    manager.clear()
    assert manager.count() == 0
    with pytest.raises(ValueError):
        sinks.SinkManager.create("x")


def test_without_infinities(spark):
    df = spark.createDataFrame([(float("inf"), (float("nan"), 1.0), [(-float("inf"),)])], "a double, b struct<x:double,y:double>, c array<struct<z:double>>")
    assert sinks.without_infinities(df).first().asDict(recursive=True) == {"a": None, "b": {"x": None, "y": 1.0}, "c": [{"z": None}]}


def test_small_helpers(spark, run, tmp_path):
    assert not sinks.validate_run(sinks.Run(run.results, run.trades, run.equity.limit(0)))
    assert sinks.readable_size(2048) == "2.0 KB" and len(sinks.run_id()) == 36
    sinks.results_json(run.results, str(tmp_path / "r.json"), {"a": 1})
    assert json.loads((tmp_path / "r.json").read_text())["metadata"] == {"a": 1}
    assert sinks.DocumentSink(path=str(tmp_path / "new")).available() and [v["time_field"] for v in sinks.data_views()] == ["created_at", "timestamp", "timestamp", "exit_timestamp"]
    views = []
    assert len(sinks.set_up_views(lambda: ["barwright trades"], views.append)) == 3 == len(views)
    tries = iter([RuntimeError, False, True])

    class Client:
        def ping(self):
            got = next(tries)
            if got is RuntimeError:
                raise got
            return got

    assert sinks.wait_for(Client(), 3, sleep=lambda _: None) and not sinks.wait_for(type("Down", (), {"ping": lambda self: False})(), 2, sleep=lambda _: None)
    with pytest.raises(ValueError, match="shared folder"):
        sinks.DocumentSink()
    joined = sinks.with_run(sinks.trades_frame(run.trades, "r1"), sinks.metadata_frame(run.results, "r1"))
    assert joined.count() == run.trades.count() and "strategy_name" in joined.columns
    two = run.results.unionByName(run.results.withColumn("symbol", F.lit("other")))
    manager = sinks.SinkManager()
    manager.add(sinks.CsvSink(str(tmp_path / "two")))
    manager.export(sinks.Run(two, run.trades, run.equity), "id")
    meta = json.loads(next((tmp_path / "two").glob("MULTI*.json")).read_text())
    assert [r["symbol"] for r in meta["results"]] == ["1-URGENT", "other"]


def test_shared_folder_is_needed_off_this_machine(spark, monkeypatch):
    from barwright import session

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)
    folder = session.scratch(spark, "x")
    spark.range(3).write.parquet(folder)
    session.discard(spark, folder)
    assert not os.path.exists(folder.removeprefix("file://"))


def test_streamed_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    source = tmp_path / "events"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.repartition(1).write.parquet(str(source))
    q = live.stream_bars(live.ticks(spark, str(source))).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    try:
        q.processAllAvailable()
        got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("bars").collect()}
    finally:
        q.stop()
    ts = F.date_trunc("day", F.col("ts").cast("timestamp"))
    batch = rows.groupBy(F.col("event_type").alias("symbol"), ts.alias("ts")).agg(F.min_by("value", "event_id"), F.max("value"), F.min("value"), F.max_by("value", "event_id"), F.count("*").cast("double"))
    want = {(r[0], r[1]): tuple(r[2:]) for r in batch.collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 10  # the last windows stay open


def test_streamed_fold_equals_batch_fold(spark, sf_dir, tmp_path):
    signals = MaCrossover(3, 8, 0.2).signals(B.orders_bars(spark, sf_dir)).select("symbol", "ts", "close", "signal", "position_size", "row_idx")
    cut = signals.agg(F.percentile_approx("row_idx", 0.5)).first()[0]
    folder = tmp_path / "signals"
    for n, part in enumerate((signals.where(F.col("row_idx") <= cut), signals.where(F.col("row_idx") > cut))):
        part.drop("row_idx").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(signals.drop("row_idx").schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
    q = live.stream_fold(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        q.processAllAvailable()
        got = sorted((r.symbol, r.ts, r.side, r.value) for r in spark.table("folded").collect())
    finally:
        q.stop()
    assert got == sorted((r.symbol, r.ts, r.side, r.value) for r in trades(simulate(signals)).collect())


def test_streamed_fold_counts_late_rows(spark, tmp_path):
    schema = "symbol string, ts timestamp, close double, signal int, position_size double"
    days = lambda *ns: [("X", DAY + dt.timedelta(days=n), 10.0, None if n == 3 else 1, 0.5) for n in ns]
    folder = tmp_path / "rows"
    for part in (days(2, 3, 4), days(1, 2, 5)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = live.stream_fold(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).start()
    try:
        q.processAllAvailable()
        got = spark.table("late").collect()
    finally:
        q.stop()
    assert [r.late_rows for r in got if r.side is None] == [2] and sum(r.side == "buy" for r in got) == 3


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    data = write(tmp_path / "SYM_1d.csv", n=300)
    out = str(tmp_path / "out")
    assert cli.main(["--log-level", "WARNING", "backtest", "--data", data, "--short", "3", "--long", "8", "--position-size", "0.5", "--exporters", "console,csv", "--output", out]) == 0
    assert any(n.endswith("_trades") for n in os.listdir(out)) and "SYM" in capsys.readouterr().out
    assert cli.main(["optimize", "--data", data, "--method", "random", "--trials", "3", "--seed", "1", "--output", f"{out}/o.json"]) == 0
    assert json.load(open(f"{out}/o.json"))["results"]
    params = json.dumps({"short_window": 3, "long_window": 8, "position_size": 0.5})
    assert cli.main(["analyze", "--data", data, "--analysis", "walk_forward", "--params", params, "--window", "2", "--step", "2", "--output", f"{out}/w.json"]) == 0
    assert cli.main(["analyze", "--data", data, "--analysis", "monte_carlo", "--params", params, "--simulations", "3"]) == 0
    assert cli.main(["clean", "--input", data, "--output", f"{out}/clean"]) == 0
    assert cli.main(["backtest", "--data", data, "--risk", "kelly"]) in (0, 1)
    assert cli.main(["download", "--source", "quotes", "--symbol", "X", "--start", "2024-02-01", "--end", "2024-01-01"]) == 1
    assert "start date" in capsys.readouterr().err
    asked = ["download", "--source", "exchange", "--symbol", "A/B", "--start", "2024-01-01", "--end", "2024-02-01", "--output", out]
    assert cli.main(asked) == 1 and "client" in capsys.readouterr().err
    (tmp_path / "a_client.py").write_text("def fetch(symbol, frame, since, limit):\n    return [[since + 86400000 * i, 1, 2, 0.5, 1.5, 10] for i in range(3)]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    import a_client
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(a_client)
    assert cli.main([*asked, "--client", "a_client:fetch", "--exchange", "ex"]) == 0
    assert files.load_for_backtest(spark, f"{out}/AB_ex_1d_20240101_20240201.csv", symbol="AB").count() == 3


def test_given_signals_default_size(spark):
    df = spark.createDataFrame([("X", DAY, 1.0, 1)], "symbol string, ts timestamp, close double, signal int")
    assert GivenSignals().signals(df).first().position_size == 1.0
