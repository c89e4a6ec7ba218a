"""Command line: download, clean, backtest, optimize, analyze."""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import sys
from importlib import import_module
from typing import Any

from pyspark.sql import functions as F

from barwright.functions import metrics as M
from barwright.functions import stats as S
from barwright.operators import limits
from barwright.operators.fold import Engine, run_backtest, trades
from barwright.operators.risk import FixedRisk, KellyRisk
from barwright.operators.robustness import monte_carlo, walk_forward
from barwright.operators.search import METRICS, OPTIMIZERS, SPACES, best_by_metric, create_optimizer, evaluate, ranked
from barwright.operators.signals import STRATEGIES
from barwright.operators.validation import validate_monte_carlo, validate_walk_forward
from barwright.session import session
from barwright.sources import files
from barwright.sources.remote import EXCHANGE_FRAMES, QUOTE_FRAMES, ExchangeSource, QuoteSource
from barwright.sources.sinks import Run, SinkManager, results_json

RISKS = {"fixed": FixedRisk, "kelly": KellyRisk}


def setup_logging(level: str = "INFO", path: str | None = None) -> None:
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.FileHandler(path))
    logging.basicConfig(level=getattr(logging, level.upper()), format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="barwright")
    top.add_argument("--log-level", default="INFO")
    top.add_argument("--log-file")
    sub = top.add_subparsers(dest="command", required=True)

    def common(p: argparse.ArgumentParser) -> None:
        p.add_argument("--data", required=True)
        p.add_argument("--symbol")
        p.add_argument("--capital", type=float, default=10000.0)
        p.add_argument("--commission", type=float, default=0.001)
        p.add_argument("--strategy", choices=sorted(STRATEGIES), default="simple_ma")

    b = sub.add_parser("backtest")
    common(b)
    b.add_argument("--short", type=int, default=10)
    b.add_argument("--long", type=int, default=30)
    b.add_argument("--position-size", type=float, default=1.0)
    b.add_argument("--risk", choices=sorted(RISKS))
    b.add_argument("--risk-position-size", type=float, default=0.1)
    b.add_argument("--stop-loss", type=float, default=0.05)
    b.add_argument("--max-positions", type=int, default=5)
    b.add_argument("--max-risk", type=float, default=0.02)
    b.add_argument("--clean", action="store_true")
    b.add_argument("--exporters", default="console")
    b.add_argument("--output", default=".")
    o = sub.add_parser("optimize")
    common(o)
    o.add_argument("--method", choices=sorted(OPTIMIZERS), default="grid")
    o.add_argument("--trials", type=int, default=100)
    o.add_argument("--seed", type=int)
    o.add_argument("--sort-by", choices=sorted(METRICS), default="total_return")
    o.add_argument("--top", type=int, default=10)
    o.add_argument("--clean", action="store_true")
    o.add_argument("--output")
    a = sub.add_parser("analyze")
    common(a)
    a.add_argument("--analysis", choices=("walk_forward", "monte_carlo"), required=True)
    a.add_argument("--params", required=True)
    a.add_argument("--window", type=int, default=6)
    a.add_argument("--step", type=int, default=3)
    a.add_argument("--simulations", type=int, default=1000)
    a.add_argument("--sample", type=float, default=0.8)
    a.add_argument("--block", type=int, default=30)
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--output")
    c = sub.add_parser("clean")
    c.add_argument("--input", required=True)
    c.add_argument("--output")
    c.add_argument("--suffix", default="_cleaned")
    c.add_argument("--directory", action="store_true")
    d = sub.add_parser("download")
    d.add_argument("--source", choices=("exchange", "quotes"), required=True)
    d.add_argument("--symbol", required=True)
    d.add_argument("--timeframe", default="1d")
    d.add_argument("--start", required=True)
    d.add_argument("--end", required=True)
    d.add_argument("--output")
    d.add_argument("--client", help="module:function that fetches")
    d.add_argument("--exchange", default="exchange")
    return top


def dates(start: str, end: str) -> tuple[dt.date, dt.date]:
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    limits.check({"start": first, "end": last}, limits.DATES)
    return first, last


def _strategy(name: str, parameters: dict[str, Any], risk: Any = None) -> Any:
    return STRATEGIES[name](**{k: v for k, v in parameters.items() if k in ("short_window", "long_window", "position_size")}, risk=risk)  # type: ignore[call-arg]


def _risk(args: argparse.Namespace) -> Any:
    if args.risk is None:
        return None
    if args.risk == "kelly":
        return KellyRisk()
    return FixedRisk(args.risk_position_size, args.stop_loss, args.max_positions, args.max_risk)


def backtest(args: argparse.Namespace) -> None:
    spark, engine = session(), Engine(args.capital, args.commission)
    bars = files.load_for_backtest(spark, args.data, args.clean, args.symbol)
    strategy = _strategy(args.strategy, {"short_window": args.short, "long_window": args.long, "position_size": args.position_size}, _risk(args))
    simulated = run_backtest(bars, strategy, engine)
    manager = SinkManager()
    for name in args.exporters.split(","):
        manager.add_named([name], **{"csv": {"output_dir": args.output}, "elasticsearch": {"path": f"{args.output}/index"}}.get(name.strip().lower(), {}))
    manager.export(Run(M.summarize(simulated, engine=engine, strategy=strategy.name), trades(simulated), M.equity_curve(simulated)), commission=args.commission, strategy_params=strategy.description())


def optimize(args: argparse.Namespace) -> None:
    spark, engine = session(), Engine(args.capital, args.commission)
    bars = files.load_for_search(spark, args.data, args.clean, args.symbol)
    extra = {"n_trials": args.trials, "seed": args.seed} if args.method == "random" else {}
    search = create_optimizer(args.method, bars, SPACES[args.strategy], engine=engine, sort_by=args.sort_by, **extra)
    results = evaluate(bars, search.combos(), engine).cache()
    ranked(results, args.sort_by, args.top).show(args.top, truncate=False)
    best_by_metric(results, "symbol").show(truncate=False)
    if args.output:
        results_json(ranked(results, args.sort_by), args.output, {"method": args.method, "sort_by": args.sort_by})


def analyze(args: argparse.Namespace) -> None:
    spark, engine = session(), Engine(args.capital, args.commission)
    bars = files.load_for_analysis(spark, args.data, args.symbol)
    strategy = _strategy(args.strategy, files.read_parameters(args.params))
    n = bars.groupBy("symbol").count().agg(F.min("count")).first()[0]
    if args.analysis == "walk_forward":
        validate_walk_forward(args.window, args.step, n)
        results = walk_forward(bars, strategy, engine, args.window, args.step).cache()
        tables = [S.stability_metrics(results), S.consistency(results), S.result_table(results, "test_start")]
    else:
        block = validate_monte_carlo(args.simulations, args.sample, args.block, n)
        results = monte_carlo(bars, strategy, engine, args.simulations, args.sample, block, args.seed).cache()
        tables = [S.monte_carlo_metrics(results), S.distribution(results), S.percentile_table(results), S.success_rate(results, args.simulations, ("symbol",))]
    for table in [S.summary_statistics(results), *tables]:
        table.show(truncate=False)
    if args.output:
        results_json(results, args.output, {"analysis": args.analysis, "parameters": files.read_parameters(args.params)})


def clean(args: argparse.Namespace) -> None:
    spark = session()
    if args.directory:
        files.clean_directory(spark, args.input, args.output or f"{args.input.rstrip('/')}{args.suffix}", args.suffix).show(truncate=False)
    elif not files.clean_file(spark, args.input, args.output or files.cleaned_name(args.input, args.suffix)):
        raise ValueError(f"can't clean {args.input}")


def download(args: argparse.Namespace) -> None:
    """Fetch through the client that ``--client module:name`` names, and write a CSV named after what it holds."""
    first, last = dates(args.start, args.end)
    if args.timeframe not in (EXCHANGE_FRAMES if args.source == "exchange" else QUOTE_FRAMES):
        raise ValueError(f"unknown time frame {args.timeframe}")
    if not args.client:
        raise ValueError("downloads need a client: --client module:function")
    module, _, name = args.client.partition(":")
    fetch, spark = getattr(import_module(module), name), session()
    if args.source == "exchange":
        stamp = lambda d: int(dt.datetime.combine(d, dt.time(), dt.timezone.utc).timestamp() * 1000)
        bars = ExchangeSource({args.exchange: fetch}).download(spark, args.exchange, args.symbol, args.timeframe, stamp(first), stamp(last))
        label = args.exchange
    else:
        bars, label = QuoteSource(fetch).download(spark, args.symbol, args.start, args.end, args.timeframe), "quotes"
        bars = bars.select(F.lit(args.symbol).alias("symbol"), F.col("Date").cast("timestamp").alias("ts"), *[F.col(c.capitalize()).cast("double").alias(c) for c in files.VALUES]) if bars is not None else None
    if bars is None:
        raise ValueError(f"nothing downloaded for {args.symbol}")
    print(files.write_download(bars, args.output or ".", args.symbol, label, args.timeframe, args.start, args.end))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    setup_logging(args.log_level, args.log_file)
    try:
        {"backtest": backtest, "optimize": optimize, "analyze": analyze, "clean": clean, "download": download}[args.command](args)
    except Exception as error:  # noqa: BLE001
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
