"""Statistics over result rows, each one aggregation by ``by`` (all rows together if none is given).

Spreads named volatility or std of periods and simulations are population ones; summary and
consistency figures use the sample spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.metrics import sharpe

CONFIDENCE = (0.90, 0.95, 0.99)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)


def _median(c: str) -> Column:
    return F.percentile(c, 0.5)


def _positive(c: str) -> tuple[Column, Column]:
    return F.count_if(F.col(c) > 0), F.count_if(F.col(c) > 0) / F.count("*") * 100


def _shared(mean: str) -> list[Column]:
    out = []
    for name, c in (("return", "total_return"), ("return_pct", "total_return_pct")):
        out += [F.avg(c).alias(f"{mean}_{name}"), _median(c).alias(f"median_{name}"), F.stddev_pop(c).alias(f"std_{name}")]
    return out


def walk_forward_metrics(results: DataFrame, returns: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Combined figures of periods; ``returns`` has (by, ret), the changes of all periods' curves."""
    periods, periods_pct = _positive("total_return")
    profitable, profitable_pct = _positive("total_return_pct")
    combined = results.groupBy(*by).agg(
        F.count("*").alias("total_periods"), *_shared("avg"), F.avg(F.coalesce("sharpe_ratio", F.lit(0.0))).alias("avg_sharpe_ratio"), F.avg("max_drawdown").alias("avg_max_drawdown"), F.max("max_drawdown").alias("worst_max_drawdown"), F.min("max_drawdown").alias("best_max_drawdown"),
        F.avg("win_rate").alias("avg_win_rate"), F.avg("total_trades").alias("avg_trades_per_period"), periods.alias("positive_return_periods"), periods_pct.alias("positive_return_pct"), profitable.alias("profitable_periods"), profitable_pct.alias("profitable_periods_pct"))
    whole = returns.groupBy(*by).agg(sharpe(F.col("ret")).alias("combined_sharpe_ratio"))
    return combined.join(whole, list(by), "left") if by else combined.crossJoin(whole)


def direction_stability(values: DataFrame, value: str, order: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, stability): one less the share of consecutive changes that turn; a change of 0 counts as not up; 1 below three values."""
    line = Window.partitionBy(*by).orderBy(order)
    up = values.withColumn("up", (F.col(value) - F.lag(value).over(line)) > 0)
    turned = up.withColumn("turned", F.col("up") != F.lag("up").over(line))
    return turned.groupBy(*by).agg(F.when(F.count("turned") > 0, 1.0 - F.count_if("turned") / F.count("turned")).otherwise(1.0).alias("stability"))


def rolling_stability(values: DataFrame, value: str, order: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, rolling_mean_stability) of means over min(4, n div 2) values; null below four."""
    line = Window.partitionBy(*by).orderBy(order)
    rows = values.withColumns({"n": F.count("*").over(Window.partitionBy(*by)), "place": F.row_number().over(line)})
    width = F.least(F.lit(4), F.expr("n DIV 2")).cast("int")
    # n below eight narrows the window, so the last values are held in an array of at most four
    held = F.collect_list(value).over(line.rowsBetween(-3, 0))
    last = F.slice(held, -F.least(width, F.size(held)), F.least(width, F.size(held)))
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / width
    means = rows.where("n >= 1").withColumn("mean", F.when((F.col("n") >= 4) & (F.col("place") >= width), mean))
    return means.groupBy(*by).agg(F.when(F.count("mean") > 1, 1.0 / (1.0 + F.stddev_pop("mean"))).alias("rolling_mean_stability"))


def stability_metrics(results: DataFrame, order: str = "period", by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Spreads, consistencies, temporal stability and, from four periods on, rolling ones."""
    base = results.groupBy(*by).agg(
        F.stddev_pop("total_return").alias("return_volatility"), F.stddev_pop("total_return_pct").alias("return_pct_volatility"), F.stddev_pop(F.coalesce("sharpe_ratio", F.lit(0.0))).alias("sharpe_volatility"),
        _ratio(F.avg("total_return"), F.stddev_pop("total_return")).alias("return_consistency"), _ratio(F.avg("total_return_pct"), F.stddev_pop("total_return_pct")).alias("return_pct_consistency"), F.count("*").alias("n"))
    turns = direction_stability(results, "total_return", order, by).withColumnRenamed("stability", "temporal_stability")
    rolled = rolling_stability(results, "total_return", order, by)
    out = base.join(turns, list(by)).join(rolled, list(by))
    return out.withColumn("trend_consistency", F.when(F.col("n") >= 4, F.col("temporal_stability"))).drop("n")


def monte_carlo_metrics(results: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Combined figures of simulations."""
    sims, sims_pct = _positive("total_return")
    profitable, profitable_pct = _positive("total_return_pct")
    return results.groupBy(*by).agg(
        *_shared("mean"), F.avg("sharpe_ratio").alias("mean_sharpe"), _median("sharpe_ratio").alias("median_sharpe"), F.stddev_pop("sharpe_ratio").alias("std_sharpe"), F.avg("max_drawdown").alias("mean_max_drawdown"), F.max("max_drawdown").alias("worst_max_drawdown"),
        F.min("max_drawdown").alias("best_max_drawdown"), F.avg("win_rate").alias("mean_win_rate"), F.avg("total_trades").alias("mean_trades_per_simulation"), sims.alias("positive_return_simulations"), sims_pct.alias("positive_return_pct"),
        profitable.alias("profitable_simulations"), profitable_pct.alias("profitable_simulations_pct"), F.count("*").alias("total_simulations"))


def sample_skewness(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.stddev_samp(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)


def sample_kurtosis(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when((n >= 4) & (F.stddev_samp(c) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)).otherwise(0.0)


def distribution(results: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Value at risk, expected shortfall, skewness, kurtosis and confidence intervals.

    Percentiles are exact and linear. The tail means need them first, so they are a second
    aggregation, joined by ``by``.
    """
    shapes, levels = [], [0.05, 0.01]
    for conf in CONFIDENCE:
        levels += [(1 - conf) / 2, 1 - (1 - conf) / 2]
    for name, c in (("return", "total_return"), ("return_pct", "total_return_pct"), ("sharpe", "sharpe_ratio")):
        shapes += [sample_skewness(c).alias(f"{name}_skewness"), sample_kurtosis(c).alias(f"{name}_kurtosis")]
    points = [F.percentile(c, levels).alias(f"_{n}") for n, c in (("return", "total_return"), ("return_pct", "total_return_pct"))]
    first = results.groupBy(*by).agg(*shapes, *points)
    for name in ("return", "return_pct"):
        at = lambda i, n=name: F.col(f"_{n}")[i]
        named = {f"{name}_var_5pct": at(0), f"{name}_var_1pct": at(1)}
        for i, conf in enumerate(CONFIDENCE):
            named |= {f"{name}_ci_{int(conf * 100)}_lower": at(2 + 2 * i), f"{name}_ci_{int(conf * 100)}_upper": at(3 + 2 * i)}
        first = first.withColumns(named).drop(f"_{name}")
    tails = results.join(first.select(*by, "return_var_5pct", "return_var_1pct", "return_pct_var_5pct", "return_pct_var_1pct"), list(by))
    tail = [F.avg(F.when(F.col(c) <= F.col(f"{n}_var_{p}pct"), F.col(c))).alias(f"{n}_cvar_{p}pct") for n, c in (("return", "total_return"), ("return_pct", "total_return_pct")) for p in (5, 1)]
    return first.join(tails.groupBy(*by).agg(*tail), list(by))


def percentile_table(results: DataFrame, percentiles: tuple[int, ...] = (5, 25, 50, 75, 95), by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, metric, p5, p25, ...) of five metrics."""
    metrics = ("total_return", "total_return_pct", "sharpe_ratio", "max_drawdown", "win_rate")
    rows = results.select(*by, *metrics).unpivot(list(by), list(metrics), "metric", "value")
    points = rows.groupBy(*by, "metric").agg(F.percentile("value", [p / 100 for p in percentiles]).alias("p"))
    return points.select(*by, "metric", *[F.col("p")[i].alias(f"p{p}") for i, p in enumerate(percentiles)])


def summary_statistics(results: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, metric, mean, std, min, max, median, count) of four metrics; the spread of one row is null."""
    metrics = ("total_return", "sharpe_ratio", "max_drawdown", "win_rate")
    rows = results.select(*by, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics]).unpivot(list(by), list(metrics), "metric", "value")
    return rows.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), _median("value").alias("median"), F.count("*").alias("count"))


def consistency(results: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, consistency_ratio, positive_periods_pct)."""
    return results.groupBy(*by).agg(_ratio(F.avg("total_return"), F.stddev_samp("total_return")).alias("consistency_ratio"), _positive("total_return")[1].alias("positive_periods_pct"))


def result_table(results: DataFrame, order: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Results with a period number from 1, in order."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return results.withColumn("period", number).select(*by, "period", "start_date", "end_date", "total_return", "total_return_pct", "sharpe_ratio", "max_drawdown", "win_rate", "total_trades", "initial_capital", "final_capital")


def success_rate(results: DataFrame, tried: int, by: tuple[str, ...] = ()) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("completed"), (F.count("*") / F.lit(tried) * 100).alias("success_rate"))


def long_form(metrics: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, metric, value) of a row of figures."""
    names = [c for c in metrics.columns if c not in by]
    return metrics.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(by), names, "metric", "value")


def result_vectors(results: DataFrame, order: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, total_returns, sharpe_ratios, max_drawdowns, win_rates) as arrays in order; few results a group."""
    row = F.struct(order, "total_return", F.coalesce("sharpe_ratio", F.lit(0.0)).alias("sharpe"), "max_drawdown", "win_rate")
    held = results.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    names = {"total_returns": "total_return", "sharpe_ratios": "sharpe", "max_drawdowns": "max_drawdown", "win_rates": "win_rate"}
    return held.select(*by, *[F.col(f"rows.{c}").alias(n) for n, c in names.items()])


# dashboards


def return_by_strategy(results: DataFrame) -> DataFrame:
    return results.groupBy("strategy_name").agg(F.avg("total_return_pct").alias("avg_return_pct"), F.count("*").alias("runs"))


def value_by_bucket(curve: DataFrame, keys: tuple[str, ...] = ("symbol",), bucket: str = "month") -> DataFrame:
    return curve.groupBy(*keys, F.date_trunc(bucket, "ts").alias("bucket")).agg(F.avg("portfolio_value").alias("avg_value"))


def trades_by_bucket(trades: DataFrame, bucket: str = "month") -> DataFrame:
    return trades.groupBy(F.date_trunc(bucket, "ts").alias("bucket")).agg(F.count("*").alias("n_trades"))


def trade_panels(trades: DataFrame) -> DataFrame:
    """By symbol and side: trades, mean price and quantity, whole value."""
    return trades.groupBy("symbol", "side").agg(F.count("*").alias("n_trades"), F.avg("price").alias("avg_price"), F.avg("quantity").alias("avg_quantity"), F.sum("value").alias("total_value"))


def side_heatmap(trades: DataFrame, bucket: str = "year") -> DataFrame:
    """Bucket by side, counted."""
    return trades.groupBy(F.date_trunc(bucket, "ts").alias("bucket")).pivot("side", ["buy", "sell"]).count().na.fill(0, ["buy", "sell"])
