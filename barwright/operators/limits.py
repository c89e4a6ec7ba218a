"""Settings and what they must satisfy, told once and checked two ways: for one set of settings, or a table of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limit:
    """``holds`` takes settings by name, numbers or columns alike; ``message`` may name settings in braces."""

    holds: Callable[[Mapping[str, Any]], Any]
    message: str


def above(name: str, low: float, message: str) -> Limit:
    return Limit(lambda s: s[name] > low, message)


def at_least(name: str, low: float, message: str) -> Limit:
    return Limit(lambda s: s[name] >= low, message)


def share(name: str, zero: bool = False) -> Limit:
    """From 0 to 1; 0 itself only with ``zero``."""
    return Limit(lambda s: ((s[name] >= 0) if zero else (s[name] > 0)) & (s[name] <= 1), f"{name} must be between 0 and 1")


def complaints(settings: Mapping[str, Any], limits: Iterable[Limit]) -> list[str]:
    """Messages of the limits that one set of settings breaks, in order."""
    return [limit.message.format(**settings) for limit in limits if not limit.holds(settings)]


def check(settings: Mapping[str, Any], limits: Iterable[Limit]) -> None:
    """Raise ValueError with the first complaint."""
    for message in complaints(settings, limits):
        raise ValueError(message)


def first_complaint(table: DataFrame, limits: Iterable[Limit], column: str = "complaint") -> DataFrame:
    """``table``, a set of settings in each row, with its first broken limit's message unfilled; null where all hold or a setting is null."""
    settings = {c: F.col(f"`{c}`") for c in table.columns}
    chain: Column | None = None
    for limit in limits:
        broken = ~limit.holds(settings)
        chain = F.when(broken, limit.message) if chain is None else chain.when(broken, limit.message)
    return table.withColumn(column, F.lit(None).cast("string") if chain is None else chain)


#: What the engine, a search, walk-forward and Monte Carlo accept.
ENGINE = (above("initial_capital", 0, "Initial capital must be positive"), at_least("commission", 0, "Commission cannot be negative"), at_least("min_order_value", 0, "Minimum order value cannot be negative"))
WALK_FORWARD = (above("test_window_months", 0, "test_window_months must be positive"), above("step_months", 0, "step_months must be positive"))
MONTE_CARLO = (above("n_simulations", 0, "n_simulations must be positive"), share("bootstrap_sample_pct"), above("block_size_days", 0, "block_size_days must be positive"))
CROSSOVER = (Limit(lambda s: (s["short_window"] > 0) & (s["long_window"] > 0), "Window sizes must be positive"), Limit(lambda s: s["short_window"] < s["long_window"], "Short window must be less than long window"), Limit(lambda s: (s["position_size"] > 0) & (s["position_size"] <= 1), "Position size must be between 0 and 1"))

DATES = (Limit(lambda s: s["start"] <= s["end"], "start date must not be after end date"),)

#: Settings of the risk managers.
RISK_BASE = (share("max_position_size"), share("max_risk_per_trade"), Limit(lambda s: s["max_risk_per_trade"] <= s["max_position_size"], "max_risk_per_trade ({max_risk_per_trade}) cannot exceed max_position_size ({max_position_size})"))
FIXED_RISK = (share("position_size_pct"), share("stop_loss_pct", zero=True), above("max_positions", 0, "max_positions must be positive"), share("max_risk_per_trade"), Limit(lambda s: s["position_size_pct"] * s["stop_loss_pct"] <= s["max_risk_per_trade"], "Position size ({position_size_pct}) * stop loss ({stop_loss_pct}) exceeds max risk per trade ({max_risk_per_trade})"))
FIXED_RISK_WARNINGS = (Limit(lambda s: s["position_size_pct"] * s["stop_loss_pct"] >= 0.001, "Very conservative: little of the portfolio at risk in a trade"), Limit(lambda s: s["stop_loss_pct"] <= 0.2, "Large stop loss: {stop_loss_pct}"), Limit(lambda s: s["max_positions"] * (s["position_size_pct"] * s["stop_loss_pct"]) <= 0.5, "High portfolio risk if all stops are hit"))
KELLY_RISK = (*(above(n, 0, f"{n} must be positive") for n in ("lookback_periods", "min_trades_for_kelly", "max_positions")), *(share(n) for n in ("max_kelly_fraction", "max_risk_per_trade", "fractional_kelly")), share("stop_loss_pct", zero=True))
