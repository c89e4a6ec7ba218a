"""Cleaning steps and their pipeline, as window and filter expressions over each symbol.

NaN counts as null from here on. Fills go by ``seq`` (source order), before sorting and
keeping the first of repeated times. All windows share the partitioning by symbol, so a
whole pipeline is one shuffle.
"""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.sources.bars import PRICES

INF = float("inf")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name != "seq"]


def _named(df: DataFrame, wanted: tuple[str, ...]) -> dict[str, str]:
    """Columns by lower-case name."""
    return {c.lower(): c for c in df.columns if c.lower() in wanted}


class Step(ABC):
    """A cleaning step over bars with symbol, ts and seq."""

    name = "step"

    @abstractmethod
    def process(self, df: DataFrame) -> DataFrame: ...

    def can_process(self, df: DataFrame) -> bool:
        """Whether there are rows; only asked in audit mode, since it runs a job."""
        return bool(df.take(1))

    def fits(self, df: DataFrame) -> bool:
        """Whether the schema suits the step; costs nothing."""
        return True


class InfiniteToNull(Step):
    name = "infinite values"

    def process(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when((F.abs(c) != INF) & ~F.isnan(c), F.col(c)) for c in _numeric(df)})

    def counts(self, df: DataFrame) -> DataFrame:
        """Infinite values of each column: one row."""
        return df.agg(*[F.count_if(F.abs(c) == INF).alias(c) for c in _numeric(df)])


class FillNulls(Step):
    """Forward, then backward fill in source order; rows still null somewhere go."""

    name = "missing values"

    def process(self, df: DataFrame) -> DataFrame:
        order = Window.partitionBy("symbol").orderBy("seq")
        back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
        columns = [c for c in df.columns if c not in ("symbol", "seq")]
        numeric = set(_numeric(df))

        def filled(c: str) -> Column:
            value = F.nanvl(F.col(c), F.lit(None)) if c in numeric else F.col(c)
            return F.coalesce(F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead))

        return df.withColumns({c: filled(c) for c in columns}).na.drop(subset=columns)


#: The five price rules by name.
OHLC_RULES = {"high_below_low": ("high", "low"), "high_below_open": ("high", "open"), "high_below_close": ("high", "close"), "open_below_low": ("open", "low"), "close_below_low": ("close", "low")}


def _broken(df: DataFrame) -> dict[str, Column]:
    names = _named(df, PRICES)
    return {rule: F.coalesce(F.col(names[a]) < F.col(names[b]), F.lit(False)) for rule, (a, b) in OHLC_RULES.items()}


class OhlcRules(Step):
    """Rows that break a price rule go; null prices break none."""

    name = "price rules"

    def fits(self, df: DataFrame) -> bool:
        return len(_named(df, PRICES)) == 4

    def process(self, df: DataFrame) -> DataFrame:
        if not self.fits(df):
            return df
        broken = F.lit(False)
        for rule in _broken(df).values():
            broken = broken | rule
        return df.where(~broken)

    def counts(self, df: DataFrame, *keys: str) -> DataFrame:
        rules = _broken(df)
        any_rule = F.lit(False)
        for rule in rules.values():
            any_rule = any_rule | rule
        return df.groupBy(*keys).agg(*[F.count_if(r).alias(n) for n, r in rules.items()], F.count_if(any_rule).alias("rows_broken"))


class QualityRules(Step):
    """Positive prices, volume of 0 or more, the first row of each time, in order of time.

    A column's nulls go only where the symbol has a bad value in that column, and columns are
    judged one after the other, on the rows that the ones before have left.
    """

    name = "quality"

    def process(self, df: DataFrame) -> DataFrame:
        names = _named(df, (*PRICES, "volume"))
        rules = [(c, F.col(c) > 0) for n, c in names.items() if n != "volume"] + [(c, F.col(c) >= 0) for n, c in names.items() if n == "volume"]
        symbol = Window.partitionBy("symbol")
        for column, good in rules:
            bad = F.max(F.coalesce(~good, F.lit(False))).over(symbol)
            df = df.withColumn("_bad", bad).where(~F.col("_bad") | F.coalesce(good, F.lit(False))).drop("_bad")
        first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("seq"))
        df = df.withColumn("_n", first).where("_n = 1").drop("_n")
        return df.sortWithinPartitions("symbol", "ts", "seq")


class GapReport(Step):
    """Passes rows through; ``gaps`` and ``completeness`` are tables of their own."""

    name = "time gaps"

    def fits(self, df: DataFrame) -> bool:
        return isinstance(df.schema["ts"].dataType, (T.TimestampType, T.TimestampNTZType))

    def can_process(self, df: DataFrame) -> bool:
        return self.fits(df) and len(df.take(2)) == 2

    def process(self, df: DataFrame) -> DataFrame:
        return df

    @staticmethod
    def _steps(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("symbol").orderBy("ts", "seq") if "seq" in df.columns else Window.partitionBy("symbol").orderBy("ts")
        rows = df.select("symbol", "ts", F.lag("ts").over(order).alias("before"))
        step = F.unix_micros("ts") - F.unix_micros("before")
        # the smallest of the commonest steps
        return rows.withColumn("step", step).withColumn("usual", F.mode("step", True).over(Window.partitionBy("symbol")))

    def gaps(self, df: DataFrame, factor: float = 1.5) -> DataFrame:
        """(symbol, gap_start, gap_end, gap_micros) of steps over ``factor`` times the usual one."""
        return self._steps(df).where(F.col("step") > factor * F.col("usual")).select("symbol", F.col("before").alias("gap_start"), F.col("ts").alias("gap_end"), F.col("step").alias("gap_micros"))

    def completeness(self, df: DataFrame) -> DataFrame:
        """(symbol, n, usual_micros, completeness): percent of the bars that the usual step would give."""
        span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).cast("double")
        usual = F.max("usual")
        return self._steps(df).groupBy("symbol").agg(F.count("*").alias("n"), usual.alias("usual_micros"), (F.count("*") / (F.try_divide(span, usual.cast("double")) + 1) * 100).alias("completeness"))


class Cleaner:
    """Steps in order. A step whose schema check fails is skipped; one that fails is logged and skipped.

    With ``audit`` rows are counted between steps and empty frames stop the run; without, no
    job is run until the result is used.
    """

    def __init__(self, *steps: Step, audit: bool = False) -> None:
        self.steps: list[Step] = []
        self.audit = audit
        for step in steps:
            self.add(step)

    def add(self, step: Step) -> Cleaner:
        if not any(s is step for s in self.steps):
            self.steps.append(step)
        return self

    def remove(self, step: Step) -> bool:
        found = [i for i, s in enumerate(self.steps) if s is step]
        for i in found[:1]:
            del self.steps[i]
        return bool(found)

    def clear(self) -> None:
        self.steps.clear()

    def names(self) -> list[str]:
        return [s.name for s in self.steps]

    def runnable(self, df: DataFrame) -> list[str]:
        return [s.name for s in self.steps if s.fits(df)]

    def run(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            if self.audit and not df.take(1):
                break
            if not step.fits(df) or self.audit and not step.can_process(df):
                logging.info("skipped: %s", step.name)
                continue
            try:
                df = step.process(df)
            except Exception as error:  # noqa: BLE001  a failing step must not stop the others
                logging.error("step %s failed: %s", step.name, error)
        return df


def default_cleaner(audit: bool = False) -> Cleaner:
    return Cleaner(InfiniteToNull(), FillNulls(), OhlcRules(), QualityRules(), GapReport(), audit=audit)
