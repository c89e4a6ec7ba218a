"""File sources and sinks of bars: CSV in its variants, directories, parameters."""

from __future__ import annotations

import json
import logging
import os
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.operators.cleaning import default_cleaner
from barwright.sources.bars import VALUES

#: Names a time column may have, in order of preference.
TIME_NAMES = ("timestamp", "date", "Date", "Timestamp")
#: As pandas writes infinities; Spark would read other spellings as null.
CSV = {"header": "true", "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "nan"}


def symbol_of(path: Column) -> Column:
    """The first ``_`` part of a file's stem."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.element_at(F.split(stem, "_"), 1)


def _header(spark: SparkSession, path: str | list[str]) -> list[str]:
    return spark.read.options(**CSV).csv(path).columns


def _mapped(names: list[str], require: str | None, lower: bool) -> tuple[str, dict[str, str]]:
    """The time column of a header, and its columns by the name they go by."""
    if not names:
        raise ValueError("empty file")
    allowed = (require,) if require else TIME_NAMES
    unnamed = None if require or names[0] != "_c0" else "_c0"
    time = next((n for n in allowed if n in names), unnamed)
    if time is None:
        raise ValueError(f"no time column among {names}")
    wanted = {c.lower() if lower else c: c for c in names}
    missing = [c for c in VALUES if c not in wanted]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return time, wanted


def read_csv(spark: SparkSession, path: str | list[str], symbol: str | None = None, require: str | None = None, lower: bool = True, sort: bool = False, names: list[str] | None = None) -> DataFrame:
    """Bars of one file, a glob, a directory, or a list of files with one header.

    The schema is explicit: all columns are read as text but the prices, as double; ``seq`` is
    the place in the file, kept by reading each file as one partition would give it. ``require``
    is the only time column allowed, for loaders that insist on one; else the first of
    ``TIME_NAMES``, or an unnamed first column. ``symbol`` defaults to the file's name.
    """
    names = _header(spark, path) if names is None else names
    time, wanted = _mapped(names, require, lower)
    schema = T.StructType([T.StructField(c, T.DoubleType() if (c.lower() if lower else c) in VALUES else T.StringType()) for c in names])
    rows = spark.read.schema(schema).options(**CSV).csv(path)
    file = F.col("_metadata.file_path")
    rows = rows.select(
        (F.lit(symbol) if symbol else symbol_of(file)).alias("symbol"), F.to_timestamp(time).alias("ts"), *[F.col(f"`{wanted[c]}`").alias(c) for c in VALUES],
        file.alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    order = Window.partitionBy("file").orderBy("_start", "_row")
    rows = rows.withColumn("seq", F.row_number().over(order).cast("long")).drop("_start", "_row")
    return rows.orderBy("symbol", "ts", "seq") if sort else rows


def load_for_backtest(spark: SparkSession, path: str, clean: bool = False, symbol: str | None = None) -> DataFrame:
    """Any known time column, unsorted; cleaned on request."""
    bars = read_csv(spark, path, symbol)
    return clean_bars(bars) if clean else bars


def load_for_search(spark: SparkSession, path: str, clean: bool = False, symbol: str | None = None) -> DataFrame:
    """Needs ``timestamp``; sorted; warns of nulls; an empty file is an error."""
    bars = read_csv(spark, path, symbol, require="timestamp", sort=True)
    bars = clean_bars(bars) if clean else bars
    counts = bars.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in VALUES]).first()
    if not counts["n"]:
        raise ValueError("Data cannot be empty")
    if any(counts[c] for c in VALUES):
        logging.warning("missing values: %s", {c: counts[c] for c in VALUES if counts[c]})
    return bars


def load_for_analysis(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Any known time column or an unnamed first one; sorted."""
    return read_csv(spark, path, symbol, sort=True)


def clean_bars(bars: DataFrame) -> DataFrame:
    return default_cleaner().run(bars)


def load_and_clean(spark: SparkSession, path: str) -> DataFrame | None:
    """Cleaned bars; None where they can't be read. Column names keep their case here."""
    try:
        return clean_bars(read_csv(spark, path, lower=False))
    except Exception as error:  # noqa: BLE001
        logging.error("can't load %s: %s", path, error)
        return None


def write_csv(bars: DataFrame, path: str, single: bool = True) -> None:
    out = bars.select(F.col("ts").alias("timestamp"), *VALUES)
    (out.coalesce(1).sortWithinPartitions("timestamp") if single else out).write.mode("overwrite").options(**CSV).csv(path)


def cleaned_name(path: str, suffix: str = "_cleaned") -> str:
    stem, ext = os.path.splitext(path)
    return f"{stem}{suffix}{ext}"


def clean_file(spark: SparkSession, source: str, target: str | None = None) -> bool:
    bars = load_and_clean(spark, source)
    if bars is None:
        return False
    write_csv(bars, target or cleaned_name(source))
    return True


def headers(spark: SparkSession, source: str) -> DataFrame:
    """(file, header) of all CSV files under a directory, each file's first line."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(source).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return lines.where("start = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"))


def clean_directory(spark: SparkSession, source: str, target: str, suffix: str = "_cleaned") -> DataFrame:
    """All CSV files of a directory: (file, n_rows, error), a row each.

    Files with the same header are read, cleaned by file and written to a folder each in one
    job; a header that can't be used fails its files alone, and only they have an error. A
    name's cleaned rows go to ``target/file=<name><suffix>``, over what was there.
    """
    groups: dict[str, list[str]] = {}
    for r in headers(spark, source).toLocalIterator():
        groups.setdefault(r["header"] or "", []).append(r["file"])
    stem = lambda c: F.concat(F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1), F.lit(suffix))
    parts, failed = [], []
    for header, paths in sorted(groups.items()):
        try:
            bars = read_csv(spark, paths, names=[n.strip().strip('"') or "_c0" for n in header.split(",")])
        except ValueError as error:
            failed += [(p, str(error)) for p in paths]
            continue
        # steps work by symbol, so the file stands in for it while they run
        by_file = clean_bars(bars.withColumn("symbol", F.col("file")).drop("file"))
        parts.append(by_file.select(stem(F.col("symbol")).alias("file"), F.col("ts").alias("timestamp"), *VALUES))
    errors = spark.createDataFrame(failed, "path string, error string").select(stem(F.col("path")).alias("file"), F.lit(0).cast("long").alias("n_rows"), "error")
    if not parts:
        return errors
    whole = reduce(DataFrame.unionByName, parts)
    whole.repartition("file").sortWithinPartitions("file", "timestamp").write.mode("overwrite").partitionBy("file").options(**CSV).csv(target)
    asked = spark.createDataFrame([(p,) for paths in groups.values() for p in paths], "path string").select(stem(F.col("path")).alias("file"))
    counts = spark.read.options(**CSV).csv(target).groupBy("file").agg(F.count("*").alias("n_rows"))
    good = asked.join(errors.select("file"), "file", "left_anti").join(counts, "file", "left").select("file", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(errors)


def write_download(bars: DataFrame, folder: str, symbol: str, source: str, timeframe: str, start: str, end: str) -> str:
    """Write downloaded bars under the name that says what they are; that name."""
    path = os.path.join(folder, download_name(symbol, source, timeframe, start, end))
    write_csv(bars, path)
    return path


def download_name(symbol: str, source: str, timeframe: str, start: str, end: str) -> str:
    part = symbol.replace("/", "").replace("-", "").upper()
    return f"{part}_{source}_{timeframe}_{start.replace('-', '')}_{end.replace('-', '')}.csv"


def write_parquet(bars: DataFrame, path: str) -> None:
    """Partitioned by symbol, so a symbol's scan reads its own files only."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_parameters(text_or_path: str) -> dict[str, Any]:
    """Inline JSON, a bare or wrapped dict in a file, or a search's results, whose first one counts."""
    text = text_or_path
    if not text.lstrip().startswith("{"):
        with open(text_or_path) as f:
            text = f.read()
    found = json.loads(text)
    if found.get("results"):
        first = found["results"][0]
        return first.get("parameters") or {k: first[k] for k in ("short_window", "long_window", "position_size") if k in first}
    return found.get("parameters", found)
