"""Arrow plumbing shared by the operators that leave the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text worked on at once; one longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

#: Bytes of a batch between the JVM and Python; each task holds a few of them outside its heap.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def quoted(name: str) -> str:
    """A column's name as Spark takes it, dots and backticks and all."""
    return "`" + name.replace("`", "``") + "`"


def spare(columns: list[str], name: str) -> str:
    """``name``, or the first of it with a number that no column has, in any case."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def small_batches(df: DataFrame) -> None:
    """Bound the session's Arrow batches by bytes where they may be larger; long rows make smaller batches."""
    conf = df.sparkSession.conf
    held = (conf.get(_LIMIT, None) or "").rstrip("b")
    if held.isdigit() and int(held) > BATCH_BYTES:
        conf.set(_LIMIT, f"{BATCH_BYTES}b")


def chunks(batches: Iterator[pa.RecordBatch], text: str | None, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in column ``text`` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if text is None:
            yield batch
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64) + 16)
        at = 0
        while at < batch.num_rows:
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def numbered(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``columns`` under names that any operator takes, and these names by the columns' own."""
    safe = {c: f"c{n}" for n, c in enumerate(columns)}
    return df.select(*[F.col(quoted(c)).alias(safe[c]) for c in columns]), safe


def add_columns(df: DataFrame, made: dict[str, T.DataType], function: Callable[[pa.RecordBatch, dict[str, str]], list[pa.Array]], text: str | None = None) -> DataFrame:
    """``df`` and the columns that ``function`` makes of each chunk of rows and the names that its columns have there.

    An input column whose name equals a made one, in any case, is replaced.
    """
    small_batches(df)
    taken = {name.lower() for name in made}
    kept = [c for c in df.columns if c.lower() not in taken]
    used = kept if text is None or text in kept else [*kept, text]
    rows, names = numbered(df, used)
    fields = [*(rows.schema[names[c]] for c in kept), *(T.StructField(f"made{n}", t) for n, t in enumerate(made.values()))]
    types = [to_arrow_type(t) for t in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, names[text] if text else None):
            arrays = [a if a.type == t else a.cast(t) for a, t in zip(function(batch, names), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(names[c]) for c in kept), *arrays], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields)).toDF(*kept, *made)
