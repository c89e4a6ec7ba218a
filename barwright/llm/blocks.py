"""Questions that blocks of documents ask of hash buckets.

A block is a hash-dealt group of documents, a few megabytes of text; a bucket is a range of
64-bit hashes. A block asks each bucket in one row about all of its hashes in that range, in
ascending order, and is answered by one row, a value for each hash. So a hash that occurs
everywhere costs one entry a block, and no exchange has a key that can grow hot.

Most hashes occur in one block only. So blocks first send *probes* - the bucket and the next
27 bits of each hash - and buckets tell, a bit each, which of them another block has as well.
Only those hashes are asked about in full. A probe that agrees by accident costs an entry and
changes no result; at the size of a bucket one in some forty does, whatever the input.

Of these only the bits below the probe are sent: a bucket still has the probes, from the same
exchange, and knows which are shared (``rest`` and ``whole``).

Ascending numbers are sent as steps, byte by byte of all, each byte's column compressed where
that is shorter. All 64 bits come through, whatever the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.arrow import quoted, small_batches

#: Bytes of text of a block and of a bucket.
BLOCK_BYTES, BUCKET_BYTES = 5 << 19, 12 << 20
PROBE_BITS = 27


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shares(docs: DataFrame, text: str, *more: Column, block_bytes: int = BLOCK_BYTES) -> tuple[int, int, tuple]:
    """Numbers of blocks and buckets, by the bytes of the texts and enough to busy all tasks; and further aggregates of the same scan."""
    small_batches(docs)
    total, *rest = docs.agg(F.sum(F.octet_length(F.col(quoted(text)))), *more).first()
    total, tasks = total or 0, partitions(docs)
    return max(1, total // block_bytes, min(4 * tasks, total >> 18)), max(1, total // BUCKET_BYTES, min(tasks, total >> 19)), tuple(rest)


def in_blocks(docs: DataFrame, id: str, text: str, blocks: int, name: str) -> DataFrame:
    """``docs`` with a column ``name``, its block, dealt by id and text; equal rows fall together."""
    return docs.withColumn(name, F.pmod(F.xxhash64(F.col(quoted(id)), F.col(quoted(text))), F.lit(blocks)).cast("int"))


def lowest(buckets: int) -> np.ndarray:
    """The smallest hash of each bucket."""
    return np.array([-(-b * (1 << 32) // buckets) << 32 for b in range(buckets)], dtype=np.uint64)


def by_bucket(ascending: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Each bucket that has hashes, and where they are among the ascending ones."""
    edges = np.concatenate([np.searchsorted(ascending, lowest(buckets)), [len(ascending)]])
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        yield bucket, slice(int(edges[bucket]), int(edges[bucket + 1]))


def probe_shift(buckets: int) -> np.uint64:
    """How far to shift a hash right for its probe."""
    return np.uint64(max(0, 64 - PROBE_BITS - (buckets - 1).bit_length()))


def probes(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the distinct probes, ascending, of the hashes in it; one that straddles two buckets is in both."""
    shift = probe_shift(buckets)
    ascending = distinct(hashes)
    for bucket, own in by_bucket(ascending, buckets):
        yield bucket, distinct(ascending[own] >> shift, True)


def told_shared(lists: list[np.ndarray]) -> list[bytes]:
    """For each list of distinct probes, a bit for each: whether another list has it too."""
    every = np.sort(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.uint64)
    twice = distinct(every[1:][every[1:] == every[:-1]], True)
    return [np.packbits(within(x, twice)).tobytes() for x in lists]


def shared_hashes(ascending: np.ndarray, buckets: int, told: dict[int, bytes]) -> np.ndarray:
    """Which of the ascending hashes have a probe that another block has too."""
    out, shift = np.zeros(len(ascending), dtype=bool), probe_shift(buckets)
    for bucket, own in by_bucket(ascending, buckets):
        asked = ascending[own] >> shift
        first = np.concatenate([[True], asked[1:] != asked[:-1]])
        bits = np.unpackbits(np.frombuffer(told[bucket], dtype=np.uint8), count=int(first.sum())).astype(bool)
        out[own] = bits[np.cumsum(first) - 1]
    return out


def rest(ascending: np.ndarray, buckets: int) -> tuple[bytes, bytes]:
    """Shared hashes of one bucket: the bits below their probes, and a bit for each that begins a new probe."""
    shift = probe_shift(buckets)
    probe = ascending >> shift
    low = ascending & ((np.uint64(1) << shift) - np.uint64(1))
    return squeeze(low.astype(np.int64), True), np.packbits(np.concatenate([[True], probe[1:] != probe[:-1]])[: len(probe)]).tobytes()


def whole(shared: np.ndarray, low: bytes, fresh: bytes, buckets: int) -> np.ndarray:
    """The hashes again, by the block's shared probes."""
    bits = unsqueeze(low).astype(np.uint64)
    first = np.unpackbits(np.frombuffer(fresh, dtype=np.uint8), count=len(bits)).astype(np.int64)
    return (shared[np.cumsum(first) - 1] << probe_shift(buckets)) | bits


def shared_lists(table: pa.Table, block: str) -> dict[int, np.ndarray]:
    """Each block's probes that another block has too, as the bucket told it."""
    lists = [unpack_sorted(x) for x in table.column("probes").to_pylist()]
    return {b: x[np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(x)).astype(bool)] for b, x, bits in zip(table.column(block).to_pylist(), lists, told_shared(lists), strict=True)}


def distinct(values: np.ndarray, ascending: bool = False) -> np.ndarray:
    values = values if ascending else np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def within(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are among the ascending ones."""
    if not len(ascending):
        return np.zeros(len(values), dtype=bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    sizes, parts = [], []
    for plane in steps.view(np.uint8).reshape(-1, 8).T:
        raw = plane.tobytes()
        small = bytes(pa.compress(raw, codec="zstd", asbytes=True)) if raw else raw
        parts.append(small if len(small) < len(raw) else raw)
        sizes.append(len(parts[-1]))
    return np.array([len(values), *sizes], dtype="<i8").tobytes() + b"".join(parts)


def unpack_sorted(data: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(data, dtype="<i8", count=9).tolist()
    planes, at = np.zeros((8, n), dtype=np.uint8), 72
    for k, size in enumerate(sizes):
        part = data[at : at + size]
        planes[k] = np.frombuffer(part if size == n else pa.decompress(part, decompressed_size=n, codec="zstd", asbytes=True), dtype=np.uint8)
        at += size
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def squeeze(values: np.ndarray, by_byte: bool = False) -> bytes:
    """Whole numbers in the narrowest type that holds them, compressed, perhaps byte after byte of all; a byte says which."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(k for k in ("u1", "<u2", "<u4", "<i8") if k == "<i8" or (low >= 0 and high <= np.iinfo(k).max))
    raw = values.astype(kind).tobytes()
    width = np.dtype(kind).itemsize
    if by_byte:
        raw = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width + 16 * by_byte]) + len(raw).to_bytes(8, "little") + bytes(pa.compress(raw, codec="zstd", asbytes=True))


def unsqueeze(data: bytes) -> np.ndarray:
    width = data[0] % 16
    kind = {1: "u1", 2: "<u2", 4: "<u4", 8: "<i8"}[width]
    size = int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    if data[0] > 16:
        raw = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T.tobytes()
    return np.frombuffer(raw, dtype=kind).astype(np.int64)


def tell(table: pa.Table, schema: pa.Schema, block: str) -> pa.Table:
    """A bucket's answer to all probes sent to it."""
    lists = [unpack_sorted(x) for x in table.column("probes").to_pylist()]
    return pa.table({block: table.column(block), "bucket": table.column("bucket"), "bits": told_shared(lists)}, schema=schema)
