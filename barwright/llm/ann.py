"""Approximate nearest neighbours by shifted Hilbert curves.

Vectors are projected to a few dimensions by several random rotations, each with its own
shift, and ordered along a Hilbert curve. Spark range-partitions and sorts all orderings;
counts of rows before each partition turn the sort into ranks. A query meets the vectors
within a window of ranks on either side, in every ordering, block by block; the blocks' best
are merged and ranked again by cosine on the original vectors, in double precision.

How many orderings and how wide a window, in rows, is fitted on a bounded sample (``sample``
vectors, those whose contents hash lowest): of 1 to ``orderings`` the number that meets the
fewest vectors and yet finds ``recall`` of the sample's own nearest neighbours. How the window
grows with the number of vectors is read off a quarter of the sample against all of it, and
carried on: hardly at all where vectors lie in clusters or few dimensions, in proportion where
they have no structure. For those, where several windows would meet half of all vectors, one
ordering is left, with a window over all of it: every pair is met once, as in any exact search. Every vector is indexed and searched.

Equal vectors are one from the start, so a vector that fills a third of the table is one row
in each ordering; its smallest ids are put back at the end.

Defined results: null, zero, NaN, infinite or null-holding vectors and those of another
length than the commonest take no part, nor do null ids; very large and very small components
are scaled by a power of two first, so that no norm overflows; ties go to the smaller id; rows with
the same id and vector count once; fewer candidates than ``k`` are all returned; an empty
table gives an empty table; other columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barwright.llm.arrow import quoted
from barwright.llm.blocks import partitions
from barwright.llm.hilbert import hilbert_keys
from barwright.session import cut

#: Vectors of a block, which one task holds at a time: about a window, but at least and at most so many.
LEAST_BLOCK, MOST_BLOCK = 1024, 16384


def valid(vector: Column) -> Column:
    """Whether a vector takes part: no null, NaN or infinite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Curves:
    """Rotations, shifts and scales of the orderings that are needed, and how far their windows reach."""

    def __init__(self, sample: np.ndarray, orderings: int, dims: int, bits: int, recall: float, k: int) -> None:
        rng = np.random.default_rng(11)
        size = sample.shape[1]
        self.bits, dims = bits, min(dims, size)
        self.rotations = [np.linalg.qr(rng.normal(size=(size, dims)))[0] for _ in range(orderings)]
        self.shifts = rng.uniform(-0.5, 0.5, (orderings, dims))
        vectors = unit(sample)
        self.means = [(vectors @ r).mean(axis=0) for r in self.rotations]
        self.scales = [np.maximum((vectors @ r).std(axis=0), 1e-12) for r in self.rotations]
        #: Rows on either side for 1, 2, ... orderings, in the sample and in a quarter of it.
        self.n, self.reaches = len(vectors), self._reaches(vectors, recall, k)
        self.quarter = self._reaches(vectors[: max(2, len(vectors) // 4)], recall, k)

    def keys(self, vectors: np.ndarray, orderings: int) -> list[np.ndarray]:
        top = (1 << self.bits) - 1
        out = []
        for r, shift, mean, scale in list(zip(self.rotations, self.shifts, self.means, self.scales, strict=True))[:orderings]:
            cells = ((vectors @ r - mean) / scale + shift + 4) / 8 * (top + 1)
            out.append(hilbert_keys(np.clip(cells, 0, top).astype(np.int64), self.bits))
        return out

    def _reaches(self, vectors: np.ndarray, recall: float, k: int) -> list[float]:
        n = len(vectors)
        asked = np.arange(0, n, max(1, n // 300))
        score = vectors[asked] @ vectors.T
        score[np.arange(len(asked)), asked] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, : min(k, n - 1)]
        nearest = np.full(best.shape, n)
        out = []
        for key in self.keys(vectors, len(self.rotations)):
            rank = np.empty(n, dtype=np.int64)
            rank[np.argsort(key, kind="stable")] = np.arange(n)
            nearest = np.minimum(nearest, np.abs(rank[best] - rank[asked][:, None]))
            out.append(float(np.quantile(nearest, recall, method="higher")) + 1 if nearest.size else float(n))
        return out

    def fitted(self, total: int, k: int) -> tuple[int, int]:
        """Orderings and reach for ``total`` vectors: the fewest that a query meets; one that meets all where others would meet half of them."""
        best = (total / 2, 1, total)
        for number, (here, before) in enumerate(zip(self.reaches, self.quarter, strict=True), 1):
            power = min(1.0, max(0.0, np.log(here / before) / np.log(4)) + 0.1) if self.n >= 8 else 1.0
            reach = min(total, max(2 * k, int(np.ceil(here * max(1.0, total / self.n) ** power))))
            best = min(best, (number * min(total, 2 * reach), number, reach))
        return best[1:]


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, best first, equal ones in order of place."""
    out = np.empty((len(scores), k), dtype=np.int64)
    rows = np.arange(len(scores))
    for n in range(k):
        out[:, n] = scores.argmax(axis=1)
        scores[rows, out[:, n]] = -np.inf
    return out


def nearest(vectors: DataFrame, asks: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", orderings: int = 16, dims: int = 8, bits: int = 7, recall: float = 0.96, sample: int = 4000) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row for which ``asks`` holds."""
    spark = vectors.sparkSession
    element = vectors.schema[vector].dataType.elementType
    kind, wire = ("array<float>", "<f4") if isinstance(element, T.FloatType) else ("array<double>", "<f8")
    out_schema = f"query_id long, rank int, {id} long, score double"
    rows = vectors.where(F.col(quoted(id)).isNotNull() & valid(F.col(quoted(vector)))).select(F.col(quoted(id)).cast("long").alias("id"), F.col(quoted(vector)).cast(kind).alias("vector"), asks.alias("asks"))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is None:
        return spark.createDataFrame([], out_schema)
    rows = rows.where(F.size("vector") == length["n"]).withColumn("node", F.xxhash64("vector"))
    distinct = cut(rows.groupBy("node").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.max("asks").alias("asks")))
    taken = distinct.orderBy("node").limit(sample).select("vector").collect()
    curves = Curves(np.array([r["vector"] for r in taken]), orderings, dims, bits, recall, k)
    total = distinct.count()
    orderings, reach = curves.fitted(total, k)
    block = min(MOST_BLOCK, max(LEAST_BLOCK, 1 << max(0, reach - 1).bit_length()))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column("vector").flatten(), dtype=np.float64).reshape(n, -1)
            keys = curves.keys(unit(x), orderings)
            packed = pa.array([v.tobytes() for v in x.astype(wire)], type=pa.binary())
            for number, key in enumerate(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, dtype=np.int32)), pa.array(key), batch.column("node"), batch.column("least"), batch.column("asks"), packed], names=["ordering", "key", "node", "least", "asks", "vector"])

    keyed = distinct.mapInArrow(order, "ordering int, key long, node long, least long, asks boolean, vector binary")
    ranked = cut(keyed.repartitionByRange(partitions(vectors), "ordering", "key", "node").sortWithinPartitions("ordering", "key", "node"))
    # rows of each ordering before each partition: as many numbers as partitions and orderings
    counts = {(r["part"], r["ordering"]): r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("part"), "ordering").count().collect()}
    before: dict[tuple[int, int], int] = {}
    at = [0] * orderings
    for part, ordering in sorted(counts):
        before[part, ordering] = at[ordering]
        at[ordering] += counts[part, ordering]
    last = (total - 1) // block

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            orders = np.asarray(batch.column("ordering"))
            asked = np.asarray(batch.column("asks").cast(pa.uint8())).astype(bool)
            for ordering in np.unique(orders).tolist():
                places = np.flatnonzero(orders == ordering)
                start = before[part, ordering] + seen.get(ordering, 0)
                seen[ordering] = seen.get(ordering, 0) + len(places)
                rank = start + np.arange(len(places))
                own = places[asked[places]]
                low = np.maximum(rank[asked[places]] - reach, 0) // block
                high = np.minimum((rank[asked[places]] + reach) // block, last)
                spread = high - low + 1
                blocks = np.repeat(low - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
                take = pa.array(np.concatenate([places, np.repeat(own, spread)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), ordering, dtype=np.int32)), pa.array(np.concatenate([rank // block, blocks])), pa.array(np.concatenate([np.zeros(len(places), dtype=bool), np.ones(len(blocks), dtype=bool)])), *(batch.column(c).take(take) for c in ("node", "least", "vector"))], names=["ordering", "block", "asks", "node", "least", "vector"])

    def meet(table: pa.Table) -> pa.Table:
        asked = np.asarray(table.column("asks").combine_chunks().cast(pa.uint8())).astype(bool)
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=wire).reshape(table.num_rows, -1).astype(np.float64)
        x = scaled(x)
        nodes, least = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "least"))
        norms = np.sqrt((x * x).sum(axis=1))
        own = np.flatnonzero(~asked)
        own = own[np.argsort(least[own], kind="stable")]  # so that ties go to the smaller id
        found: list[tuple[np.ndarray, np.ndarray]] = []
        questions = np.flatnonzero(asked)
        for at in range(0, len(questions) if len(own) else 0, 256):
            q = questions[at : at + 256]
            scores = (x[q] @ x[own].T) / (norms[q][:, None] * norms[own][None, :])
            best = _first(scores, min(k + 1, len(own)))
            found.append((np.repeat(q, best.shape[1]), own[best.reshape(-1)]))
        q, c = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (own[:0], own[:0])
        score = (x[q] * x[c]).sum(axis=1) / (norms[q] * norms[c])
        return pa.table([pa.array(nodes[q]), pa.array(nodes[c]), pa.array(least[c]), pa.array(score)], names=["query", "node", "least", "score"])

    met = ranked.mapInArrow(deal, "ordering int, block long, asks boolean, node long, least long, vector binary").groupBy("ordering", "block").applyInArrow(meet, "query long, node long, least long, score double")
    merged = met.groupBy("query", "node").agg(F.max("score").alias("score"), F.min("least").alias("least"))
    best = merged.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))).where(F.col("place") <= k + 1)
    # equal vectors' ids: the smallest few of each are enough
    ids = rows.select("node", "id").withColumn("place", F.dense_rank().over(Window.partitionBy("node").orderBy("id"))).where(F.col("place") <= k + 1).select("node", "id").distinct()
    expanded = best.select("query", "node", "score").join(ids, "node").select("query", "id", "score")
    few = expanded.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    questions = rows.where("asks").select(F.col("node").alias("query"), F.col("id").alias("query_id")).distinct()
    answers = questions.join(few, "query").where(F.col("id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
