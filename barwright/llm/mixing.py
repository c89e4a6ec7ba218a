"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weighted share of all words, at most ``cap`` times its own size;
what a cap cuts off is shared again by weight until no source is above. Whole epochs of a
source come first. What is left of its target is filled in the order of the keys
``-ln(u) / quality`` (``u`` a hash of seed and id, so reruns agree): a document goes in
while less than half of it lies beyond the target.

In that order the chosen documents of a source are a beginning of it, so one row a source says
it all: its last key. No source is ever sorted for that. Keys fall into ``buckets`` ranges;
sums by range tell in which one the target is reached, and only that range's rows are sorted.
Then each document is compared with its source's last key where it is, so documents, and
texts above all, aren't shuffled.

Defined results: null text has size 0 and takes nothing; a null source is a source and the
last one; sources of size 0 have target 0; repeated rows and ids share a key, ties go by
id (null first), then size, and equal rows are taken alike; an empty table gives an empty
table; other columns stay, but one named like an output column, in any case, is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.arrow import quoted, spare
from barwright.llm.words import SPACES, word_count
from barwright.session import cut

#: Sources whose limits, a row each, may be broadcast; more are joined as any other table.
BROADCAST_SOURCES = 100_000

#: Fixed value: weights of the sources in code point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of a text's visible characters that aren't symbols."""
    seen = F.length(F.translate(text, SPACES, ""))
    plain = F.length(F.translate(text, SPACES + "#*$%&|<>", ""))
    return F.coalesce(0.1 + 0.9 * F.try_divide(plain.cast("double"), seen.cast("double")), F.lit(0.1))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """``sources`` (mix_source, source_size) with weight and target; one row a source, so windows over all are small."""
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    weighed = sources.withColumn("mix_weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    # fair level of each prefix of sources, taken in the order in which they reach their cap
    by_cap = everything.orderBy(cap * F.col("source_size") / F.col("mix_weight"), F.col("mix_source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    capped = cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("mix_weight").over(everything) - F.coalesce(F.sum("mix_weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - capped) / weight_left
    leveled = weighed.withColumn("mix_place", F.row_number().over(by_cap)).withColumn("mix_level", level)
    fits = F.col("mix_level") <= cap * F.col("source_size") / F.col("mix_weight") * (1 + 1e-12)
    chosen = F.min(F.when(fits, F.struct("mix_place", "mix_level"))).over(everything)["mix_level"]
    target = F.least(F.col("mix_weight") * F.coalesce(chosen, F.lit(0.0)), cap * F.col("source_size"))
    return leveled.withColumn("target", target.cast("double")).select("mix_source", "source_size", "mix_weight", "target")


def _keyed(docs: DataFrame, kept: list[str], id: str, source: str, size: Column, quality: Column, seed: str, buckets: int) -> DataFrame:
    """``docs`` as one column, beside which names can't clash, with source, id, size, key and range.

    A null source is told by a column of its own, so that joins are plain ones.
    """
    name = F.col(quoted(id))
    unit = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), name.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    owner = F.col(quoted(source)).cast("string")
    rows = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in kept]).alias("row"), owner.isNull().alias("nameless"), F.coalesce(owner, F.lit("")).alias("mix_source"), name.alias("id"), size.alias("size"), (-F.log(unit) / quality).alias("key"))
    return rows.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int"))


def mix_limits(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, seed: str = "mix-1", buckets: int = 1024) -> DataFrame:
    """(nameless, mix_source, source_size, target, epochs, last_range, last): a row for each source.

    Beyond the epochs a source gives its documents of ranges before ``last_range``, and those in
    it up to ``last``, a struct of key, id and size.
    """
    owner = ["nameless", "mix_source"]
    size = word_count(F.col(quoted(text))) if size is None else size
    quality = quality_weight(F.col(quoted(text))) if quality is None else quality
    rows = _keyed(docs, [id], id, source, size, quality, seed, buckets).drop("row")
    # sizes are what texts are read for, so they are kept
    rows = cut(rows)
    ranges = rows.groupBy(*owner, "range").agg(F.sum("size").alias("words"))
    named = F.when(~F.col("nameless"), F.col("mix_source")).alias("mix_source")
    sources = targets(ranges.groupBy(*owner).agg(F.sum("words").alias("source_size")).select(named, "source_size"), weights, cap)
    epochs = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)) + 1e-9)
    sources = cut(sources.select(F.col("mix_source").isNull().alias("nameless"), F.coalesce("mix_source", F.lit("")).alias("mix_source"), "source_size", "target", epochs.alias("epochs")))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy(*owner).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first range that doesn't go in as a whole; past the last one where all do
    reached = ranges.withColumn("ahead", ahead).join(sources, owner).where(F.col("ahead") + F.col("words") > left).groupBy(*owner).agg(F.min(F.struct("range", "ahead")).alias("at"))
    edges = sources.join(reached, owner, "left").select(*owner, left.alias("left"), F.coalesce("at.range", F.lit(buckets + 1)).alias("last_range"), F.coalesce("at.ahead", F.lit(0)).alias("ahead"))
    inside = rows.where("size > 0").join(edges.withColumnRenamed("last_range", "range"), [*owner, "range"])
    order = Window.partitionBy(*owner).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = inside.withColumn("start", start).where(F.col("start") + F.col("size") / 2 <= F.col("left")).groupBy(*owner).agg(F.max(F.struct("key", "id", "size")).alias("last"))
    return sources.join(edges.select(*owner, "last_range"), owner).join(last, owner, "left")


def apply_limits(docs: DataFrame, limits: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, quality: Column | None = None, seed: str = "mix-1", buckets: int = 1024) -> DataFrame:
    """``docs`` with size, source_size, target, copies (times the document is taken) and taken (words).

    A row a source is joined, by a broadcast up to BROADCAST_SOURCES of them (counted), and a
    document is compared with it; its size only matters where key and id tie, and is only
    counted there if the columns made of it aren't read. ``limits`` should be stored.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in made]
    size = word_count(F.col(quoted(text))) if size is None else size
    quality = quality_weight(F.col(quoted(text))) if quality is None else quality
    rows = _keyed(docs, kept, id, source, size, quality, seed, buckets)
    few = limits.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(limits) if few else limits, ["nameless", "mix_source"])
    at = F.col("last")
    by_id = F.when(F.col("id").eqNullSafe(at["id"]), F.col("size") <= at["size"]).otherwise(F.col("id").isNull() | F.coalesce(F.col("id") < at["id"], F.lit(False)))
    upto = F.when(at.isNull(), F.lit(False)).when(F.col("key") < at["key"], True).when(F.col("key") > at["key"], False).otherwise(by_id)
    picked = F.when(F.col("range") < F.col("last_range"), True).when(F.col("range") > F.col("last_range"), False).otherwise(upto)
    copies = F.col("epochs") + picked.cast("long")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, quality: Column | None = None, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, seed: str = "mix-1", buckets: int = 1024) -> DataFrame:
    """``docs`` with size, source_size, target, copies (times the document is taken) and taken (words).

    ``size`` and ``quality`` default to the words and the symbol share of ``text``. Pass them as
    columns worked out before, and ``docs`` without texts, where only the decisions matter.
    """
    limits = cut(mix_limits(docs, id, source, text, size, quality, weights, cap, seed, buckets))
    return apply_limits(docs, limits, id, source, text, size, quality, seed, buckets)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document that has words as often as it is taken."""
    return mixed.where("copies > 0").select(*[F.col(quoted(c)) for c in columns], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(spare(columns, "copy_no"))).select(*[quoted(c) for c in columns])
