"""Similarity join on word n-grams: MinHash bands, Bayesian candidate pruning, exact verification.

1. Texts with the same word sequence are one text from here on, with a number of copies.
2. Texts that share one of ``bands`` bands of ``rows`` MinHash values are candidates. Inside a
   band's group MinHash values are compared sixteen at a time. With a uniform prior the
   similarity of a pair with m matches among n is Beta(m + 1, n - m + 1); the pair is dropped
   once its probability of reaching the threshold falls below ``tolerance``. The group is
   searched breadth first, so its surviving pairs' components come out without listing them.
3. Surviving components go through one exchange with their texts. All their pairs undergo the
   same pruning, and the rest are verified exactly on whole n-gram sets. A component of more
   than ``tile`` texts is dealt as pairs of tiles.
4. Links are counted, and verified components are the classes.

At the defaults a pair of similarity 0.8 shares no band with a chance of 3e-5.

Groups of bands are bucketed by their bytes. A band of more than ``hot_rows`` texts, or of more
than one in 2,500 of all where that is more, is dealt as pairs of parts, each pair a group of its own; such
bands are found in a sample of one text in ``sample``, and by their definition they are at
most 50,000 or so, which is what goes to the driver and back. A band that the sample
misjudges is only a larger or a smaller group. Tiles grow with their component, from ``tile``
to ``TILE`` texts, so a text is sent out at most 64 times up to 130,000 texts of a component,
and once for each 2,048 beyond; that all its pairs are compared is what counting its links takes.

Defined results: texts without words take no part (own class, no links), nor do null ids
(null class); texts with fewer words than ``width`` have one n-gram, all their words; rows
with equal words are copies and linked to each other; repeated ids count as rows; ties go to
the smallest id; an empty table gives an empty table; other columns aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.arrow import chunks, quoted, small_batches, utf8
from barwright.llm.blocks import by_bucket, partitions
from barwright.llm.components import components
from barwright.llm.words import hashed_words, mix, powers, window_hashes, window_starts
from barwright.session import cut

_STEP = 16
#: Bytes of bands that a task holds at a time, and the largest tile of a component.
BUCKET_BYTES, TILE = 12 << 20, 2048


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(1, 1 << 63, n, dtype=np.uint64)


def shingles(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's word n-grams with n + 1 offsets, and two hashes of its word sequence (0, 0 without words)."""
    data, offsets = utf8(column)
    hashes, _, _, words = hashed_words(data, offsets)
    counts = np.diff(words)
    keys = []
    local = np.arange(len(hashes)) - np.repeat(words[:-1], counts)
    solid = np.flatnonzero(counts)
    for base in (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)):
        own = np.zeros(len(counts), dtype=np.uint64)
        if len(solid):
            own[solid] = mix(np.add.reduceat(mix(hashes ^ base) * powers(base, int(counts.max()))[local], words[:-1][solid]) + counts[solid].astype(np.uint64))
        keys.append(own)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(out_offsets[-1], dtype=np.uint64)
    full = np.repeat(counts >= width, n)
    out[full] = window_hashes(hashes, width)[window_starts(words, width)] if len(hashes) else 0
    out[~full] = keys[0][(counts > 0) & (counts < width)]
    return out, out_offsets, keys[0], keys[1]


def signatures(grams: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """MinHash values, 32 bits each; texts without n-grams get the largest."""
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, dtype=np.uint32)
    solid = np.flatnonzero(np.diff(offsets))
    if len(solid):
        starts = offsets[:-1][solid]
        for k, (a, b) in enumerate(zip(*_seeds(n), strict=True)):
            out[solid, k] = np.minimum.reduceat(((grams * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_matches(threshold: float, tolerance: float, n: int) -> list[int]:
    """For each step of sixteen values, the matches with which a pair stays.

    P(similarity >= t | m of n match) is the chance of at most m successes in n + 1 trials at
    t. Low bytes are compared, which match by accident once in 256, so t is raised by that.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for seen in range(_STEP, n + 1, _STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the pairs that pruning leaves; a and b are low bytes of MinHash values."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), rows):
        matches = np.zeros((len(a[at : at + rows]), len(b)), dtype=np.uint8)
        for k in range(_STEP):
            matches += a[at : at + rows, k, None] == b[None, :, k]
        x, y = np.nonzero(matches >= least[0])
        count = matches[x, y].astype(np.int64)
        for step, most in enumerate(least[1:], 1):
            s = slice(step * _STEP, (step + 1) * _STEP)
            for part in range(0, len(x), 1 << 17):
                p = slice(part, part + (1 << 17))
                count[p] += (a[at + x[p], s] == b[y[p], s]).sum(axis=1)
            stay = count >= most
            x, y, count = x[stay], y[stay], count[stay]
        found.append((at + x, y))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(p) for p in zip(*found, strict=True)) if found else (none, none)  # type: ignore[return-value]


def spanning(sig: np.ndarray, least: list[int]) -> np.ndarray:
    """Leader of each row's component among surviving pairs, breadth first: nearly linear where most rows agree."""
    n = len(sig)
    leader = np.arange(n)
    left = np.ones(n, dtype=bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        front = np.array([start])
        rest = np.flatnonzero(left)
        while len(front) and len(rest):
            _, hit = survivors(sig[front], sig[rest], least)
            front = rest[np.unique(hit)]
            leader[front] = start
            left[front] = False
            rest = rest[left[rest]]
    return leader


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each signature."""
    parts = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    keys = np.zeros((len(sig), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys + parts[:, :, r])
    return keys


def unpacked(column: pa.Array | pa.ChunkedArray, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, hashes)


def split_hot(keys: np.ndarray, owner: np.ndarray, nodes: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and owners with those of hot bands dealt: a text is in one of the band's parts, and goes to that part's pair with each."""
    if not len(hot) or not len(keys):
        return keys, owner
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    is_hot = hot[at] == keys
    n = parts[at[is_hot]]
    own = (mix(nodes[owner[is_hot]].view(np.uint64) ^ keys[is_hot]) % n.astype(np.uint64)).astype(np.int64)
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(own, n)
    pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
    dealt = mix(np.repeat(keys[is_hot], n) ^ mix(pair + np.uint64(1)))
    return np.concatenate([keys[~is_hot], dealt]), np.concatenate([owner[~is_hot], np.repeat(owner[is_hot], n)])


def jaccard_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 20, rows: int = 4, tolerance: float = 1e-6, tile: int = 128, hot_rows: int = 8192, sample: int = 64) -> DataFrame:
    """(id, class_id, n_links): each row's class, named by its smallest id, and how many other rows are similar to it."""
    small_batches(docs)
    hashes = bands * rows
    least = least_matches(threshold, tolerance, hashes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            grams, offsets, one, two = shingles(batch.column(text), width)
            sig = signatures(grams, offsets, hashes)
            solid = np.diff(offsets) > 0
            packed = pa.array([s.tobytes() for s in sig], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id).cast(pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(solid), packed], names=[id, "one", "two", "solid", "sig"])

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(unpacked(batch.column("sig"), hashes), bands, rows).reshape(-1).view(np.int64))], names=["key"])

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = unpacked(batch.column("sig"), hashes)
            nodes = np.asarray(batch.column("node"))
            flat, own = split_hot(band_keys(sig, bands, rows).reshape(-1), np.repeat(np.arange(len(sig)), bands), nodes, hot, parts)
            order = np.argsort(flat, kind="stable")
            flat, own, low = flat[order], own[order], sig.astype(np.uint8)
            out: dict[str, list] = {"bucket": [], "keys": [], "nodes": [], "low": []}
            for bucket, places in by_bucket(flat, buckets):
                for name, value in zip(out, (bucket, flat[places].tobytes(), nodes[own[places]].tobytes(), low[own[places]].tobytes()), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=banded)

    def pair(table: pa.Table) -> pa.Table:
        keys, nodes = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("keys", np.uint64), ("nodes", np.int64)))
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), dtype=np.uint8).reshape(-1, hashes)
        order = np.lexsort((nodes, keys))
        keys, nodes, low = keys[order], nodes[order], low[order]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(edges)
        a, b = [], []
        twos = edges[:-1][sizes == 2]
        count, alive = np.zeros(len(twos), dtype=np.int64), np.ones(len(twos), dtype=bool)
        for step, most in enumerate(least):
            s = slice(step * _STEP, (step + 1) * _STEP)
            count[alive] += (low[twos[alive], s] == low[twos[alive] + 1, s]).sum(axis=1)
            alive &= count >= most
        a.append(nodes[twos[alive]])
        b.append(nodes[twos[alive] + 1])
        for start, size in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = nodes[start : start + size]
            leader = spanning(low[start : start + size], least)
            led = np.flatnonzero(leader != np.arange(size))
            a.append(own[leader[led]])
            b.append(own[led])
        return pa.table([np.concatenate(a), np.concatenate(b)], schema=paired)

    def verify(table: pa.Table) -> pa.Table:
        grams, offsets, one, _ = shingles(table.column(text), width)
        wanted = np.asarray(table.column("node").combine_chunks())
        fits = one.view(np.int64) == wanted  # an id may stand for several texts
        _, first = np.unique(wanted[fits], return_index=True)
        rows_kept = np.flatnonzero(fits)[first]
        sets = [np.unique(grams[offsets[r] : offsets[r + 1]]) for r in rows_kept]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets)
        set_offsets = np.concatenate([[0], np.cumsum(sizes)])
        low = signatures(flat, set_offsets, hashes).astype(np.uint8)
        nodes, copies = wanted[rows_kept], np.asarray(table.column("copies").combine_chunks())[rows_kept]
        own_tile = np.asarray(table.column("tile").combine_chunks())[rows_kept]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = np.flatnonzero(own_tile == i)
        right = left if i == j else np.flatnonzero(own_tile == j)
        x, y = survivors(low[left], low[right], least)
        x, y = left[x], right[y]
        x, y = (x[x < y], y[x < y]) if i == j else (x, y)
        shared = _shared(flat, np.repeat(np.arange(len(sets)), sizes), len(sets), left, right)[np.searchsorted(left, x), np.searchsorted(right, y)] if len(x) else np.zeros(0)
        good = shared >= threshold * (sizes[x] + sizes[y] - shared) - 1e-9
        x, y = x[good], y[good]
        links = np.bincount(x, weights=copies[y], minlength=len(nodes)) + np.bincount(y, weights=copies[x], minlength=len(nodes))
        root = _roots(len(nodes), x, y)
        return pa.table([pa.array(nodes), pa.array(links.astype(np.int64)), pa.array(nodes[root]), pa.array(np.full(len(nodes), i != j or table.column("tiles")[0].as_py() > 1))], schema=checked)

    banded = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("low", pa.binary())])
    paired = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    checked = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("split", pa.bool_())])
    docs = docs.select(F.col(quoted(id)).cast("long").alias(id), F.col(quoted(text)).alias(text))
    named = docs.where(F.col(quoted(id)).isNotNull())
    signed = cut(named.mapInArrow(sign, f"{id} long, one long, two long, solid boolean, sig binary"))
    # sizes of what follows, and the bands that many texts share
    n_texts = signed.where("solid").agg(F.count("*")).first()[0]
    buckets = max(1, n_texts * bands * (hashes + 16) // BUCKET_BYTES, min(partitions(docs), n_texts * bands // 10_000))
    most = max(hot_rows, n_texts // 2500)
    sampled = signed.where(F.col("solid") & (F.pmod(F.xxhash64("one"), F.lit(sample)) == 0)).select("one", "two", "sig").dropDuplicates(["one", "two"])
    crowded = sampled.select("sig").mapInArrow(keys_only, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * sample > most).collect()
    crowded = sorted((r["key"] & (1 << 64) - 1, -(-r["n"] * sample // most) + 1) for r in crowded)
    hot, parts = np.array([k for k, _ in crowded], dtype=np.uint64), np.array([n for _, n in crowded], dtype=np.int64)
    texts = signed.where("solid").groupBy(F.col("one").alias("node"), "two").agg(F.min(id).alias("lead"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    edges = texts.select("node", "sig").mapInArrow(band, "bucket int, keys binary, nodes binary, low binary").groupBy("bucket").applyInArrow(pair, "a long, b long")
    found = components(edges)
    # texts of each component, in tiles
    leads = signed.where("solid").groupBy(F.col("one").alias("node")).agg(F.min(id).alias("lead"), F.count("*").alias("copies"))
    # sizes and names are written: their joins are then plain exchanges, which Spark splits where a component is hot
    m = F.count("*")
    tiles = F.greatest(F.least(F.ceil(m / tile), F.lit(64)), F.ceil(m / TILE)).cast("int")
    sizes = cut(found.groupBy("root").agg(tiles.alias("tiles")))
    members = found.join(sizes, "root").join(leads, "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("i"), F.greatest(k, F.col("tile")).alias("j")))
    work = members.join(named.select(F.col(quoted(id)).alias("lead"), F.col(quoted(text)).alias(text)), "lead").select("root", "tiles", "tile", "node", "copies", quoted(text), F.explode(spread).alias("ij")).select("root", "tiles", "tile", "node", "copies", quoted(text), "ij.i", "ij.j")
    verified = cut(work.groupBy("root", "i", "j").applyInArrow(verify, "node long, links long, root long, split boolean"))
    # a component in one tile is done; tiles of a larger one are put together
    joined = components(verified.where("split").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = verified.groupBy("node").agg(F.sum("links").alias("links"), F.min(F.when(~F.col("split"), F.col("root"))).alias("own"))
    per_node = per_node.join(joined, "node", "left").select("node", "links", F.coalesce("root", "own", "node").alias("class"))
    info = leads.join(per_node, "node", "left").select("node", "lead", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "node").alias("class"))
    names = cut(info.groupBy("class").agg(F.min("lead").alias("class_id")))
    info = info.join(names, "class").select("node", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    with_words = signed.where("solid").select(id, F.col("one").alias("node")).join(info, "node").select(id, "class_id", "n_links")
    alone = signed.where("not solid").select(id, F.col(id).alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    nameless = docs.where(F.col(quoted(id)).isNull()).select(quoted(id), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(alone).unionByName(nameless)


def _shared(grams: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
    """How many n-grams each left text shares with each right one, all of ``n`` by default: products of incidence columns, a few thousand n-grams at a time."""
    left, right = (np.arange(n) if side is None else side for side in (left, right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(grams):
        return out
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    which = np.cumsum(first) - 1
    common = np.bincount(which)[which] > 1
    which, owner = which[common], owner[common]
    which = np.cumsum(np.concatenate([[False], which[1:] != which[:-1]])) if len(which) else which
    width = max(1, (1 << 21) // n)
    for low in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        a, b = np.searchsorted(which, [low, low + width])
        part = np.zeros((n, min(width, int(which[b - 1]) - low + 1)), dtype=np.float32)
        part[owner[a:b], which[a:b] - low] = 1
        out += part[left] @ part[right].T
    return out


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest place in each place's component of the links (x, y)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        root = root[root]
        if (root == before).all():
            return root
