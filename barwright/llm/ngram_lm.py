"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

The relations are those of the textbook plan: n-grams of all orders exploded from documents,
a count table of them partitioned by hash, the two joined, and scores summed by document. On
the way a row holds many n-grams: those of one block of documents in one range of hashes (see
``blocks``), which takes a quarter of the bytes of a row for each. Blocks ask only for n-grams
that other blocks have too - the others' counts are the block's own - so nothing is pruned.

1. Blocks send probes of their distinct n-grams, buckets tell which are shared.
2. Blocks send their shared n-grams with counts. A bucket sums these over the corpus - the
   count table of its range of hashes - and joins the sums back to the blocks' n-grams.
3. In its block each document joins its n-grams to their counts and sums its score.

With ``held_out`` a document's own occurrences are taken off all counts first, so that it is
scored by the rest of the corpus and back-off takes place; else every n-gram of the corpus
counts at least once and none ever backs off.

S(w | h) = count(h w) / count(h) where both are over 0, else ``backoff`` * S(w | shorter h);
for single words count(w) / N, and 1 / N where the word is new (N: all words of the corpus,
less the document's own with ``held_out``, at least 1).

N-grams are told apart by 64-bit hashes: among n different ones n * n / 2**65 pairs are
expected to share counts, one n-gram in some four million at 10**13.

Defined results: null, blank and empty texts have 0 words, log_score 0 and a null per_word
score; rows may repeat and share ids; an empty table gives an empty table; other columns stay,
but one named like an output column, in any case, is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barwright.llm.arrow import numbered, quoted, utf8
from barwright.llm.blocks import by_bucket, in_blocks, pack_sorted, probes, rest, shared_hashes, shared_lists, shares, squeeze, tell, unsqueeze, whole
from barwright.llm.words import hashed_words, mix, window_hashes, word_count


#: Bytes of text of a block; the larger, the fewer times a common n-gram is sent.
BLOCK_BYTES = 4 << 20


class _Block:
    """A block's n-grams of all orders: hashes, the word number each ends at, and the document of each."""

    def __init__(self, texts: pa.ChunkedArray, order: int) -> None:
        data, offsets = utf8(texts)
        words, _, _, self.words = hashed_words(data, offsets)
        self.owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.words))
        self.ends: list[np.ndarray] = []
        found = []
        for n in range(1, order + 1):
            ends = np.arange(n - 1, len(words))
            ends = ends[self.owner[ends] == self.owner[ends - n + 1]] if len(ends) else ends
            found.append(mix(window_hashes(words, n)[ends - n + 1] + np.uint64(n)))
            self.ends.append(ends)
        self.hashes = np.concatenate(found)

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, ascending, and how often the block has each."""
        return np.unique(self.hashes, return_counts=True)


def stupid_backoff(docs: DataFrame, text: str = "text", order: int = 3, backoff: float = 0.4, held_out: bool = True, id: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_backed_off, log_score (sum of natural logs) and per_word (its mean).

    ``buckets`` is worked out from the bytes of the texts unless it is given.
    """
    made = T.StructType([T.StructField(n, T.DoubleType() if n in ("log_score", "per_word") else T.LongType()) for n in ("n_words", "n_backed_off", "log_score", "per_word")])
    names = {f.name for f in made.fields}
    blocks, by_bytes, (total,) = shares(docs, text, F.sum(word_count(F.col(quoted(text)))), block_bytes=BLOCK_BYTES)
    total, buckets = total or 0, buckets or by_bytes
    kept = [c for c in docs.columns if c.lower() not in names]
    base, safe = numbered(docs, kept)
    id, text, where = safe[id], safe[text], "block"
    rows = in_blocks(base, id, text, blocks, where)

    def probe(table: pa.Table) -> pa.Table:
        number = table.column(where)[0].as_py()
        out = [(bucket, number, pack_sorted(own)) for bucket, own in probes(_Block(table.column(text), order).hashes, buckets)]
        return pa.Table.from_pydict(dict(zip(probed.names, zip(*out), strict=True)) if out else {n: [] for n in probed.names}, schema=probed)

    def answered_probes(table: pa.Table) -> pa.Table:
        return tell(table, told, where)

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in questions.names}
        if table.num_rows:
            grams, counts = _Block(table.column(text), order).counted()
            asked = shared_hashes(grams, buckets, dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True)))
            grams, counts, number = grams[asked], counts[asked], table.column(where)[0].as_py()
            for bucket, own in by_bucket(grams, buckets):
                for key, value in zip(out, (bucket, number, *rest(grams[own], buckets), squeeze(counts[own], True)), strict=True):
                    out[key].append(value)
        return pa.table(out, schema=questions)

    def count(sent: pa.Table, table: pa.Table) -> pa.Table:
        """A bucket's count table, joined back: what other blocks hold of each block's n-grams."""
        if not table.num_rows:
            return answered.empty_table()
        known = shared_lists(sent, where)
        grams = [whole(known[b], x, y, buckets) for b, x, y in zip(*(table.column(c).to_pylist() for c in (where, "grams", "fresh")), strict=True)]
        own = np.concatenate([unsqueeze(x) for x in table.column("counts").to_pylist()])
        _, which = np.unique(np.concatenate(grams), return_inverse=True)
        elsewhere = np.bincount(which, weights=own).astype(np.int64)[which] - own
        parts = np.split(elsewhere, np.cumsum([len(x) for x in grams])[:-1])
        return pa.table({where: table.column(where), "bucket": table.column("bucket"), "counts": [squeeze(x, True) for x in parts]}, schema=answered)

    def score(table: pa.Table, bits: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table.column(text), order)
        # equal hashes are in order of place, so those of one document are neighbours
        owner = np.concatenate([block.owner[ends] for ends in block.ends])
        ranks = np.argsort(block.hashes, kind="stable")
        ranked, owned = block.hashes[ranks], owner[ranks]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
        grams, which = ranked[fresh], np.cumsum(fresh) - 1
        counts = np.bincount(which, minlength=len(grams)).astype(np.int64)
        asked = np.flatnonzero(shared_hashes(grams, buckets, dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))))
        held = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        for bucket, own in by_bucket(grams[asked], buckets):
            counts[asked[own]] += unsqueeze(held[bucket])
        found = counts[which]
        if held_out and len(found):
            starts = np.flatnonzero(fresh | np.concatenate([[True], owned[1:] != owned[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(found)]]))
            found -= np.repeat(sizes, sizes)
        each = np.empty(len(found), dtype=np.int64)
        each[ranks] = found
        each = np.split(each, np.cumsum([len(e) for e in block.ends])[:-1])
        # from single words up, the longest order with a count wins
        n_words = np.diff(block.words)
        everything = np.maximum(total - (n_words if held_out else 0 * n_words), 1)[block.owner].astype(np.float64)
        logs = np.log(np.maximum(each[0], 1)) - np.log(everything)
        depth = np.minimum(np.arange(len(block.owner)) - block.words[:-1][block.owner], order - 1)
        level = np.zeros(len(block.owner), dtype=np.int64)
        for n in range(1, order):
            ends = block.ends[n]
            context, full = each[n - 1][np.searchsorted(block.ends[n - 1], ends - 1)], each[n]
            hit = (full > 0) & (context > 0)
            logs[ends[hit]] = np.log(full[hit]) - np.log(context[hit])
            level[ends[hit]] = n
        logs += np.log(backoff) * (depth - level)
        sums = np.bincount(block.owner, weights=logs, minlength=len(n_words))
        backed = np.bincount(block.owner, weights=(depth > level), minlength=len(n_words)).astype(np.int64)
        mean = pa.array(np.divide(sums, n_words, out=np.zeros(len(sums)), where=n_words > 0), mask=n_words == 0)
        base = table.drop_columns([where])
        return pa.table([*base.columns, pa.array(n_words), pa.array(backed), pa.array(sums), mean], names=out_schema.names).cast(out_schema)

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        is_bits = answers.column("bits").is_valid()
        return score(table, answers.filter(is_bits), answers.filter(answers.column("counts").is_valid()))

    probed = pa.schema([("bucket", pa.int32()), (where, pa.int32()), ("probes", pa.binary())])
    told = pa.schema([(where, pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
    questions = pa.schema([("bucket", pa.int32()), (where, pa.int32()), ("grams", pa.binary()), ("fresh", pa.binary()), ("counts", pa.binary())])
    answered = pa.schema([(where, pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary())])
    out_type = T.StructType([f for f in rows.schema.fields if f.name != where] + made.fields)
    out_schema = to_arrow_schema(out_type)
    sent = rows.groupBy(where).applyInArrow(probe, f"bucket int, {where} int, probes binary")
    bits = sent.groupBy("bucket").applyInArrow(answered_probes, f"{where} int, bucket int, bits binary")
    asked = rows.groupBy(where).cogroup(bits.groupBy(where)).applyInArrow(ask, f"bucket int, {where} int, grams binary, fresh binary, counts binary")
    counts = sent.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(count, f"{where} int, bucket int, counts binary")
    answers = bits.unionByName(counts, allowMissingColumns=True)
    return rows.groupBy(where).cogroup(answers.groupBy(where)).applyInArrow(scored, out_type).toDF(*kept, *made.names)
