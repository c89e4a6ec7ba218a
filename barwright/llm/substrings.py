"""Removal of word passages that also stand in an earlier document.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. In three steps over blocks
of documents and ranges of hashes (see ``blocks``) windows are counted across the corpus:
blocks send probes of their windows and buckets tell which are shared; of these blocks send the
hash, a second, independent one, and the smallest document id; buckets answer which windows
start in a document with a smaller id. A window counts as repeated only if both hashes, 128
bits, agree. Covered words merge into maximal intervals, which are cut out. Windows are judged
on the input only.

Words are told apart by 64-bit hashes, windows of them by 128 bits; at 10**13 different windows
a false removal is expected once in some 10**12 corpora.

Defined results: null, blank and short texts lose nothing; a null id neither removes nor
loses words; rows with the same id don't remove each other's words; passages repeated
inside one document stay; an empty table gives an empty table; other columns stay, but one
named like an output column, in any case, is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barwright.llm.arrow import numbered, utf8
from barwright.llm.blocks import by_bucket, in_blocks, pack_sorted, probes, shared_hashes, shares, squeeze, tell, unpack_sorted, unsqueeze
from barwright.llm.words import hashed_words, second_hashes, window_hashes, window_starts

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class _Block:
    """The documents of one block by id, and their windows, those of null ids left out."""

    def __init__(self, table: pa.Table, id: str, text: str, width: int, mask: np.uint64) -> None:
        ids = table.column(id).cast(pa.int64()).combine_chunks()
        known = np.asarray(pc.is_valid(ids))
        filled = np.asarray(pc.fill_null(ids, 0))
        self.order = np.lexsort((filled, ~known))
        self.ids, known = filled[self.order], known[self.order]
        self.data, self.offsets = utf8(pc.fill_null(table.column(text).cast(pa.large_string()), "").combine_chunks().take(pa.array(self.order)))
        self.word_hashes, self.starts, self.ends, self.words = hashed_words(self.data, self.offsets)
        at = window_starts(self.words, width)
        doc = np.searchsorted(self.words, at, side="right") - 1
        self.at, self.doc = at[known[doc]], doc[known[doc]]
        self.hashes = window_hashes(self.word_hashes, width)[self.at] & mask
        self.width = width

    def group(self) -> None:
        """Find the distinct windows: by hash, then by the second one where equal hashes differ in it."""
        self.seconds = window_hashes(second_hashes(self.word_hashes), self.width)[self.at]
        order = np.argsort(self.hashes, kind="stable")
        same = self.hashes[order][1:] == self.hashes[order][:-1]
        if (self.seconds[order][1:] != self.seconds[order][:-1])[same].any():
            order = np.lexsort((self.seconds, self.hashes))
        ranked, seconds = self.hashes[order], self.seconds[order]
        fresh = np.concatenate([[True], (ranked[1:] != ranked[:-1]) | (seconds[1:] != seconds[:-1])])[: len(order)]
        #: For each window the distinct one, and for each of these its first window; documents ascend, so it has the smallest id.
        self.which = np.empty(len(order), dtype=np.int64)
        self.which[order] = np.cumsum(fresh) - 1
        self.lead = order[fresh]

    def shared(self, told: pa.Table, buckets: int) -> np.ndarray:
        """Places among the distinct windows of those that another block may have."""
        bits = dict(zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist(), strict=True))
        return np.flatnonzero(shared_hashes(self.hashes[self.lead], buckets, bits))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 13, buckets: int | None = None, hash_bits: int = 64) -> DataFrame:
    """``docs`` with n_words, removed (maximal word intervals, end exclusive), n_removed and kept_text.

    ``buckets`` is worked out from the bytes of the texts unless it is given. ``hash_bits``
    under 64 shorten the first hash, so that tests can see collisions.
    """
    made = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("removed", SPAN), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    names = {f.name for f in made.fields}
    mask = np.uint64((1 << 64) - (1 << (64 - hash_bits)))
    blocks, by_bytes, _ = shares(docs, text)
    buckets = buckets or by_bytes
    kept = [c for c in docs.columns if c.lower() not in names]
    base, safe = numbered(docs, kept)
    id, text, where = safe[id], safe[text], "block"
    rows = in_blocks(base, id, text, blocks, where)

    def probe(table: pa.Table) -> pa.Table:
        number = table.column(where)[0].as_py()
        out = [(bucket, number, pack_sorted(own)) for bucket, own in probes(_Block(table, id, text, width, mask).hashes, buckets)]
        return pa.Table.from_pydict(dict(zip(probed.names, zip(*out), strict=True)) if out else {n: [] for n in probed.names}, schema=probed)

    def answered_probes(table: pa.Table) -> pa.Table:
        return tell(table, told, where)

    def ask(table: pa.Table, bits: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in asked.names}
        if table.num_rows and bits.num_rows:
            block = _Block(table, id, text, width, mask)
            block.group()
            lead = block.lead[block.shared(bits, buckets)]
            hashes, ids = block.hashes[lead], block.ids[block.doc[lead]]
            known, place = np.unique(ids, return_inverse=True)
            number = table.column(where)[0].as_py()
            for bucket, own in by_bucket(hashes, buckets):
                few, which = np.unique(place[own], return_inverse=True)
                steps = np.concatenate([known[few][:1], np.diff(known[few])])
                for key, value in zip(out, (bucket, number, pack_sorted(hashes[own]), block.seconds[lead[own]].astype("<u8").tobytes(), squeeze(steps), squeeze(which, True)), strict=True):
                    out[key].append(value)
        return pa.table(out, schema=asked)

    def answer(table: pa.Table) -> pa.Table:
        each = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
        hashes = np.concatenate(each)
        seconds = np.frombuffer(b"".join(table.column("seconds").to_pylist()), dtype="<u8")
        ids = np.concatenate([np.cumsum(unsqueeze(x))[unsqueeze(y)] for x, y in zip(table.column("ids").to_pylist(), table.column("places").to_pylist(), strict=True)])
        order = np.lexsort((seconds, hashes))
        fresh = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (seconds[order][1:] != seconds[order][:-1])])
        smallest = np.empty(len(ids), dtype=np.int64)
        smallest[order] = np.minimum.reduceat(ids[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        parts = np.split(ids > smallest, np.cumsum([len(x) for x in each])[:-1])
        return pa.table({where: table.column(where), "bucket": table.column("bucket"), "late": [np.packbits(p).tobytes() for p in parts]}, schema=answered)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out_schema.empty_table()
        block = _Block(table, id, text, width, mask)
        block.group()
        late = np.zeros(len(block.lead), dtype=bool)
        if answers.num_rows:
            bits, lates = answers.filter(answers.column("bits").is_valid()), answers.filter(answers.column("late").is_valid())
            places = block.shared(bits, buckets)
            told_late = dict(zip(lates.column("bucket").to_pylist(), lates.column("late").to_pylist(), strict=True))
            for bucket, own in by_bucket(block.hashes[block.lead[places]], buckets):
                late[places[own]] = np.unpackbits(np.frombuffer(told_late[bucket], dtype=np.uint8), count=own.stop - own.start).astype(bool)
        ids = block.ids[block.doc]
        gone = late[block.which] | (ids > ids[block.lead][block.which])
        n = len(block.starts)
        hit = block.at[gone]
        keep = np.cumsum(np.bincount(hit, minlength=n + 1) - np.bincount(hit + width, minlength=n + 1))[:n] == 0
        # intervals, cut where documents meet
        owner = np.repeat(np.arange(len(block.ids)), np.diff(block.words))
        edge = np.ones(n, dtype=bool)
        edge[1:] = (keep[1:] != keep[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(edge & ~keep)
        starts = np.flatnonzero(edge)
        end = np.concatenate([starts[1:], [n]])[np.searchsorted(starts, begin)] if n else begin
        shift = block.words[:-1][owner[begin]]
        spans = pa.StructArray.from_arrays([pa.array(begin - shift), pa.array(end - shift)], names=["start", "end"])
        span_offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[begin], minlength=len(block.ids)))]).astype(np.int32)
        # kept words, each but a document's last followed by one space
        data, marks = block.data.copy(), np.zeros(len(block.data) + 1, dtype=np.int8)
        kept = np.flatnonzero(keep)
        marks[block.starts[kept]] += 1
        marks[block.ends[kept]] -= 1
        stays = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
        followed = kept[:-1][owner[kept[1:]] == owner[kept[:-1]]]
        data[block.ends[followed]] = 32
        stays[block.ends[followed]] = True
        lengths = np.concatenate([[0], np.cumsum(stays)])[block.offsets]
        texts = pa.LargeStringArray.from_buffers(len(block.ids), pa.py_buffer(lengths.astype(np.int64).tobytes()), pa.py_buffer(data[stays].tobytes()))
        counts = np.diff(block.words)
        removed = counts - np.bincount(owner[kept], minlength=len(counts))
        base = table.drop_columns([where]).take(pa.array(block.order))
        return pa.table([*base.columns, pa.array(counts), pa.ListArray.from_arrays(pa.array(span_offsets), spans), pa.array(removed), texts.cast(pa.string())], names=out_schema.names).cast(out_schema)

    probed = pa.schema([("bucket", pa.int32()), (where, pa.int32()), ("probes", pa.binary())])
    told = pa.schema([(where, pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
    asked = pa.schema([("bucket", pa.int32()), (where, pa.int32()), ("hashes", pa.binary()), ("seconds", pa.binary()), ("ids", pa.binary()), ("places", pa.binary())])
    answered = pa.schema([(where, pa.int32()), ("bucket", pa.int32()), ("late", pa.binary())])
    out_type = T.StructType([f for f in rows.schema.fields if f.name != where] + made.fields)
    out_schema = to_arrow_schema(out_type)
    bits = rows.groupBy(where).applyInArrow(probe, f"bucket int, {where} int, probes binary").groupBy("bucket").applyInArrow(answered_probes, f"{where} int, bucket int, bits binary")
    questions = rows.groupBy(where).cogroup(bits.groupBy(where)).applyInArrow(ask, f"bucket int, {where} int, hashes binary, seconds binary, ids binary, places binary")
    lates = questions.groupBy("bucket").applyInArrow(answer, f"{where} int, bucket int, late binary")
    answers = bits.unionByName(lates, allowMissingColumns=True)
    return rows.groupBy(where).cogroup(answers.groupBy(where)).applyInArrow(cut, out_type).toDF(*kept, *made.names)
