"""BPE encoding by speculation and verification, and decoding.

Each distinct word is first cut by greedy longest match, a mere proposal. Then every
adjacent pair of proposed tokens is tested for compatibility: walking the two tokens'
merge trees from the seam shows whether exact BPE would ever have merged across it. A
token sequence all of whose adjacent pairs are compatible is the exact result, so only
words with a failing pair undergo exact merging. The pair test runs on numpy arrays of
all new pairs at once; words, pairs and results are cached in each Python worker.

Defined results: null and empty texts give no tokens and an empty decoded text; strings
equal to an added token become that token's id, as in the tokenizers library; texts of
any length are processed whole; repeated rows are encoded alike; an input column named
like an output column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barwright.llm.arrow import add_columns

#: Words kept in a worker's cache; beyond it only those of the batch at hand stay.
CACHED_WORDS = 300_000
_NEVER = np.int64(1 << 40)
#: Bytes from which a word is merged by itself; rounds over all words are as many as the longest one's merges.
LONG_WORD = 128

#: Letters, digits and white space below U+0250, where Python's faster ``re`` agrees with the file's pattern.
_LETTERS = "a-zA-Zªµºß-öø-ɏÀ-ÖØ-Þ"
_DIGITS = "0-9²³¹¼½¾"
_BLANK = "\\x09-\\x0d\\x20\\x85\\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANK}{_LETTERS}{_DIGITS}]+")
_BEYOND = re.compile("[^\x00-ɏ]")

#: Letters and digits of Unicode 17, which the library's tables don't know yet, and
#: lower case letters that it knows and Python's tables don't.
_UNKNOWN = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479"
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0xA7CE: 0xA7CF} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}
_NEW_CAPITALS = re.compile(f"[{''.join(map(chr, _LOWER))}]")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class WordBpe:
    """The tokenizer of a file in the tokenizers library's JSON format, with word ends and byte letters."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        size = max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        #: When a token comes to be; those of single letters are always there.
        self.born = np.full(size, -1, dtype=np.int64)
        for (a, b), (rank, made) in ranks.items():
            if self.born[made] < 0:
                self.left[made], self.right[made], self.born[made] = a, b, rank
        pairs = np.array([(a << 32) | b for a, b in ranks], dtype=np.int64)
        order = np.argsort(pairs)
        self.pair_keys = pairs[order]
        self.ranks = ranks
        self.pair_ranks, self.pair_made = np.array(list(ranks.values()), dtype=np.int64)[order].T.copy()
        self.names = [""] * size
        for name, at in self.vocab.items():
            self.names[at] = name
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, at in self.added.items():
            self.names[at] = name
        self.names = np.array(self.names, dtype=object)
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        unknown = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in _UNKNOWN.split())
        split = split.replace("[^\\s\\p{L}\\p{N}]", f"(?:[^\\p{{White_Space}}\\p{{L}}\\p{{N}}]|[{unknown}])")
        for kind in ("\\p{L}", "\\p{N}"):
            split = split.replace(f"[{kind}]", f"[{kind}--[{unknown}]]")
        self.pattern = regex.compile(split, regex.V1)
        self.longest = max(map(len, self.vocab))
        self.letters = _byte_letters()
        byte = range(256)
        self.letter = np.array([self.vocab[self.letters[b]] for b in byte], dtype=np.int64)
        self.final_letter = np.array([self.vocab[self.letters[b] + self.end] for b in byte], dtype=np.int64)
        self.proposed = self.merged = 0
        self.forget()

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; a final token carries the word's end."""
        vocab, end, n, at, out = self.vocab, self.end, len(word), 0, []
        while at < n:
            if n - at <= self.longest and (token := vocab.get(word[at:] + end)) is not None:
                out.append(token)
                return out
            for to in range(min(n - 1, at + self.longest), at, -1):
                if (token := vocab.get(word[at:to])) is not None:
                    out.append(token)
                    at = to
                    break
            else:
                raise KeyError(f"no token for {word[at]!r}")
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair, whether exact merging of both tokens' letters leaves the seam between them.

        The walk undoes merges, latest first. At each step the two tokens that meet at the
        seam would have merged if their own merge comes before the next one of either side;
        at equal rank the left one goes first.
        """
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        good, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = (x << 32) | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            bad = (rank < until_a[live]) & (rank <= until_b[live])
            good[live[bad]] = False
            born_x, born_y = self.born[x], self.born[y]
            undo_x = born_x > born_y
            more = ~bad & ((born_x >= 0) | (born_y >= 0))
            left, right = live[more & undo_x], live[more & ~undo_x]
            until_a[left] = self.born[a[left]]
            a[left] = self.right[a[left]]
            until_b[right] = self.born[b[right]]
            b[right] = self.left[b[right]]
            live = live[more]
        return good

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of all words: long ones by themselves, others side by side, each round making every word's lowest-ranked, leftmost merge."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if long:
            out: list[np.ndarray] = [self.merge_long(w) if len(w) > LONG_WORD else w for w in words]  # type: ignore[misc]
            short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
            for i, ids in zip(short, self.merge_many([words[i] for i in short]) if short else ()):
                out[i] = ids
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids, owner = self.letter[data], np.repeat(np.arange(len(words)), sizes)
        last = np.cumsum(sizes) - 1
        ids[last] = self.final_letter[data[last]]
        rank, made = self.ranked(ids, owner)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            # the best pair of each word: rank first, then place
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.concatenate([starts, [len(ids)]]))
            over = np.repeat(best == _NEVER, counts)
            if over.any():
                done.append((owner[over], ids[over]))
                ids, owner, rank, made = ids[~over], owner[~over], rank[~over], made[~over]
                continue
            hits = np.flatnonzero(rank == np.repeat(best, counts))
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            ids[hits] = made[hits]
            stay = np.ones(len(ids), dtype=bool)
            stay[hits + 1] = False
            at = hits - np.arange(len(hits))
            ids, owner, rank, made = ids[stay], owner[stay], rank[stay], made[stay]
            touched = np.concatenate([at, at[at > 0] - 1])
            right = np.minimum(touched + 1, len(ids) - 1)
            rank[touched], made[touched] = self.looked_up(ids[touched], ids[right], (owner[touched] == owner[right]) & (right > touched))
        owners, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owners, kind="stable")
        return np.split(flat[order], np.searchsorted(owners[order], np.arange(1, len(words))))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Exact merging of one long word: a heap of its merges by rank and place, each letter linked to its neighbours."""
        ids = self.letter[np.frombuffer(word, dtype=np.uint8)].tolist()
        ids[-1] = int(self.final_letter[word[-1]])
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.ranks[a, b], at, a, b) for at, (a, b) in enumerate(zip(ids, ids[1:])) if (a, b) in self.ranks]
        heap = [(rank, at, made, a, b) for rank, made, at, a, b in heap]
        heapify(heap)
        while heap:
            _, at, made, a, b = heappop(heap)
            right = after[at] if ids[at] == a else -1
            if right < 0 or ids[right] != b:
                continue  # one of the two is merged by now
            ids[at], ids[right] = made, -1
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                pair = (ids[left], ids[after[left]]) if left >= 0 and after[left] >= 0 else None
                if pair in self.ranks:
                    rank, new = self.ranks[pair]
                    heappush(heap, (rank, left, new, *pair))
        return np.array([i for i in ids if i >= 0], dtype=np.int64)

    def looked_up(self, a: np.ndarray, b: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair's merge; never where there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = real & (self.pair_keys[at] == key)
        return np.where(found, self.pair_ranks[at], _NEVER), self.pair_made[at]

    def ranked(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        real = np.zeros(len(ids), dtype=bool)
        real[:-1] = owner[1:] == owner[:-1]
        return self.looked_up(ids, np.roll(ids, -1), real)

    def learn(self, words: set[str]) -> None:
        """Encode distinct words that aren't in the cache."""
        letters, new = self.letters, list(words)
        cuts = [self.propose(w if w.isascii() and w.isprintable() else "".join([letters[x] for x in w.encode()])) for w in new]
        self.proposed += len(new)
        sizes = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        flat = np.fromiter(chain.from_iterable(cuts), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(new)), sizes)
        seams = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = (flat[seams] << 32) | flat[seams + 1]
        keys = np.sort(pairs)
        keys = keys[np.diff(keys, prepend=-1) != 0]
        fine = self.compatible(keys >> 32, keys & 0xFFFFFFFF)
        failing = np.zeros(len(new), dtype=bool)
        if len(keys):
            failing[owner[seams[~fine[np.searchsorted(keys, pairs)]]]] = True
        bad = np.flatnonzero(failing)
        self.merged += len(bad)
        parts = [flat[~failing[owner]]]
        if len(bad):
            exact = self.merge_many([new[i].encode() for i in bad])
            parts += exact
            sizes[bad] = [len(x) for x in exact]
        order = np.concatenate([np.flatnonzero(~failing), bad])
        sizes = sizes[order]
        base, first = len(self.sizes), len(self.flat)
        self.flat = np.concatenate([self.flat, *parts])
        self.starts = np.concatenate([self.starts, first + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.index.update(zip([new[i] for i in order.tolist()], range(base, base + len(new)), strict=True))

    def forget(self, kept: set[str | int] | None = None) -> None:
        """Empty the cache but for the words ``kept``; added tokens stay."""
        words = [w for w in kept or () if isinstance(w, str)]
        places = [self.index[w] for w in words]
        added = list(self.added.values())
        own = [self.flat[self.starts[p] : self.starts[p] + self.sizes[p]] for p in places]
        self.sizes = np.array([1] * len(added) + [len(x) for x in own], dtype=np.int64)
        self.flat = np.concatenate([np.array(added, dtype=np.int64), *own])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.index: dict[str | int, int] = dict(zip([*added, *words], range(len(self.sizes)), strict=True))

    def split(self, text: str) -> list[str]:
        """The normalised text's pieces."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if _NEW_CAPITALS.search(text):
            text = text.translate(_LOWER)
        text = "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()
        return (self.pattern if _BEYOND.search(text) else _LATIN).findall(text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and the n + 1 offsets of the texts in it."""
        pieces: list[list[str | int]] = []
        for text in texts:
            if self.added_pattern is None or not self.added_pattern.search(text):
                pieces.append(self.split(text))
                continue
            own: list[str | int] = []
            at = 0
            for m in self.added_pattern.finditer(text):
                own += [*self.split(text[at : m.start()]), self.added[m[0]]]
                at = m.end()
            pieces.append(own + self.split(text[at:]))
        wanted = set().union(*pieces)
        if len(self.index) > CACHED_WORDS:
            self.forget(wanted & self.index.keys())
        new = wanted - self.index.keys()
        if new:
            self.learn(new)
        places = np.fromiter(map(self.index.__getitem__, chain.from_iterable(pieces)), dtype=np.int64)
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        values = self.flat[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        words = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        return values.astype(np.int32), np.concatenate([[0], np.concatenate([[0], ends])[words]])

    def encode(self, texts: list[str]) -> list[list[int]]:
        values, offsets = self.encode_batch(texts)
        return [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, special ones too, as the library does without a decoder."""
        return " ".join(self.names[ids].tolist())


_LOADED: dict[bytes, WordBpe] = {}


def loaded(source: bytes) -> WordBpe:
    """One tokenizer for each Python worker and file."""
    key = hashlib.sha256(source).digest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(source)
    return _LOADED[key]


def encode_decode(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded_text") -> DataFrame:
    """``docs`` with the token ids of ``text`` and the text decoded from those ids.

    ``vocab_path`` is read on the driver; the file's bytes (1.7 MB, fixed by the vocabulary)
    go to the workers as a broadcast.
    """
    with open(vocab_path, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch, names: dict[str, str]) -> list[pa.Array]:
        bpe = loaded(source.value)
        values, offsets = bpe.encode_batch([x or "" for x in batch.column(names[text]).to_pylist()])
        texts = [bpe.decode(values[a:b]) for a, b in zip(offsets, offsets[1:])]
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)), pa.array(texts, type=pa.string())]

    return add_columns(docs, {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, run, text)
