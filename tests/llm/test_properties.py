"""Properties on random texts, without Spark."""

import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("barwright.llm.catalog")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from barwright.llm.arrow import utf8  # noqa: E402
from barwright.llm.bpe import WordBpe  # noqa: E402
from barwright.llm.jaccard import _shared, shingles, signatures, spanning, survivors  # noqa: E402
from barwright.llm.queries.op7_bpe import vocab_path  # noqa: E402
from barwright.llm.style_tree import parse  # noqa: E402
from barwright.llm.words import hashed_words  # noqa: E402

TEXT = st.text(alphabet=st.one_of(st.sampled_from("abcdeé ß'\n\t\x0b\x1c\xa0 19!.<|>ΣσςİÅ"), st.characters(exclude_categories=("Cs",), max_codepoint=0x2FFF)), max_size=60)
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab_path()), WordBpe(open(vocab_path(), "rb").read())


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=4))
def test_bpe_equals_the_library(coders, texts):
    library, own = coders
    # characters that are newer than either library's tables may class differently
    assert own.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=6), piece=st.sampled_from([1, 7, 1 << 20]))
def test_words_and_shingles(texts, piece):
    column = pa.array(texts)
    data, offsets = utf8(column)
    _, starts, ends, words = hashed_words(data, offsets, piece)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == [w for t in texts for w in WORD.findall(t)]
    assert np.diff(words).tolist() == [len(WORD.findall(t)) for t in texts]
    grams, at, one, _ = shingles(column, 3)
    for k, t in enumerate(texts):
        w = WORD.findall(t)
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()}
        assert len(set(grams[at[k] : at[k + 1]].tolist())) == len(want)
        assert (one[k] == 0) == (not w)
    for a, x in enumerate(texts):
        for b, y in enumerate(texts):
            assert (one[a] == one[b]) == (WORD.findall(x) == WORD.findall(y))


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), n=st.integers(1, 40))
def test_spanning_finds_the_components_of_surviving_pairs(seed, n):
    g = np.random.default_rng(seed)
    bases = g.integers(0, 256, (3, 80), dtype=np.uint8)
    sig = bases[g.integers(0, 3, n)].copy()
    noise = g.random((n, 80)) < 0.25
    sig[noise] = g.integers(0, 256, noise.sum(), dtype=np.uint8)
    least = [9, 20, 32, 44, 56]
    x, y = survivors(sig, sig, least)
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        if (before == root).all():
            break
    leader = spanning(sig, least)
    assert all((leader[a] == leader[b]) == (root[a] == root[b]) for a in range(n) for b in range(n))


@settings(max_examples=60, deadline=None)
@given(sets=st.lists(st.sets(st.integers(1, 60), max_size=30), min_size=1, max_size=12))
def test_shared_counts(sets):
    flat = np.array([x for s in sets for x in sorted(s)], dtype=np.uint64)
    owner = np.array([k for k, s in enumerate(sets) for _ in s], dtype=np.int64)
    got = _shared(flat, owner, len(sets))
    assert all(got[a, b] == len(sets[a] & sets[b]) for a in range(len(sets)) for b in range(len(sets)) if a != b)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig = signatures(flat, at, 16)
    assert all((sig[a] == sig[b]).all() for a in range(len(sets)) for b in range(len(sets)) if sets[a] == sets[b])


TAGS = st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<b>", "</b>", "<br>", "<li>", "</ul>", "<script>x</p>", "</script>", "<!-- c", "-->", "<td>", "<tr>", "</table>", "text ", "&amp;", "<", "\"", "'", "<a href=\"", ">", "<main", "</"])


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(TAGS, max_size=30))
def test_any_markup_parses(parts):
    blocks, shapes = parse("".join(parts))
    assert all(text and text == " ".join(text.split()) for _, _, text in blocks) and isinstance(shapes, dict)
