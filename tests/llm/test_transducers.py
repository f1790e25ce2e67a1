"""The compiled tokenizers against the library, over made-up and random texts."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe, bpe_stream, tokens
from quern.llm.common import package_path

BYTES, WORDS = package_path("byte_bpe_50k.json"), package_path("word_bpe_49k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", "d", "m", "r", "v", "l", "e", " ", "  ", "\n", "\t", "a", "B", "é", "1", "٣", "!", "<|endoftext|>", "<|startoftext|>",
         "　", "中", "\U0001f600", "́", "'S", "Ᲊ", "\x1c", "xxx", "Σ", "İ", "̈", "가", "ᄀ", "ᅡ", "the", "tion", "heron"]
texts = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_counts_and_ids_are_the_library_s(libraries, text):
    of_bytes, of_words = libraries
    assert tokens.counter(BYTES).counts([text])[0] == len(of_bytes.encode(text, add_special_tokens=False).ids)
    assert codec().encode(text) == of_words.encode(text, add_special_tokens=False).ids


def codec():
    return bpe_stream.codec_of(WORDS)


def test_streaming_in_pieces_holds_little(libraries):
    rng = random.Random(4)
    for n in range(200):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        encoder, out, i = bpe_stream.StreamingEncoder(codec(), hold=rng.choice([0, 3, 8, 4096])), [], 0
        while i < len(text):
            n = rng.randint(1, 5)
            out += encoder.feed(text[i : i + n])
            assert len(encoder.open) <= encoder.hold + 5
            i += n
        out += encoder.finish()
        assert out == libraries[1].encode(text, add_special_tokens=False).ids


def test_side_by_side_in_pieces(libraries):
    """The query's path: rounds of pieces over many texts, with runs that stay open over several of them."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", " ", "x" * 300]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [libraries[1].encode(t or "", add_special_tokens=False).ids for t in texts]
    for piece, hold in ((1 << 16, 1 << 12), (7, 5), (20, 10), (3, 0)):
        n, ids, decoded = bpe_stream.digests(WORDS).digests(texts, piece, hold)
        assert n == [len(w) for w in want]
        assert ids == [sha(" ".join(map(str, w))) for w in want]
        assert decoded == [sha(libraries[1].decode(w, skip_special_tokens=False)) for w in want]


def test_a_word_of_any_length_is_held_back_no_longer_than_the_lookahead(libraries):
    word = "".join(random.Random(1).choice("aeiouthnrs") for _ in range(20_000))
    encoder = bpe_stream.SymbolEncoder(codec())
    out = encoder.feed(word) + encoder.finish()
    assert out == libraries[1].encode(word, add_special_tokens=False).ids == codec().encode(word)
    assert encoder.held_most <= bpe.table(WORDS).sufficient_lookahead()


def test_states_that_hold_back_more_than_the_lookahead_are_refused():
    machine = bpe.Transducer(bpe.table(WORDS), counting=False)
    machine.bound = 0
    with pytest.raises(RuntimeError, match="held back"):
        for word in ("tokenization", "international", "thwheast"):
            machine.word(word.encode())


def test_decoding(libraries):
    text = "Hello, wörld 中 \U0001f600!"
    ids = codec().encode(text)
    decoder = bpe_stream.StreamingDecoder(bpe.table(WORDS))
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == libraries[1].decode(ids, skip_special_tokens=False)
    plain = bpe_stream.StreamingDecoder(bpe.table(WORDS), plain=True)
    assert ("".join(plain.feed([i]) for i in ids) + plain.finish()).split() == ["hello", ",", "wörld", "中", "\U0001f600!"]


def test_tables_that_start_anew_change_nothing():
    table = bpe.table(WORDS)
    small, large = bpe.Transducer(table, counting=False, most=20), bpe.Transducer(table, counting=False)
    for word in ("tokenization", "heron", "thwheast", "aaaaaaaa", "straße"):
        assert small.word(word.encode()) == large.word(word.encode())


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, max_size=6), st.integers(1, 9))
def test_chunk_maps_give_what_one_pass_gives(libraries, some, chunk):
    """However short the chunks are, so that words cross many of them and states meet late."""
    want = [len(libraries[0].encode(t, add_special_tokens=False).ids) for t in some]
    assert tokens.counter(BYTES).counts(some, chunk).tolist() == want == tokens.counter(BYTES).counts(some).tolist()


def test_chunks_count_right_from_every_entry_state():
    """A chunk's map against reading the chunk alone from that state."""
    counter, chunk = tokens.counter(BYTES), "'re it's  \n x12 ''s"
    points = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
    kinds, byte = counter.kinds[points], np.arange(len(points) + 1)
    exits, counts, first, final = counter.maps(kinds[None], np.frombuffer(chunk.encode(), np.uint8), byte)
    to, mark = tokens.splitter()
    for s in range(12):
        state, begins = s, []
        for j, k in enumerate(kinds.tolist()):
            m, state = mark[state, k], to[state, k]
            begins += [j - 1] * bool(m & tokens.BEFORE) + [j] * bool(m & tokens.HERE)
        words = [chunk[max(a, 0) : b] for a, b in zip(begins, begins[1:]) if a >= 0]
        if begins and begins[0] >= 0:
            assert (exits[0, s], counts[0, s], first[s], final[s]) == (state, sum(counter.make(words)), begins[0], begins[-1])
        assert exits[0, s] == state


def test_prefix_scan():
    rng = np.random.default_rng(0)
    maps, counts = rng.integers(0, 12, (37, 12)).astype(np.uint8), rng.integers(0, 100, (37, 12))
    exits, sums = tokens.prefix_scan(maps, counts)
    at, total = np.arange(12), np.zeros(12, int)
    for row, n, m, c in zip(exits, sums, maps, counts, strict=True):
        total, at = total + c[at], m[at]
        assert (row == at).all() and (n == total).all()
