"""The ids that packing takes from the library, run by run or part by part, against those of whole texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing
from quern.llm.common import package_path

WORDS = package_path("word_bpe_49k.json")
BITS = ["'", "'S", "s", "t", "re", "ve", "ll", "d", "m", "r", "v", "l", "e", " ", "\n", "\t", "\v", "\x1c", "\0", "a", "B", "J", "\u030c", "é", "É", "1", "23", "٣", "!", "=", "\u0338", "_", "<", "<|", "<|endoftext|>",
        "<|ENDOFTEXT|>", "\u3000", "\x85", "中", "\U0001f600", "\u0301", "Σ", "İ", "I", "\u0307", "\u0308", "\u212a", "\u1fef", "가", "ᄀ", "ᅡ", "H", "\u0331", "the", "Heron", "’"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def ids(made: list[bytes]) -> list[list[int]]:
    return [np.frombuffer(x, "<u4").tolist() for x in made]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BITS), max_size=25).map("".join), max_size=4))
def test_ids_of_parts_are_those_of_whole_texts(library, texts):
    assert ids(packing.ids_of(WORDS).texts(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_around_every_ascii_character(library):
    every = [chr(c) for c in range(128)]
    texts = [x.join(every) + y for x in ("", "a", "A", "1", "!", "'", "<", "\u0338", "\u030c", "é") for y in ("", "'s")]
    texts += [f"q{x}{y}z" for x in every for y in every] + [None, "", " "]
    assert ids(packing.ids_of(WORDS).texts(texts)) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_word_goes_to_the_library_once(library):
    """However it is capitalised and whatever marks stand around it."""
    codec, sent = packing.LibraryIds(WORDS), []
    make = codec.make
    codec.make = lambda runs: sent.extend(runs) or make(runs)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["heron", "Heron", "HERON"]) + rng.choice(["", ",", ".", "!", "1"]) for _ in range(50)) for _ in range(4)]
    assert ids(codec.texts(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(sent) == ["!", ",", ".", "1", "heron"]


def test_other_rules_keep_runs_whole(tmp_path, library):
    """A tokenizer that keeps capitals gets runs as they are."""
    from tokenizers import normalizers, pre_tokenizers

    other = Tokenizer.from_file(WORDS)
    other.normalizer = normalizers.NFC()
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    texts = ["Heron, heron. it's 12", "A1 a1"]
    assert ids(packing.LibraryIds(str(tmp_path / "other.json")).texts(texts)) == [other.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids(packing.LibraryIds(WORDS).texts(texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]
