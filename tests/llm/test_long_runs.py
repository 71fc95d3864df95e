"""Texts with runs just under any bound, and texts of special strings: ids, time and what an edit encodes again."""

import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ferrule.llm import tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("unit", ["\n", " ", "\u3000", "a", "=", "ab", "漢"])
@pytest.mark.parametrize("run", [99, 100, 999, 19_999])
def test_runs_at_the_usual_speed(library, unit, run):
    encoder, text = tokens.Encoder(), (unit * run + "word's é. ") * (1 + 100_000 // (run * len(unit)))
    encoder.ids("<|endoftext|>")  # loads the vocabulary
    began = time.time()
    got = encoder.ids(text)
    assert time.time() - began < 5 and got == library.encode(text, add_special_tokens=False).ids


def test_edits_among_special_strings(library):
    encoder, rnd, special = tokens.Encoder(), random.Random(6), "<|endoftext|>"
    for text in (special * 2000, (special + "x" * 700) * 20, ("some words " + special) * 500):
        tree = tokens.TokenTree(text, encoder)
        for _ in range(25):
            at, drop, put = rnd.randrange(len(text)), rnd.choice((0, 1, 9)), rnd.choice(("", "<|", "of|>", special, "a b"))
            before = tree.encoded_chars
            tree.edit(at, drop, put)
            text = text[:at] + put + text[at + drop :]
            assert tree.encoded_chars - before < 3000
            assert tree.text == text and tree.total == len(library.encode(text, add_special_tokens=False).ids)
