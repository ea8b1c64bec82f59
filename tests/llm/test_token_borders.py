"""Cuts at word borders give the library's ids, whatever stands at them."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokens
from tessera.llm.queries import vocabulary

PARTS = ["a", "b", "re", "s", "'", "'s", "'re", "''", " ", "  ", "\n", "\t", "\r\n", ".", ",", "--", "1", "23", "é", "×", "÷", "ß", "ɏ", "я", "中", " ", "　", " ", "“", "…", "😀", "́", "\x00", "\x1c", "\x85", "᠎", "​", "<|endoftext|>", "١", "_", "`", " '", " 1", "﻿", "ǅ", "\x7f"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(library, seed, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40_000)  # generations come and go
    monkeypatch.setattr(tokens, "BLOCK", 300)
    pick, encoder = random.Random(seed), tokens.Encoder(vocabulary())
    for _ in range(60):
        texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14))) for _ in range(pick.choice([1, 2, 40]))]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == want


def test_long_and_empty_texts(library):
    encoder = tokens.Encoder(vocabulary())
    texts = ["", "", "word, " * 50_000 + "я" * 3000 + "\n\n x" * 2000, "", "z" * 20_000, ""]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == want
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]
