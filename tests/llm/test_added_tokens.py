"""Texts that hold an added token of the vocabulary."""

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import tokens
from tessera.llm.queries import vocabulary


def test_added_tokens_are_the_librarys():
    texts = ["alpha <|endoftext|> beta", "plain text", "<|endoftext|>", "x<|endoftext|><|endoftext|>y\n z", "", "<|endoftext| >", "more plain text"]
    library, encoder = Tokenizer.from_file(vocabulary()), tokens.Encoder(vocabulary())
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [26591, 220, 50256, 12159]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == want
