"""Blocks of one to six words in all."""

import numpy as np
import pytest

from tessera.llm import jaccard_join, shingles


@pytest.mark.parametrize("texts", [["a"], ["a b"], ["hello world", ""], ["a b c"], ["a", "b"], ["a b c d"], ["a b c d e"], ["a b", "c d e"], ["a b c d e f"], [""]])
def test_grams_of_few_words(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    tokens, first = shingles.grams(shingles.words(data, offs))
    want = [0 if not t else max(1, len(t.split()) - 4) for t in texts]
    assert np.diff(first).tolist() == want and len(tokens) == sum(want)


def test_table_of_one_short_text(spark):
    for text in ("hello world", "one two three"):
        df = spark.createDataFrame([(7, text)], "doc_id long, text string")
        assert [tuple(r) for r in jaccard_join.jaccard_components(df).collect()] == [(7, 1, 7)]
