"""Sets of one shingle, however frequent, and blocks of few words."""

import numpy as np

from tessera.llm import jaccard_join

SCHEMA = "doc_id long, text string"


def test_equal_sets_of_one_frequent_shingle_meet():
    for byte in (2, 31, 32, 127, 254, 255):
        one = np.array([12345 | byte << 56], np.uint64)
        assert len(jaccard_join.signatures(1, one, 75))


def test_many_texts_of_one_repeated_word_link(spark):
    rows = [(i, " ".join(["buy"] * (6 + i))) for i in range(40)] + [(100, "quite another text of seven words")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (1, 0) for i in range(40)} | {100: (2, 100)}
