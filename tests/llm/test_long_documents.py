"""Budgets of sources with few, or only very long, documents."""

import itertools

import numpy as np
import pytest

from tessera.llm import mixing


@pytest.mark.parametrize(("counts", "budget"), [({60_000: 1, 50_000: 3}, 150_000), ({70_000: 2, 50_000: 3}, 150_000), ({70_000: 2, 50_000: 3}, 140_000), ({2_000_000: 2, 1_500_001: 3}, 4_500_003)])
def test_long_documents_fill_the_budget(counts, budget):
    assert sum(s * n for s, n in mixing.fit(counts, budget).items()) == budget


def test_few_long_documents_fit_as_well_as_any_choice():
    rng = np.random.default_rng(6)
    for _ in range(40):
        counts = {int(s): int(rng.integers(1, 4)) for s in rng.integers(15_000, 120_000, 4)}
        budget = int(rng.integers(1, sum(s * n for s, n in counts.items())))
        sums = [sum(s * n for s, n in zip(counts, pick, strict=True)) for pick in itertools.product(*(range(n + 1) for n in counts.values()))]
        took = mixing.fit(counts, budget)
        assert all(0 <= n <= counts[s] for s, n in took.items())
        assert sum(s * n for s, n in took.items()) == max(x for x in sums if x <= budget)
