"""Popcounts of languages against a plain count, with tables as narrow as the languages allow."""

import numpy as np
import pytest

from sievespark.llm.language_id import Filters, slots


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_counts_are_those_of_each_language(n):
    r = np.random.default_rng(n)
    grams = {f"l{i:02}": r.integers(0, 2**32, 300, dtype=np.uint64) for i in range(n)}
    made, asked = Filters(grams, None), np.concatenate([r.integers(0, 2**32, 500, dtype=np.uint64), *[g[:20] for g in grams.values()]])
    for k, got in zip(sorted(grams), made.counts(asked)):
        held = [set(s.tolist()) for s in slots(grams[k])]
        every = set().union(*held)
        assert got == sum(all(int(s) in every for s in at) for at in zip(*slots(asked)))
    assert made.table.itemsize == (1 if n <= 8 else 8)
