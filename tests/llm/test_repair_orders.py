"""Re-Pair ranks pairs by a packed sort and gathers few places by another: the same results as numpy's own functions."""

import numpy as np

from vitrine.llm import token_output


def test_pairs_are_ranked_like_unique():
    rng = np.random.default_rng(4)
    for top, bits in ((3, 2), (60, 17), (1 << 31, 32)):  # the last one does not fit into one number
        pair = rng.integers(0, top, 700) << 32 | rng.integers(0, top, 700)
        for mine, want in zip(token_output._ranked(pair, bits), np.unique(pair, return_inverse=True, return_counts=True)):
            assert np.array_equal(mine, want)


def test_few_places_are_looked_at_again(monkeypatch):
    rng = np.random.default_rng(5)
    for k in (1, 50, 3000):
        ids, last = rng.integers(0, 9, k).astype(np.uint32), rng.random(k) < 0.05
        last[-1] = True
        got = []
        for few in (1, 1 << 30):  # always, never
            monkeypatch.setattr(token_output, "_FEW", few)
            got.append(token_output.repair(ids, last, 9))
        assert all(np.array_equal(x, y) for x, y in zip(*got))
