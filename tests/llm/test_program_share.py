"""The linear program packs most of the pieces; best fit gets what is left, and all pieces only where that takes fewer sequences."""

import numpy as np

from frostline.llm import packing


def test_program_packs_most_pieces():
    sizes = np.arange(1, 256)
    demand = np.maximum(1, (300 * np.exp(-np.log(sizes / 60) ** 2)).astype(int))
    left = demand.copy()
    for used, n in packing.solve(sizes, demand, 256):
        assert n >= 1 and sum(int(sizes[k]) * each for k, each in used.items()) == 256
        for k, each in used.items():
            left[k] -= n * each
    assert left.min() >= 0 and left.sum() <= 0.2 * demand.sum()


def test_never_more_sequences_than_best_fit():
    rng = np.random.default_rng(3)
    for sizes in (np.arange(1, 200), np.arange(60, 110)):
        demand = rng.integers(1, 8, len(sizes))
        plan = packing.plan(dict(zip(sizes.tolist(), demand.tolist())), 200)
        assert plan["sequences"] <= sum(n for _, n in packing.best_fit(sizes, demand, 200))
