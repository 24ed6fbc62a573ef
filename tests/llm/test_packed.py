"""Sorted hashes come back as they were, in fewer bytes."""

import numpy as np
import pytest

from frostline.llm.language_model import packed, unpacked


@pytest.mark.parametrize("keys", [[0], [2**64 - 1], [0, 1, 2**63, 2**64 - 1], list(range(1000))])
def test_round_trip_of_few(keys):
    keys = np.array(keys, np.uint64)
    assert (unpacked(packed(keys), len(keys)) == keys).all()


def test_round_trip_and_size():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 300_000, np.uint64))
    raw = packed(keys[1000:])
    assert (unpacked(raw, len(keys) - 1000) == keys[1000:]).all() and len(raw) < 6.2 * len(keys)
