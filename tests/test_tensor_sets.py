"""The energy distance of large sets never holds all their differences at once."""

import tracemalloc

import numpy as np

from scarp.functions.metrics import tensor_distance


def test_large_sets_take_little_memory_and_give_the_same_distance():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(1300, 64)), rng.normal(size=(700, 64)) + 0.1
    gap = lambda a, b: np.mean([np.sqrt(np.sqrt(((r - b) ** 2).sum(axis=1))).mean() for r in a])
    want = np.sqrt(2 * gap(x, y) - gap(x, x) - gap(y, y))
    tracemalloc.start()
    got = tensor_distance(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(got - want) < 1e-9 and most < 60e6  # 870 MB of differences before
