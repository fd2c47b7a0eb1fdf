"""What a task that looks for the nearest lists holds."""

import tracemalloc

import numpy as np

from lectern.operators import ann
from lectern.operators.vectors import unit


def test_nearest_lists_are_found_in_bounded_memory():
    rng = np.random.default_rng(2)
    x, centres = unit(rng.normal(size=(6000, 8))), unit(rng.normal(size=(3000, 8))).astype(np.float32)
    want = np.argsort(-(x[:50] @ centres.T.astype(np.float64)), 1, kind="stable")
    tracemalloc.start()
    one, some = ann._nearest(x, centres, 1), ann._nearest(x, centres, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All products at once would be 144 MB.
    assert peak < 6 * 8 * ann.CELLS and np.array_equal(one[:50], want[:, :1]) and np.array_equal(some[:50], want[:, :5])
