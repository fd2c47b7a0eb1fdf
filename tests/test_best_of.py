"""The best of a block of questions against a plain sort."""

import numpy as np

from lectern.operators import lsa, vector_search


def test_best_of_equals_sort():
    rng = np.random.default_rng(1)
    for held, width, limit in ((0, 3, 5), (5, 40, 5), (5, 0, 5), (2, 7, 4), (0, 0, 3)):
        score, new = rng.integers(0, 6, (9, held)) / 2.0, rng.integers(0, 6, (9, width)) / 2.0
        names = rng.permutation(width) + 100
        ids = np.argsort(rng.random((9, held)), 1)
        s, i = np.concatenate([score, new], 1), np.concatenate([ids, np.broadcast_to(names, new.shape)], 1)
        order = np.lexsort((i, s), axis=1)[:, :limit]
        got = vector_search._best_of(score, ids, new, names, limit)
        assert np.array_equal(got[0], np.take_along_axis(s, order, 1)) and np.array_equal(got[1], np.take_along_axis(i, order, 1))


def test_blocks_of_rows_are_dense_and_single():
    rng = np.random.default_rng(3)
    columns, a = lsa._block([rng.integers(0, 1 << 14, 60).tolist() for _ in range(lsa.ROWS)], np.ones(1 << 14))
    assert a.dtype == np.float32 and (a > 0).mean() > 0.02
