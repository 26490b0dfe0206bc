"""What the sampler's bookkeeping costs."""

import time

import numpy as np

from tidebook.llm import pitman_yor


def seconds(run) -> float:
    taken = []
    for _ in range(7):
        began = time.process_time()
        for _ in range(20):
            run()
        taken.append(time.process_time() - began)
    return min(taken)


def test_sizes_are_counted_in_their_own_type():
    """Counting customers at tables costs about what the plain sum in the sizes' type does; of another type it costs 20 times that."""
    rest = np.arange(1000)
    level = pitman_yor.Level(rest, np.zeros(0, np.int64), np.full(1000, 50), None, np.full(1000, 0.5), 1.0, 0.5, np.random.Generator(np.random.PCG64(1)))
    tables = np.random.Generator(np.random.PCG64(2)).integers(0, 50_000, 20_000)
    plain, ones = level.size.copy(), np.ones(len(tables), np.int32)
    counted = seconds(lambda: level.count(tables, 1, 0))
    assert counted < 5 * seconds(lambda: np.add.at(plain, tables, ones))
    assert (level.size == plain).all() and level.size.dtype == np.int32


def test_shares_of_all_cells_are_those_of_each():
    r = np.random.Generator(np.random.PCG64(3))
    triples = sorted({(int(r.integers(2, 6)), int(r.integers(2, 40)), int(r.integers(0, 9))) for _ in range(400)})
    v, w, u = (np.array(x, np.int64) for x in zip(*triples, strict=True))
    word = np.unique(w)
    m = pitman_yor.Model(v, w, u, r.integers(0, 5, len(v)), word, np.full(len(word), 1 / (len(word) + 1)), 1.0, r)
    m.leaves.open(m.count)
    m.leaves.sweep()
    assert (m.leaves.shares() == m.leaves.share(np.arange(len(v)))).all()
    first, many = pitman_yor.counted(np.array([1, 1, 4, 6, 6, 6]))
    assert first.tolist() == [0, 2, 3] and many.tolist() == [2, 1, 3] and len(pitman_yor.counted(word[:0])[0]) == 0
