"""In how many steps a sweep is done, and what its orders and picks are."""

import itertools

import numpy as np
import pyarrow as pa

from tidebook.llm import pitman_yor, text


def generator(seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(seed))


def test_a_sweep_has_no_idle_steps(monkeypatch):
    """An eighth of a restaurant's dishes may move at once, and does until all customers have."""
    r = generator(1)
    count = r.choice([1, 2, 3, 5, 9, 31, 60], 800, p=[0.2, 0.4, 0.2, 0.1, 0.06, 0.02, 0.02])
    level = pitman_yor.Level(np.zeros(800, np.int64), np.zeros(0, np.int64), count, None, np.full(800, 1e-3), 1.0, 0.5, r)
    level.open(count)
    asked, plain = [], pitman_yor.Level.move
    monkeypatch.setattr(pitman_yor.Level, "move", lambda self, cells, low, guests: asked.append((cells, low, guests)) or plain(self, cells, low, guests))
    level.sweep(turns=8)
    at_once = -(-int((count > 1).sum()) // 8)
    assert max(len(cells) for cells, _, _ in asked) <= at_once
    assert len(asked) == max(31, -(-sum(len(cells) for cells, _, _ in asked) // at_once)) < 40
    # every customer leaves once, one of the two of a dish with two
    seen = sorted((int(c), int(k)) for cells, low, guests in asked for c, a, n in zip(cells, low, guests, strict=True) for k in range(a, a + n))
    assert seen == [(i, k) for i, c in enumerate(count.tolist()) if c > 1 for k in range(c == 2, c)]
    assert all((np.diff(cells) > 0).all() for cells, _, _ in asked)


def test_steps_keep_to_the_turns():
    r = generator(2)
    rest, times = r.integers(0, 40, 3000) ** 2 // 40, r.integers(1, 32, 3000)
    rest[:3] = 99  # of a restaurant with few dishes one moves at a time
    for turns in (1, 4, 16):
        step = pitman_yor.Level.steps(rest, times, turns)
        dish = np.arange(3000).repeat(times)
        assert len(set(zip(step.tolist(), dish.tolist(), strict=True))) == len(step)
        _, at_once = np.unique(np.stack([step, rest[dish]]), axis=1, return_counts=True)
        where = np.unique(np.stack([step, rest[dish]]), axis=1)[1]
        assert (at_once <= -(-np.bincount(rest)[where] // turns)).all()
        longest = max(max(times[rest == k].max(), -(-times[rest == k].sum() // -(-(rest == k).sum() // turns))) for k in set(rest.tolist()))
        assert step.max() + 1 == longest


def test_orders_are_those_of_argsort():
    r = generator(3)
    for n, top in itertools.product((0, 1, 2, 1000, 70_000), (1, 7, 1 << 20, 1 << 62)):
        x, y = r.integers(0, top, n), r.integers(0, 5, n)
        assert (pitman_yor.ordered(x) == np.argsort(x, kind="stable")).all()
        head, group = pitman_yor.distinct(y, x)
        assert list(zip(y[head].tolist(), x[head].tolist(), strict=True)) == sorted(set(zip(y.tolist(), x.tolist(), strict=True)))
        assert (y[head][group] == y).all() and (x[head][group] == x).all()
        assert pitman_yor.rising(x).tolist() == sorted(set(x.tolist()))
    high = r.integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert (pitman_yor.ordered(high) == np.argsort(high, kind="stable")).all()


def test_tables_are_picked_by_their_sizes():
    """Cells of one, two and three tables; one customer of each is away."""
    sizes, d, n = [[4], [1, 5], [3, 1, 2]], 0.6, 40_000
    level = pitman_yor.Level(np.arange(3), np.zeros(0, np.int64), np.array([4, 6, 6]), None, np.full(3, 0.5), 1.0, d, generator(4))
    for k, own in enumerate(sizes):
        level.t[k], level.c[k] = len(own), sum(own)
        level.size[level.start[k] : level.start[k] + len(own)] = own
        level.seat[level.start[k] : level.start[k] + sum(own)] = np.repeat(np.arange(len(own)), own)
    for cell, away, left in ((0, 0, [3]), (1, 3, [1, 4]), (2, 1, [2, 1, 2]), (2, 5, [3, 1, 1])):
        level.size[level.start[cell] : level.start[cell] + len(left)] = left
        cells, ones = np.full(n, cell), np.ones(n, np.int64)
        got = np.bincount(level.pick(cells, away * ones, ones) - level.start[cell], minlength=len(left)) / n
        assert np.abs(got - (np.array(left) - d) / (sum(left) - d * len(left))).max() < 0.015
        level.size[level.start[cell] : level.start[cell] + len(left)] = sizes[cell]


def test_words_are_those_of_the_bytes():
    texts = ["b A  a", None, "", " \t\x0bA\x1c a\r\n", "É é \x85", "x"]
    data, offsets = text.buffer(pa.array(texts, pa.string()))
    for fold in (False, True):
        found = [w.lower() if fold else w for t in texts for w in (t or "").encode().split()]
        which, digests, size = text.distinct_words(data, offsets, fold)
        kinds = list(dict.fromkeys(found))
        assert [kinds[k] for k in which] == found and len(digests) == len(kinds)
        assert size.tolist() == [len((t or "").encode().split()) for t in texts]
