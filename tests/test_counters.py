"""Counters of joins and duplicate elimination against models that go block by block."""

import math
import random

import pytest

from graniteq.plans import Blocked, dedup_stats, hash_join_stats, merge_join_stats, sort_pass_stats

ROWS = 100


class Window:
    """Blocks of a sorted file, of which some that follow one another are held; counts what is loaded."""

    def __init__(self, keys, size, held):
        self.keys, self.size, self.held = keys, size, min(size, held)
        self.first, self.loaded = 0, self.held

    def at(self, place):
        """The key at a place, or None past the last; makes its block one of those held."""
        block = min(place // ROWS, self.size - 1)
        while block > self.first + self.held - 1:
            self.first += 1
            self.loaded += 1
        return self.keys[place] if place < len(self.keys) else None

    def back_to(self, place):
        block = place // ROWS
        if block < self.first:
            self.loaded += min(self.first - block, self.held)
            self.first = block


def merged(window, stream, size):
    """Pairs, and blocks loaded, of reading the sorted ``stream`` past the window."""
    pairs, at, group, last, place = 0, 0, None, None, 0
    while True:
        if place == len(stream):
            read = min(size, place // ROWS + 1)
            break
        k = stream[place]
        if k == last:
            window.back_to(group)
            at = group
        while (x := window.at(at)) is not None and x < k:
            at += 1
        if x is None:
            read = place // ROWS + 1
            break
        if x == k:
            group, last = at, k
            while window.at(at) == k:
                pairs += 1
                at += 1
        place += 1
    return pairs, window.loaded + read


def sides(seed, blocks, keys, p):
    r = random.Random(seed)
    return [(i // ROWS, r.choice(keys), r.random() < p and i // ROWS % 4 != 1) for i in range(blocks * ROWS)]


def live(rows):
    return sorted(k for _, k, ok in rows if ok)


def blocked(spark, rows):
    return Blocked(spark.createDataFrame(rows, "b long, k long, ok boolean"), "b", "ok", "k")


def sort_of(spark, rows, memory):
    s = sort_pass_stats(spark.createDataFrame(rows, "b long, k long, ok boolean"), "b", "ok", memory)
    blocks = len({b for b, *_ in rows})
    written = sum(len({b for b, *_ in rows if b // memory == run}) for run in {b // memory for b, _, ok in rows if ok})
    return s.nios, (math.ceil(len(live(rows)) / ROWS) if s.nsorted_segs > 1 else written), blocks


CASES = [
    # left and right as (blocks, keys, share that is valid), memory
    ((3, range(50), 1), (9, range(30, 80), 0.9), 8),
    ((9, range(30, 80), 0.9), (3, range(50), 1), 8),
    ((5, range(9), 0.5), (5, range(4, 12), 0.7), 8),
    ((12, range(40), 0.9), (20, range(20, 70), 0.8), 6),
    ((20, range(0, 600, 3), 1), (12, range(0, 600, 2), 1), 6),
    ((14, [1, 2], 1), (13, [2, 3], 1), 5),
    ((14, [7], 0.4), (25, [7], 0.2), 4),
    ((9, [5], 1), (9, range(3), 1), 4),
    ((9, range(5), 0), (9, range(5), 1), 4),
    ((2, range(5), 0), (9, range(5), 1), 6),
    ((0, [1], 1), (9, [1], 1), 4),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_joins_equal_a_walk_through_the_blocks(spark, case):
    *shapes, memory = CASES[case]
    both = [sides(i + case, *x) for i, x in enumerate(shapes)]
    keys = [live(x) for x in both]
    nres = sum(a == b for a in keys[0] for b in keys[1])
    facts = [sort_of(spark, x, memory) for x in both]
    sizes = [f[2] for f in facts]
    merge, hashed = (f(*(blocked(spark, x) for x in both), memory) for f in (merge_join_stats, hash_join_stats))
    if not all(sizes):
        assert (merge.nres, merge.nios) == (hashed.nres, hashed.nios) == (0, 0)
        return
    out = math.ceil(2 * nres / ROWS)
    fits = [s <= memory - 2 for s in sizes]
    if any(fits):
        held = max((0, 1), key=lambda i: (sizes[i], -i)) if all(fits) else fits.index(True)
        nios = facts[1 - held][0] + sizes[held]
        if keys[held] and facts[1 - held][1]:
            pairs, loaded = merged(Window(keys[held], 10**6, 10**6), keys[1 - held], facts[1 - held][1])
            nios += loaded - 10**6 + out
            assert pairs == nres
    else:
        nios = facts[0][0] + facts[1][0]
        if facts[0][1] and facts[1][1]:
            small = 0 if facts[0][1] <= facts[1][1] else 1
            pairs, loaded = merged(Window(keys[small], facts[small][1], memory - 2), keys[1 - small], facts[1 - small][1])
            nios += loaded + out
            assert pairs == nres
    assert (merge.nres, merge.nios) == (nres, nios)
    assert (hashed.nres, hashed.nios) == (nres, sum(sizes) + out if any(fits) else None)


@pytest.mark.parametrize(("blocks", "keys", "p", "memory"), [(3, 40, 0.9, 8), (8, 900, 1, 8), (30, 200, 0.9, 4), (30, 5000, 1, 4), (9, 5, 0, 4), (0, 1, 1, 4), (5, 30, 1, 4)])
def test_dedup_equals_a_model(spark, blocks, keys, p, memory):
    rows = sides(blocks, blocks, range(keys), p)
    unique = len(set(live(rows)))
    s = dedup_stats(blocked(spark, rows), memory)
    assert s.nunique == unique
    if blocks <= memory:
        assert s.nios == blocks + math.ceil(unique / ROWS)
    else:  # the last merge of the sort writes distinct rows only; a single run is read once more
        runs = [[sum(ok for b, _, ok in rows if b == x) for x in range(at, min(at + memory, blocks))] for at in range(0, blocks, memory)]
        full = [r for r in runs if sum(r)]
        nios = blocks + sum(map(len, full))
        if len(full) <= memory - 1:
            nios += sum(math.ceil(sum(r) / ROWS) + (sum(r) % ROWS == 0 and sum(r) // ROWS < len(r)) for r in full)
            assert s.nios == nios + math.ceil(unique / ROWS) * bool(full)
        else:
            sort = sort_pass_stats(spark.createDataFrame(rows, "b long, k long, ok boolean"), "b", "ok", memory)
            assert s.nios == sort.nios - math.ceil(len(live(rows)) / ROWS) + math.ceil(unique / ROWS)


def test_too_little_memory(spark):
    x = blocked(spark, [(0, 1, True)])
    for f in (lambda: dedup_stats(x, 2), lambda: hash_join_stats(x, x, 2), lambda: merge_join_stats(x, x, 2)):
        with pytest.raises(ValueError):
            f()
