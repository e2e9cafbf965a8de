import random
from collections import defaultdict

import numpy as np

from statforge.llm.packing import packed, place
from tests.llm.test_tokens import reference


def naive(lengths, window):
    """Recomputes the whole sum of squares for every choice."""
    bins, out = [], []
    queue = defaultdict(list)
    for i, n in enumerate(lengths):
        while n >= window:
            out.append((i, len(bins), 0, window))
            bins.append(window)
            n -= window
        if not n:
            continue
        best = None
        for h in sorted({0} | {x for x in bins if x + n <= window}):
            after = sorted(bins + [n]) if h == 0 else sorted(bins)
            if h:
                after.remove(h)
                after.append(h + n)
            levels = defaultdict(int)
            for x in after:
                if x < window:
                    levels[x] += 1
            cost = sum(v * v for v in levels.values())
            if best is None or cost <= best[0]:
                best = cost, h
        h = best[1]
        if h:
            w = queue[h].pop(0)
        else:
            w = len(bins)
            bins.append(0)
        out.append((i, w, bins[w], n))
        bins[w] += n
        if bins[w] < window:
            queue[bins[w]].append(w)
    return out


def test_equals_naive():
    rnd = random.Random(0)
    for window in (1, 2, 7, 20, 50):
        for _ in range(12):
            lengths = [rnd.randint(0, window * 2) if rnd.random() < 0.2 else rnd.randint(0, window) for _ in range(80)]
            got = list(zip(*[x.tolist() for x in place(np.array(lengths, np.int64), window)]))
            assert got == naive(lengths, window)


def test_windows_hold_no_more_and_nothing_is_lost(make):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.choice([0, 1, 30, 300, 5000])) for i in range(500)]
    got = packed(make(rows), window=512, shard_rows=100).collect()
    room = defaultdict(list)
    size = defaultdict(int)
    for r in got:
        room[r.shard, r.window].append((r.begin, r.length))
        size[r.doc_id] += r.length
    _, encoder = reference()
    assert {i: len(encoder.encode_ordinary(t)) for i, t in rows if t} == size
    assert {r.shard for r in got} == set(range(-(-len(size) // 100))) and {r.shard for r in packed(make(rows), shards=2).collect()} == {0, 1}
    for parts in room.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= 512
    assert len(room) <= sum(size.values()) / 512 * 1.05 + 10


def test_copies_of_a_row_spread_over_shards(make):
    got = packed(make([(1, "one and the same text")] * 400), shards=8).collect()
    assert len(got) == 400 and {r.shard for r in got} == set(range(8))


def test_odd_rows(odd, empty):
    rows = packed(odd).collect()
    assert sorted((str(r.doc_id) for r in rows if r.length < 2048)) == sorted(["1", "1", "None", "4", "5", "6", "7", "8", "8"])
    _, encoder = reference()
    assert sum(r.length for r in rows if r.doc_id == 4) == max(len(encoder.encode_ordinary(r.text or "")) for r in odd.collect())
    assert packed(empty).count() == 0
