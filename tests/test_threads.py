"""Threads against a plain walk, circles and missing parents included."""

import numpy as np
import pytest

from hybridmail.operators import threads

SCHEMA = "message_id string, reply_to string, references array<string>, seq long"


def brute(rows):
    links = {}
    for m, reply, refs, seq in rows:
        if not m:
            continue
        named = [x for x in refs or [] if x]
        chain = [*named, *([reply] if reply and reply not in named else []), m]
        for parent, child in zip(chain, chain[1:]):
            if parent != child:
                links.setdefault(child, []).append((child != m, seq, parent))
    up = {c: min(x)[2] for c, x in links.items()}
    for start in sorted(set(up) | set(up.values())):  # each circle loses its smallest id's link
        seen, at = [], start
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        if at in seen:
            del up[min(seen[seen.index(at) :])]
    out = {}
    for m in {r[0] for r in rows if r[0]}:
        depth, at = 0, m
        while at in up:
            depth, at = depth + 1, up[at]
        out[m] = (up.get(m), at, depth)
    sizes = {}
    for _, root, _ in out.values():
        sizes[root] = sizes.get(root, 0) + 1
    return {(m, p, r, d, sizes[r]) for m, (p, r, d) in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_random_threads(spark, seed):
    r = np.random.RandomState(seed)
    ids = [f"m{i:02d}" for i in range(40)]
    pick = lambda: ids[r.randint(40)] if r.rand() < 0.9 else None
    rows = [(pick(), pick() if r.rand() < 0.5 else None, [pick() for _ in range(r.randint(0, 3))] or None, i) for i in range(40)]
    assert {tuple(x) for x in threads.threads(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_odd_threads(spark):
    deep = [(f"d{i:03d}", f"d{i - 1:03d}" if i else None, None, i) for i in range(70)]
    rows = [*deep, ("a", "b", None, 1), ("b", "c", [], 2), ("c", "a", None, 3), ("t", "a", None, 4), ("s", "s", None, 5), ("x", None, ["gone", "", None], 6), ("y", "gone", None, 7), ("", "x", None, 8), (None, "x", None, 9), ("x", None, None, 10)]
    got = {tuple(x) for x in threads.threads(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert ("d069", "d068", "d000", 69, 70) in got and ("a", None, "a", 0, 4) in got and {("x", "gone", "gone", 1, 2), ("y", "gone", "gone", 1, 2)} <= got
    assert threads.threads(spark.createDataFrame([], SCHEMA)).count() == 0
