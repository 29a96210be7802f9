"""Embedding near-dedup against all pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridmail.llm import embeddups

VECTORS = "vec_id long, embedding array<double>, label int"


def unit(v):
    v = np.array(v, dtype="f8")
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def brute(rows, least=0.98):
    """Rows as a Counter of (vec_id, n_links, component_id, kept)."""
    fit = [(i, tuple(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    nodes = list(dict.fromkeys(fit))
    u = [unit(v) for _, v, _ in nodes]
    parent = {i: i for i, _, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for a in range(len(nodes)):
        for b in range(a):
            if nodes[a][2] == nodes[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= least:
                links[nodes[a]] += 1
                links[nodes[b]] += 1
                x, y = sorted((root(nodes[a][0]), root(nodes[b][0])))
                parent[y] = x
    out = Counter()
    for i, v, lab in rows:
        c = None if i is None else root(i)
        out[i, links[i, tuple(v or ()), lab], c, i is None or i == c] += 1
    return out


def groups(r, n, d, labels, spread=0.05):
    """Vectors around shared middles, at many distances."""
    middles = r.randn(max(2, n // 8), d)
    x = middles[r.randint(0, len(middles), n)]
    x = x / np.linalg.norm(x, axis=1)[:, None]
    x = x + r.randn(n, d) * (r.rand(n) ** 2 * spread)[:, None]
    return [(int(i), x[i].tolist(), int(labels[i])) for i in range(n)]


@pytest.mark.parametrize("tile,d", [(1024, 24), (16, 24), (7, 3)])
def test_groups(spark, monkeypatch, tile, d):
    monkeypatch.setattr(embeddups, "TILE", tile)
    r = np.random.RandomState(d + tile)
    rows = groups(r, 400, d, np.where(r.rand(400) < 0.6, 0, r.randint(1, 5, 400)))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(30)] + [(2000 + i, [x * 3 for x in rows[5][1]], rows[5][2]) for i in range(4)]
    df = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], VECTORS).withColumns({k: F.lit(1) for k in ("id", "v", "key", "tile", "node", "n", "space", "bin", "x.y")})
    assert Counter(map(tuple, embeddups.find(df).collect())) == brute(rows)
    assert embeddups.dedup(df).columns == df.columns
    assert {x["vec_id"] for x in embeddups.dedup(df).collect()} == {i for i, _, _, kept in brute(rows) if kept}


def test_odd_vectors(spark):
    v, w = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]
    rows = [(5, v, 1), (3, w, 1), (9, v, 2), (10, v, None), (11, None, 1), (12, [], 1), (13, [0.0, 0.0, 0.0], 1), (14, [1.0, None, 0.0], 1), (15, [float("nan"), 1.0, 0.0], 1), (16, [float("inf"), 0.0, 0.0], 1)]
    rows += [(None, v, 1), (5, v, 1), (20, [1.0, 0.0], 1), (21, [1.0, 1e-9], 1), (22, [1e200, 1e198, 0.0], 1), (23, [1e-200, 0.0, 0.0], 1), (30, v, 3), (30, [0.0, 1.0, 0.0], 3), (31, [0.0, 1.0, 0.001], 3), (32, [1.0, 0.0, 0.002], 3), (33, [5.0], 1), (34, [-5.0], 1), (35, [7.0], 1)]
    assert Counter(map(tuple, embeddups.find(spark.createDataFrame(rows, VECTORS)).collect())) == brute(rows)
    assert embeddups.find(spark.createDataFrame([], VECTORS)).count() == 0
    assert Counter(map(tuple, embeddups.find(spark.createDataFrame([(1, None, 1), (2, v, None)], VECTORS)).collect())) == Counter([(1, 0, 1, True), (2, 0, 2, True)])
    with pytest.raises(TypeError, match="integers"):
        embeddups.find(spark.createDataFrame([("a", v, 1)], "vec_id string, embedding array<double>, label int"))


@pytest.mark.parametrize("least", [0.5, 0.9, 0.98, 0.9999])
def test_bounds_lose_no_pair(least):
    r = np.random.RandomState(int(least * 100))
    x = embeddups.units(np.array([v for _, v, _ in groups(r, 300, 40, np.zeros(300), 0.3)]))
    turned, _ = embeddups.basis(x[:50])
    assert abs(turned.T @ turned - np.eye(40)).max() < 1e-12
    got = {pair for p, q in embeddups.near_pairs(x, x, turned, least, True) for pair in zip(p.tolist(), q.tolist(), strict=True)}
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True)}
    p, q = (np.array(s) for s in zip(*got, strict=True)) if got else (np.zeros(0, int), np.zeros(0, int))
    first = embeddups.first_of_group(len(x), p, q)
    assert all(first[i] == first[j] for i, j in got) and (first <= np.arange(len(x))).all()


def test_a_bin_larger_than_a_tile(spark, monkeypatch):
    """Many vectors at one place of the axis: dealt over several tiles, all of which meet."""
    monkeypatch.setattr(embeddups, "TILE", 8)
    rows = [(i, [1.0, i * 1e-7, 0.3], 1) for i in range(100)] + [(200 + i, [1.0, 50.0 + i, 0.0], 1) for i in range(5)]
    assert Counter(map(tuple, embeddups.find(spark.createDataFrame(rows, VECTORS)).collect())) == brute(rows)
