"""Exact search against all products."""

import math
import random

import numpy as np
import pytest

from quillstack.llm import topk


def plain(rows, k, every, scale=64.0):
    ready = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ready.append((i, [math.floor(scale * x) for x in v]))
    found = []
    for a, (i, q) in enumerate(ready):
        if i % every == 0:
            near = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j) for b, (j, c) in enumerate(ready) if b != a and len(c) == len(q))
            found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(found)


def search(spark, rows, **more):
    table = spark.createDataFrame([(v, i, 1, 2) for i, v in rows], "embedding array<double>, vec_id long, block int, q int")
    return sorted(tuple(r) for r in topk.search(table, **more).collect())


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "GROUP_BYTES", 16000)
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 24))
    rows = [(int(i), (centers[i % 5] * (i % 3) + rng.normal(size=24) * 0.1).round(seed).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 23 + [None]), (320, [float("nan")] * 24), (340, [float("inf")] * 24), (None, rows[0][1])]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (402, [1.0, 2.0]), (420, [5.0]), (500, []), (501, []), (20, rows[20][1]), (40, rows[41][1]), (-20, rows[3][1])]
    assert search(spark, rows, k=4) == plain(rows, 4, 20)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(1, [0.5, 0.5]), (1, [0.9, 0.9]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (20, [-1.0, 0.0])]
    found = search(spark, rows)
    assert found == plain(rows, 20, 20)
    assert max(r[3] for r in found if r[2] == 1) == 7296
    assert sum(r[0] == 20 for r in found) == 3 * 4
    hot = [(40, [float(i), 1.0]) for i in range(300)]
    assert search(spark, hot, k=3) == plain(hot, 3, 20)


def test_far_cells_are_not_met(spark, monkeypatch):
    """Of vectors in clusters, blocks of queries meet few cells but their own, and lose no candidate."""
    monkeypatch.setattr(topk, "GROUP_BYTES", 6000)
    rng = np.random.default_rng(6)
    centers = np.eye(32)[:16] * 9
    rows = [(i, (centers[i % 16] + rng.normal(size=32) * 0.1).round(3).tolist()) for i in range(900)] + [(1000 + i, centers[3].tolist()) for i in range(300)]
    counted = {}
    real = topk.materialize

    def seen(df, label):
        counted[label] = real(df, label)
        return counted[label]

    monkeypatch.setattr(topk, "materialize", seen)
    assert search(spark, rows, k=2) == plain(rows, 2, 20)
    cells = counted["extents"].count()
    blocks = counted["cells"].where("id % 20 = 0").select("cell").distinct().count()
    assert cells > 20 and counted["pairs"].count() < 0.3 * blocks * cells
    assert counted["extents"].agg({"n": "sum"}).first()[0] == 1200


@pytest.mark.parametrize("dense", [0.0, 0.3, 1.0])
def test_ways_to_the_exact_scores_agree(monkeypatch, dense):
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(4)
    c = (rng.normal(size=(30, 16))[np.arange(3000) % 30] * 40 + rng.normal(size=(3000, 16)) * 4).astype(np.int64)
    own = topk.Search(np.arange(40), np.arange(40), c[:40], 7)
    own.meet(np.arange(3000), np.arange(3000), c)
    scores = c[:40] @ c.T
    for i in range(40):
        near = sorted((-int(s), j) for j, s in enumerate(scores[i]) if j != i)[:7]
        assert [(-int(s), int(j)) for s, j in zip(*own.best[i], strict=True)] == near
    assert own.met == 40 * 3000 >= own.survived[0] >= own.survived[1] >= own.survived[-1]
    assert own.survived[0] < 0.6 * own.met
    tiles = topk._tiles(c.astype(float))
    assert sorted(np.concatenate(tiles)) == list(range(3000)) and max(map(len, tiles)) <= topk.TILE


def test_ties_and_few(spark):
    rows = [(i, [1.0, -1.0]) for i in range(0, 60)]
    assert search(spark, rows) == plain(rows, 20, 20)
    assert search(spark, rows[:3]) == plain(rows[:3], 20, 20)
    assert search(spark, []) == []


def test_wide_integers(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(8)]) for i in range(50)]
    assert search(spark, rows, k=5, scale=1024.0) == plain(rows, 5, 20, 1024.0)
    huge = [(i, [3e38, 1.0]) for i in range(3)]
    assert {r[3] for r in search(spark, huge)} == {2**63 - 1}


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 64)) * 50
    c = (centers[np.repeat(np.arange(20), 200)] + rng.normal(size=(4000, 64)) * 3).astype(np.int64)
    q = c[::200] + 1
    for n in (1, 4, 16, 64):
        length, mean, deviation = topk._segments(q.astype(float), n)
        _, m, d = topk._segments(c.astype(float), n)
        assert ((mean * length) @ m.T + deviation @ d.T >= q @ c.T - 1e-6).all()
    own = topk.Search(np.arange(20) - 100, np.arange(20), q, 10)
    for at in range(0, 4000, 500):
        own.add(np.arange(at, at + 500), np.arange(at, at + 500), c[at : at + 500])
    assert own.survived[-1] < 0.6 * 20 * 4000
    assert own.survived[0] >= own.survived[1] >= own.survived[2]
