"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from quillstack.llm import negatives
from quillstack.llm.common import packed as as_bytes

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def plain(rows, every=10, scale=256.0, relabel=7, positives=5, k=5):
    own = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, [math.floor(scale * np.float64(x)) for x in v], (label + 1) % 10 if relabel and i % relabel == 0 else label))
    found = []
    for a, (i, q, label) in enumerate(own):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j, other) for b, (j, c, other) in enumerate(own) if b != a and len(c) == len(q))
        for p, pid in [(-s, j) for s, j, other in scored if other == label][:positives]:
            hard = [(j, -s) for s, j, other in scored if other != label and 80 * p <= -100 * s <= 100 * p]
            found += [(i, pid, n + 1, j, p, s) for n, (j, s) in enumerate(hard[:k])]
    return sorted(found)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1.0) for i, v, label in rows], "vec_id long, embedding array<float>, label int, row string, score double").repartition(3)


def vectors(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, clusters), dim))
    x = rng.normal(size=(n, dim)) * (0.3 if clusters else 1) + (centers[rng.integers(0, len(centers), n)] if clusters else 0)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


@pytest.mark.parametrize("clusters", [0, 4])
def test_all_pairs(spark, clusters):
    rng = random.Random(clusters)
    rows = [(i, v, rng.randrange(4)) for i, v in enumerate(vectors(400, 16, clusters, clusters))]
    found = negatives.mine(table(spark, rows), every=10)
    assert found.columns == COLUMNS
    told = plain(rows)
    assert told and sorted(map(tuple, found.collect())) == told


def test_nulls_ties_repeats_and_dimensions(spark):
    base = vectors(60, 8, 9)
    rows = [(i, v, i % 3) for i, v in enumerate(base)]
    rows += [(i, base[i % 7], i % 2) for i in range(60, 200)]  # many equal vectors, so ties by id
    rows += [(0, base[5], 0), (0, base[5], 0), (10, base[6], 1)]  # repeated ids
    rows += [(300, None, 1), (310, [float("nan")] * 8, 1), (320, [float("inf")] + [0.0] * 7, 1), (330, base[0], None), (None, base[0], 1), (340, [None] + base[0][1:], 1)]
    rows += [(400 + i, base[i][:3], i % 2) for i in range(30)] + [(500, [], 1), (501, [], 1), (510, [], 0), (600, [1.0] * 5, 1)]
    found = negatives.mine(table(spark, rows), every=10)
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 7)).astype(np.float32).tolist(), int(i % 2)) for i in range(120)]
    found = negatives.mine(table(spark, rows), every=10, relabel=None)
    assert sorted(map(tuple, found.collect())) == plain(rows, relabel=None)


def test_many_groups_give_the_same(spark, monkeypatch):
    """Groups of a few rows, and nine rows in ten of one label."""
    rows = [(i, v, 0 if i % 10 else i // 10 % 3) for i, v in enumerate(vectors(500, 12, 2, 3))]
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 12 * 8 * 10)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 12 * 8 * 60)
    found = negatives.mine(table(spark, rows), every=10)
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_first_parts_tell_the_others(spark, monkeypatch):
    """What leaves a group is near what is asked for, not k rows for each anchor, positive and part."""
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(3000, 12, 5))]
    monkeypatch.setattr(negatives, "GROUP_BYTES", 12 * 8 * 30)
    monkeypatch.setattr(negatives, "EARLY", 8)
    left = []
    real = negatives.materialize

    def seen(df, label):
        found = real(df, label)
        if label == "early":
            left.append(found.count())
        return found

    monkeypatch.setattr(negatives, "materialize", seen)
    found = negatives.mine(table(spark, rows), every=100)
    assert sorted(map(tuple, found.collect())) == plain(rows, every=100) and len(left) == 1 and left[0] <= 30 * 25


def test_pairs_go_early():
    """Of clustered vectors, most pairs are gone before the last level, and none that belongs."""
    x = np.array(vectors(3000, 32, 7, 6))
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    packed = [as_bytes(r) for r in q]
    axes = np.linalg.eigh(q.T.astype(float) @ q)[1][:, ::-1]
    a, b = negatives.Rotated(packed[:100], 32, axes), negatives.Rotated(packed, 32, axes)
    scores = q[:100] @ q.T
    low = np.sort(scores, axis=1)[:, -10].astype(float)
    i, j = negatives.survivors(a, np.arange(100), b, np.arange(3000), low, np.full(100, np.inf))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) >= set(zip(*(t.tolist() for t in np.nonzero(scores >= low[:, None])), strict=True))
    assert len(i) < 0.02 * scores.size
    first = negatives.Rotated.__new__(negatives.Rotated)
    first.__dict__ = a.__dict__ | {"cuts": a.cuts[:1], "dim": a.cuts[0]}
    part = a.r[:, : a.cuts[0]] @ b.r[:, : a.cuts[0]].T + a.rest[0][:, None] * b.rest[0]
    assert (part >= low[:, None]).mean() < 0.5


def test_empty(spark):
    assert negatives.mine(table(spark, [(None, None, None)]).limit(0)).count() == 0
    assert negatives.mine(table(spark, [(1, [1.0], 1)])).count() == 0
    assert negatives.mine(table(spark, [(100, [1.0], 1), (5, [0.5], 1)])).count() == 0
