"""Nearest terms by blocks: the same as all pairs give, and no pair of terms is sent."""

import math
import random
from collections import defaultdict

import pytest

from quillstack.operators import synonyms


def told(rows, k, most):
    by, norm = defaultdict(list), defaultdict(float)
    for t, c, w in rows:
        by[c].append((t, w))
        norm[t] += w * w
    dots = defaultdict(int)
    for own in by.values():
        for t, w in own if 2 <= len(own) <= most else []:
            for s, v in own:
                if s != t:
                    dots[t, s] += w * v
    near = defaultdict(list)
    for (t, s), d in dots.items():
        near[t].append((-math.floor(d / math.sqrt(norm[t] * norm[s]) * 1_000_000 + 0.5), s))
    return sorted((t, s, r + 1, -x) for t, own in near.items() for r, (x, s) in enumerate(sorted(own)[:k]))


@pytest.mark.parametrize(("blocks", "most_pairs", "k"), [(1, 10, 2), (3, 1, 1), (4, 1 << 20, 3), (None, 7, 2)])
def test_blocks_are_all_pairs(spark, monkeypatch, blocks, most_pairs, k):
    monkeypatch.setattr(synonyms, "MOST_PAIRS", most_pairs)
    rng = random.Random(4)
    rows = [(f"t{t}", f"c{c}", rng.choice([1, 2, 5_000_000])) for t in range(60) for c in rng.sample(range(25), rng.randrange(1, 6))] + [("é", "c1", 3), ("alone", "own", 9)]
    rows += [(f"u{t}", "often", 1) for t in range(40)]
    weighed = spark.createDataFrame(rows, "term string, context string, weight long")
    assert sorted(tuple(r) for r in synonyms.nearest(weighed, k, 30, blocks).collect()) == told(rows, k, 30)
    assert synonyms.nearest(weighed.where("false")).count() == 0


def test_no_pair_of_terms_is_sent(spark):
    rows = spark.createDataFrame([(f"t{t}", "c", 1 + t) for t in range(50)], "term string, context string, weight long")
    plan = synonyms.nearest(rows, blocks=2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and not any("synonym" in x for x in plan.splitlines() if "Aggregate" in x or "Exchange" in x and "other" not in x)


def test_blocks_bound_a_group():
    """Two blocks have BLOCK entries at most, about; few entries are one group, and more come to all cores."""
    assert synonyms._blocks(0, 12) == synonyms._blocks(1000, 12) == 1 and synonyms._blocks(10**6, 12) == 7
    for n in (10**7, 10**8, 10**9):
        assert 2 * n <= synonyms._blocks(n, 12) * synonyms.BLOCK
