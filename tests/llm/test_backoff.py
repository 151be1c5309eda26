"""Stupid backoff against counting in dictionaries."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillstack.llm import backoff


def plain(texts, order, alpha):
    """For each text: its score by the counts of all others."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    totals = [sum((grams(w, n + 1) for w in words), Counter()) for n in range(order)]
    found = []
    for w in words:
        own = [grams(w, n + 1) for n in range(order)]
        left = lambda g: totals[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        rest = sum(map(len, words)) - len(w)

        def score(g):
            if len(g) == 1:
                return math.log(left(g) / rest) if left(g) else -math.log(rest + 1)  # noqa: B023
            return math.log(left(g) / left(g[:-1])) if left(g) else math.log(alpha) + score(g[1:])  # noqa: B023

        found.append((len(w), sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))))
    return found


@pytest.mark.parametrize("order", [1, 2, 3])
def test_score(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choices(["the", "The", "cat", "É", "é", "sat", "on", "a\u0085b", "x" * 50], k=rng.choice([1, 2, 30, 300]))) for _ in range(40)]
    texts += [None, "", " \t", "unique words nobody has", texts[0], texts[0]]
    rows = [(t, i if i != 5 else None, 1, "g") for i, t in enumerate(texts)] + [(texts[7], 7, 1, "g")]
    found = backoff.score(spark.createDataFrame(rows, "text string, doc_id long, batch int, grams string"), backoff.Settings(order=order, batch_bytes=2000, part_grams=300)).collect()
    expected = plain([t for t, *_ in rows], order, 0.4)
    told = sorted((str(i), n, round(s, 6)) for (_, i, *_), (n, s) in zip(rows, expected, strict=True))
    assert sorted((str(r["doc_id"]), r["n_tokens"], round(r["log_score"], 6)) for r in found) == told
    for r in found:
        assert r["mean_log_score"] == (pytest.approx(r["log_score"] / r["n_tokens"]) if r["n_tokens"] else None)


def test_very_long_texts(spark):
    """A text of hundreds of thousands of words, and one of a single word of a million characters, are scored whole."""
    rng = random.Random(7)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=250_000)), "x" * 1_000_000, "w1 w2 w3", "w1 w2 " * 40, "x" * 1_000_000 + " w1"]
    found = backoff.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), backoff.Settings(batch_bytes=100_000)).collect()
    told = plain(texts, 2, 0.4)
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: n for i, (n, _) in enumerate(told)}
    assert all(r["log_score"] == pytest.approx(told[r["doc_id"]][1], abs=1e-6, rel=1e-9) for r in found)


def test_equal_rows_are_dealt_to_all_batches(spark, monkeypatch):
    """Nine of ten rows are equal: no group holds more than its share of them."""
    rows = [(1, "the same words again and again")] * 1800 + [(i, f"other words {i}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = []
    plan = type(table).groupBy

    def grouped(self, *keys):
        if keys == ("batch",) and "text" in self.columns:
            dealt.append(max(r["count"] for r in plan(self, "batch").count().collect()))
        return plan(self, *keys)

    monkeypatch.setattr(type(table), "groupBy", grouped)
    found = backoff.score(table, backoff.Settings(batch_bytes=2000)).collect()
    assert dealt and max(dealt) < 200
    assert len(found) == 2000 and len({round(r["log_score"], 6) for r in found if r["doc_id"] == 1 and r["n_tokens"] == 6}) == 1


def test_one_or_no_document(spark):
    kinds = "doc_id long, text string"
    assert backoff.score(spark.createDataFrame([], kinds)).count() == 0
    row = backoff.score(spark.createDataFrame([(1, "alone here")], kinds)).first()
    assert row["log_score"] == pytest.approx(math.log(0.4))  # nothing else has a word


def test_arrays_come_back():
    grams = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (backoff.unpacked(backoff.packed(grams)) == grams).all()
    assert len(backoff.unpacked(backoff.packed(grams[:0]))) == 0
    parts = backoff.part_of(grams, 7)
    assert (np.diff(parts) >= 0).all() and set(parts) == set(range(7))
