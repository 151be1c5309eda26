"""Importance resampling: models, thresholds and top-k against brute force, accuracy on held-out labels."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstack.llm import importance
from quillstack.llm.common import lowest

DATA = "/root/testdata/sf0.01"


def test_features_are_tokens_and_pairs():
    buckets = 1 << 14
    one = lambda t: importance.features(t, buckets)[0]
    found = importance.features("Ab, ab Ab Ab", buckets)
    assert len(found) == 5 + 4
    assert found[0] == one("Ab") and found[1] == one(",") and found[2] == one("ab")
    assert found[-1] == 1  # a pair of equal tokens
    assert len(importance.features(None, buckets)) == len(importance.features(" \n\t", buckets)) == 0


def test_log_ratio():
    raw, target = np.array([100.0, 100.0, 0.0]), np.array([90.0, 0.0, 0.0])
    found = importance.log_ratio(raw, target, 0.01)
    assert found[0] > 0.5 > -2 > found[1] and abs(found[2]) < 10
    assert (importance.log_ratio(raw, 0 * target, 1.0) == 0).all()


@pytest.mark.parametrize("seed", range(20))
def test_threshold_is_the_best(seed):
    rng = random.Random(seed)
    weights = np.array([rng.choice([rng.gauss(0, 1), 0.5, float("-inf")]) for _ in range(30)])
    good = np.array([rng.random() < 0.5 for _ in weights])
    at = importance.threshold(weights, good)
    if not good.any() or good.all():
        assert at == 0
        return
    value = lambda t: (weights[good] >= t).mean() - (weights[~good] >= t).mean()
    assert value(at) == pytest.approx(max(value(t) for t in weights))


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 2000])
def test_top_k(spark, k):
    rng = random.Random(k)
    keys = [rng.choice([rng.randrange(-(2**61), 2**61), 5, 10**9 + rng.randrange(50)]) for _ in range(1000)]
    found = sorted(r[0] for r in importance.top_k(spark.createDataFrame([(x,) for x in keys], "x long"), "x", k).collect())
    last = sorted(keys, reverse=True)[min(k, 1000) - 1] if k else None
    assert found == sorted(x for x in keys if k and x >= last)


def test_lowest(spark):
    table = spark.range(5000).withColumn("h", F.xxhash64("id"))
    assert [r["h"] for r in lowest(table, "h", 10).collect()] == sorted(r["h"] for r in table.collect())[:10]
    assert lowest(table.limit(0), "h", 10).count() == 0
    assert lowest(table, "h", 10_000).count() == 5000


def labelled(spark):
    rng = random.Random(0)
    good = [" ".join(rng.choices(["the", "cat", "sat", "on", "mats", "and", "slept"], k=40)) for _ in range(200)]
    bad = [" ".join(rng.choices(["BUY!!", "NOW!!", "$$$", "the", "cheap|"], k=40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = [(i, int(i < 200), None) for i in range(0, 260, 2)] + [(None, 1, 1), (4, None, 0), (999999, 1, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resample(spark):
    rows, labels = labelled(spark)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (500, None), (501, ""), (502, " \n")]
    table = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, row string, good int")
    found = [r["doc_id"] for r in importance.resample(table, labels).collect()]
    assert {i for i in range(200)} <= set(found)
    assert not set(found) & set(range(200, 260)) and not set(found) & {500, 501, 502}
    assert found.count(7) == 2 and None in found
    assert importance.resample(table, labels, k=10).count() == 10
    again = [r["doc_id"] for r in importance.resample(table.repartition(5), labels).collect()]
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_gumbel_keys_draw_by_weight():
    """Of rows with weights w, the one with the greatest key is each with probability exp(w) / sum, and so on down."""
    log_weights, n = np.array([0.0, 1.0, -1.0, 0.5]), 20_000
    noise = np.array([[importance.gumbel(i, None, seed) for i in range(4)] for seed in range(n)])
    order = np.argsort(-(log_weights + noise), axis=1)
    share = np.exp(log_weights) / np.exp(log_weights).sum()
    assert np.bincount(order[:, 0], minlength=4) / n == pytest.approx(share, abs=0.015)
    second = sum(share[j] * share / (1 - share[j]) * (np.arange(4) != j) for j in range(4))
    assert np.bincount(order[:, 1], minlength=4) / n == pytest.approx(second, abs=0.015)


def plain(rows, labels, hashes, settings, k=None):
    """Ids that are kept, by other code: models, threshold and keys of all rows on one machine."""
    grams = []
    for _, text in rows:
        tokens = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+|[!-/:-@\[-`{-~]+", text or "")
        one = [xxhash.xxh3_64_intdigest(t.encode()) for t in tokens]
        two = []
        for a, b in zip(one, one[1:]):
            x = ((a ^ a >> 31) * 0x9E3779B97F4A7C15 + (b ^ b >> 29)) % 2**64
            two.append(1 if a == b else x ^ x >> 32)
        grams.append([x % settings.buckets for x in one + two])
    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = min(good.get(i, 1), int(q > 0))
    fit = {i for i, q in good.items() if q and hashes[i] % 2 == 0}
    raw, target = Counter(), Counter()
    for (i, _), own in zip(rows, grams, strict=True):
        raw.update(own)
        if i in fit:
            target.update(own)
    floor, n, prior = 0.1 * sum(raw.values()) / settings.buckets, sum(target.values()), settings.smoothing * settings.buckets
    base = lambda b: (raw[b] + floor) / (sum(raw.values()) + floor * settings.buckets)
    ratio = lambda b: math.log((target[b] + prior * base(b)) / (n + prior)) - math.log(base(b))
    weights = [settings.grams * sum(map(ratio, own)) / len(own) if own else -math.inf for own in grams]
    held = [(w, good[i]) for w, (i, _) in zip(weights, rows, strict=True) if i in good and hashes[i] % 2 == 1]
    if k is None:
        value = lambda t: sum(w >= t for w, q in held if q) / sum(q for _, q in held) - sum(w >= t for w, q in held if not q) / sum(not q for _, q in held)
        best = max(value(w) for w, _ in held)
        at = max(w for w, _ in held if value(w) == best)
        below = [w for w, _ in held if w < at]
        k = sum(w >= ((at + max(below)) / 2 if below and max(below) > -math.inf else at) for w in weights)
    keys = [w + importance.gumbel(i, t, settings.seed) for w, (i, t) in zip(weights, rows, strict=True)]
    last = sorted(keys, reverse=True)[:k][-1]
    return sorted(str(i) for key, (i, _) in zip(keys, rows, strict=True) if key >= last - 1e-6), [w for w in weights]


@pytest.mark.parametrize("grams", [32, 1])
def test_kept_rows_are_the_plain_ones(spark, grams):
    rows, labels = labelled(spark)
    rng = random.Random(3)
    rows += [(1000 + i, " ".join(rng.choices(["the", "cat", "sat", "BUY!!", "NOW!!", "é", "cheap|"], k=30))) for i in range(100)] + [(None, "the cat"), (7, None), (9, rows[9][1])]
    settings = importance.Settings(buckets=1 << 10, grams=grams)
    hashes = {r["i"]: r["h"] for r in labels.selectExpr("doc_id as i", "xxhash64(doc_id, 42) as h").collect()}
    expected, weights = plain(rows, [(r["doc_id"], r["quality"]) for r in labels.collect()], hashes, settings)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str(r["doc_id"]) for r in importance.resample(table, labels, settings=settings).collect()) == expected
    if grams == 1:  # the draw decides where weights are close
        top = sorted(range(len(rows)), key=lambda k: -weights[k])[: len(expected)]
        assert sorted(str(rows[k][0]) for k in top) != expected


def test_without_labels_or_rows(spark):
    rows, labels = labelled(spark)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    none = importance.resample(table, labels.limit(0))
    assert none.count() == 260 and none.agg(F.max(F.abs("log_weight"))).first()[0] == 0
    assert importance.resample(table.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in importance.resample(docs, labels).collect()}
    sample = {r["label_id"]: r["fit"] for r in importance._labelled(labels, importance.Settings(), "doc_id", "quality").collect()}
    rows = [(r["quality"], r["doc_id"] in kept) for r in labels.collect() if not sample.get(r["doc_id"])]
    assert np.mean([k for q, k in rows if q]) > 0.97
    assert np.mean([k for q, k in rows if not q]) < 0.1
