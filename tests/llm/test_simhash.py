"""SimHash near-duplicates against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillstack.llm import components, simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    """The least key reachable from each."""
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", "  \t\n", "One", "a b", "A B c", "the cat the cat the cat", "É é x\u0085y z w\x0bq", "w " * 70_000 + "end here now"])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def flipped(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def test_links_connect_what_pairs_connect(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for x in list(prints):
        prints.add(flipped(x, rng.sample(range(64), rng.randrange(1, 6))))
    dense = rng.getrandbits(64)
    prints |= {flipped(dense, rng.sample(range(16), rng.randrange(1, 9))) for _ in range(150)}
    prints = sorted(prints)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(table).collect()]
    assert classes(prints, found) == classes(prints, pairs)
    assert all((a, b) for a, b in found if a != b)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_flipping_bits_finds_what_comparing_finds(monkeypatch, radius):
    rng = random.Random(radius)
    run = np.array(sorted({rng.getrandbits(14) for _ in range(200)}), dtype=np.uint64)
    compared = simhash._labels(run, radius, simhash.Tally())
    monkeypatch.setattr(simhash, "FLIP_OVER", 1)
    assert (simhash._labels(run, radius, simhash.Tally()) == compared).all()


@pytest.mark.parametrize("short", [1, 32])
def test_the_count_removes_pairs(monkeypatch, short):
    """Of the pairs that meet in lists, those that share four bytes only go by the count, and no link goes with them."""
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = random.Random(8)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        four = sum(255 << 8 * p for p in rng.sample(range(8), 4))
        prints |= {x, flipped(x, rng.sample(range(64), 3)), flipped(x, [8 * p + rng.randrange(8) for p in range(4)]), x ^ (rng.getrandbits(64) & four | 0x0101010101010101 & four)}
    prints = sorted(prints)
    posted = []
    for x in prints:
        for k, chosen in enumerate(itertools.combinations(range(8), 4)):
            term = k
            for p in chosen:
                term = term << 8 | x >> 8 * p & 255
            posted.append((term, x))
    tally = simhash.Tally()
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in posted], pa.int64()), pa.array([x - (1 << 64) if x >> 63 else x for _, x in posted], pa.int64())], names=["key", "fp"])
    (found,) = simhash._links([batch], 3, tally)
    share = lambda a, b: sum((a ^ b) >> 8 * p & 255 == 0 for p in range(8))
    meet = [(share(a, b), (a ^ b).bit_count() <= 3) for i, a in enumerate(prints) for b in prints[i + 1 :] if share(a, b) >= 4]
    assert tally.met == sum(math.comb(n, 4) for n, _ in meet)
    assert tally.reached == sum(math.comb(n, 4) for n, _ in meet if n >= 5) < tally.met
    assert tally.verified == sum(math.comb(n, 4) for n, near in meet if near) < tally.reached
    linked = [(u % (1 << 64), v % (1 << 64)) for u, v in zip(*(c.to_pylist() for c in found.columns), strict=True)]
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert classes(prints, linked) == classes(prints, pairs)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101)], [(5, 3), (3, 5), (9, 3), (20, 21)]])
def test_components(spark, edges):
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["root"] for r in found.collect()} == classes(nodes, [e for e in edges if e[0] != e[1]])
    assert found.count() == len(nodes)


def documents():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, t + " tail") for i, t in enumerate(base[:6])]
    rows += [(40 + i, base[0]) for i in range(30)] + [(3, base[3]), (80, None), (81, ""), (82, " \n"), (83, "One"), (None, base[1]), (None, "alone in the world")]
    return rows


def test_near_duplicates(spark):
    rows = documents()
    table = spark.createDataFrame([(t, i, "x", 7, "fp") for i, t in rows], "text string, doc_id long, fp string, root int, id string")
    prints = [plain_fingerprint(t) for _, t in rows]
    keys = range(len(rows))
    linked = [(a, b) for a in keys for b in keys if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    of = classes(keys, linked)
    expected = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in keys if of[j] == of[k]]
        expected.append((i, f"{prints[k]:016x}", min((x for x in ids if x is not None), default=None), len(ids)))
    found = [tuple(r)[:4] for r in simhash.near_duplicates(table).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(found, key=order) == sorted(expected, key=order)


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
