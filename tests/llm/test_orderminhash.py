"""Order MinHash against a plain version, and the order of documents against sorting."""

import hashlib
import random

import numpy as np
import pytest

from quillstack.llm import orderminhash as omh
from quillstack.llm.common import with_rows

MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 31) * int(omh._B) & MASK
    h ^= h >> 29
    h = h * int(omh._A) & MASK
    return h ^ h >> 32


def plain_sketch(text, settings):
    """One k-mer after another."""
    if not text:
        return [0] * settings.sketches
    k = min(settings.k, len(text))
    seen, groups = {}, {}
    hashes = omh._kmers(omh._points(text), settings.k)
    for at in range(len(text) - k + 1):
        kmer = text[at : at + k]
        number = seen.get(kmer, 0)
        seen[kmer] = number + 1
        own = mixed(((int(hashes[at]) >> 20) * int(omh._C) + number) & MASK)
        groups.setdefault(own * settings.sketches >> 64, []).append((own >> 20, at, own))
    found = []
    for g in range(settings.sketches):
        least = sorted(groups.get(g, []))[: settings.tuple_size]
        value = 0
        for _, _, own in sorted(least, key=lambda x: x[1]) + [(0, 0, 0)] * (settings.tuple_size - len(least)):
            value = mixed((value * int(omh._C) + own) & MASK)
        found.append(max(1, value >> 32) if least else 0)
    return found


@pytest.mark.parametrize("settings", [omh.Settings(), omh.Settings(3, 3, 8), omh.Settings(1, 1, 16), omh.Settings(16, 2, 4)])
def test_sketch_is_the_plain_one(settings):
    rng = random.Random(1)
    texts = ["", "a", "abc", "é" * 30, "".join(rng.choices("ab", k=300)), "".join(rng.choices("abcdefgh \n😀", k=20_000)), "x" * 5000]
    for text in texts:
        assert omh.sketch(text, settings).tolist() == plain_sketch(text, settings)


def test_kmers_tell_texts_apart():
    text = "abcdefghij" * 5 + "xyz"
    for k in (1, 2, 5, 7, 10, 12):
        found = omh._kmers(omh._points(text), k)
        assert len(set(found.tolist())) == len({text[i : i + k] for i in range(len(text) - k + 1)})


def test_long_texts_sort_alike(monkeypatch):
    text = "".join(random.Random(2).choices("abcdef", k=30_000))
    usual = omh.sketch(text)
    monkeypatch.setattr(omh, "_PLACE_BITS", 10)
    monkeypatch.setattr(omh, "_HASH_BITS", 44)
    assert omh.sketch(text).tolist() == usual.tolist()


def test_order_matters_and_edits_show():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklm", k=9)) for _ in range(300)]
    text, mixed_up = " ".join(words), " ".join(rng.sample(words, len(words)))
    near = lambda a, b: omh.likeness(omh.sketch(a), omh.sketch(b))
    assert near(text, text) == 1
    small = text.replace(words[5], "#").replace(words[99], "#")
    assert near(text, small) > 0.85 > 0.4 > near(text, omh.edited(text, mixed_up[::-1])) > 0.02
    assert near(text, mixed_up) < 0.3 and near(text, mixed_up[::-1]) < 0.05
    assert near("", "") == 1 and near("", "abc") == 0


def rows():
    rng = random.Random(4)
    data = [(i * 3, "".join(rng.choices("abcd é\n😀", k=rng.choice([0, 1, 7, 60, 900])))) for i in range(120)]
    return data + [(-5, "negative"), (12, "again twelve"), (12, "again twelve"), (None, "no id"), (500, None), (2**40, "far " * 40)]


@pytest.mark.parametrize("data", [rows(), [(1, "only one")], [(None, "x"), (None, "yy")], [(5, "abc"), (5, "abc"), (5, "abd")]])
def test_next_documents(spark, data):
    found = omh.fingerprints(spark.createDataFrame([(t, i, 1, False) for i, t in data], "text string, doc_id long, range int, guest boolean"), range_bytes=100).collect()
    h = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for _, t in data], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    ordered = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), -h[r[1]]))
    expected = []
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, other, after = (omh.sketch(x) for x in (text, changed, following))
        expected.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), omh.text_of(own), omh.text_of(other), omh.likeness(own, other), omh.likeness(own, after)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found), key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("hot", [7, None])
def test_rows_of_one_id_are_split_among_ranges(spark, hot):
    """Nine of ten rows have one id, or none, and most of these are equal."""
    data = [(hot, f"hot {i if i % 3 == 0 else 0}") for i in range(450)] + [(100 + i, f"text {i}") for i in range(50)]
    docs = spark.createDataFrame(data, "id long, text string").repartition(3).selectExpr("id", "xxhash64(text) tie", "text")
    docs = with_rows(docs)
    found = omh._ranged(docs, docs.select("id", "tie", "row"), 20).groupBy("range").count().collect()
    assert len(found) > 10 and max(r["count"] for r in found) < 120
    test_next_documents(spark, data)


def test_whole_texts_of_any_length_have_order():
    """Every sketch has a tuple, so that blocks that change places show in short texts as in long ones."""
    whole, rng = omh.Settings(whole=True), random.Random(5)
    near = lambda a, b: omh.likeness(omh.sketch(a, whole), omh.sketch(b, whole))
    swapped = {40: [], 140: [], 2000: []}
    for n, found in swapped.items():
        for _ in range(60):
            text = "".join(rng.choices("abcdefghijklmnop ", k=n))
            assert np.all(omh.sketch(text, whole) != 0)
            found.append(near(text, text[n // 2 :] + text[: n // 2]))
    likeness = {n: sum(x) / len(x) for n, x in swapped.items()}
    # both k-mers of a tuple are in both texts, and half of such tuples keep their order
    assert all(abs(x - 0.5 * ((n - 18) / n) ** 2) < 0.06 for n, x in likeness.items())
    assert near("", "") == 1 and near("", "abc") == 0 and near("abc", "abc") == 1


@pytest.mark.parametrize("settings", [omh.Settings(whole=True), omh.Settings(3, 3, 8, True), omh.Settings(1, 1, 16, True)])
def test_whole_sketch_is_the_plain_one(settings):
    rng = random.Random(6)
    factors = [int(omh._mixed(np.array([s], dtype=np.uint64) * omh._C)[0]) | 1 for s in range(1, settings.sketches + 1)]
    for text in ["a", "abc", "é" * 30, "".join(rng.choices("ab", k=300)), "".join(rng.choices("abcdefgh 😀", k=4000))]:
        k = min(settings.k, len(text))
        hashes, seen, own = omh._kmers(omh._points(text), settings.k), {}, []
        for at in range(len(text) - k + 1):
            number = seen[text[at : at + k]] = seen.get(text[at : at + k], -1) + 1
            own.append(mixed(((int(hashes[at]) >> 20) * int(omh._C) + number) & MASK))
        expected = []
        for f in factors:
            least = sorted(sorted(range(len(own)), key=lambda i: own[i] * f & MASK)[: settings.tuple_size])
            value = 0
            for x in [own[i] for i in least] + [0] * (settings.tuple_size - len(least)):
                value = mixed((value * int(omh._C) + x) & MASK)
            expected.append(max(1, value >> 32))
        assert omh.sketch(text, settings).tolist() == expected


def test_no_rows(spark):
    assert omh.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_settings():
    with pytest.raises(ValueError):
        omh.Settings(sketches=48)
    assert np.isclose(omh.likeness(np.array([1, 2, 0], dtype=np.uint32), np.array([1, 3, 0], dtype=np.uint32)), 0.5)
