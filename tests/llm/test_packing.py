"""Packing: the dynamic program and the plan against brute force, tokens against the other library."""

import bisect
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from quillstack.llm import packing
from quillstack.llm.queries import tokenizer_files


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("seed", range(40))
def test_fullest_is_the_greatest_sum(seed):
    rng = random.Random(seed)
    left = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(4)}
    room = rng.randrange(0, 40)
    found = packing.fullest(left, room)
    best = max(s for c in product(*(range(n + 1) for n in left.values())) if (s := sum(a * b for a, b in zip(c, left))) <= room)
    assert sum(found) == best
    assert all(found.count(k) <= left[k] for k in set(found))


def best_fit(histogram, capacity):
    """Bins of best-fit decreasing."""
    room = []
    for x in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = bisect.bisect_left(room, x)
        bisect.insort(room, (room.pop(at) if at < len(room) else capacity) - x)
    return len(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_packs_all_in_few_bins(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(rng.choice([3, 50, 3000])):
        n = min(64, int(rng.expovariate(1 / 15)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    found = packing.plan(histogram, 64)
    used = {}
    for times, lengths in found:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    assert sum(t for t, _ in found) <= best_fit(histogram, 64)


def test_plan_is_short_however_many_pieces():
    assert len(packing.plan({k: 10**12 + k for k in range(1, 1025)})) < 3000


def test_libraries_agree():
    """On every code point, alone and among others, and on long runs."""
    files = tokenizer_files()
    one, other = packing._encoder(**files), packing._encoder(files["vocabulary"], None)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    texts = ["".join(f"a{c}1 {c} " for c in points[at : at + 400]) for at in range(0, 0x30000, 400)]
    texts += ["".join(rng.choices(points[:0x3000] + list(" \n\t\r'") * 300, k=200)) for _ in range(300)]
    texts += ["", " ", "\n\n  \n", "a" * 5000, "!" * 3000, "I'll we've <|endoftext|> x", "  x \u0085y"]
    assert [t for t in texts if one(t) != list(other(t))] == []


def rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "Beta", "gämma", "δ", "\n", "x1"], k=rng.choice([1, 5, 40, 400, 3000]))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 5 + [(100, None), (101, ""), (None, "no id")]


@pytest.mark.parametrize("ranks", [True, False])
def test_pack(spark, ranks):
    data = rows()
    files = tokenizer_files() if ranks else {"vocabulary": tokenizer_files()["vocabulary"]}
    table = spark.createDataFrame([(i, t, 5, 1) for i, t in data], "doc_id long, text string, length int, part int")
    found = packing.pack(table, **files, keep_ids=True).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, t in data:
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            expected.append((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], dtype="<u4").tobytes())))
    order = lambda x: (x[0] is None, x)
    plain = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(plain, (tuple(r)[:5] for r in found))) == sorted(map(plain, expected))
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= best_fit(Counter(r["length"] for r in found), 1024)
    built = {r["sequence_id"]: r["ids"] for r in packing.sequences(spark.createDataFrame(found)).collect()} if ranks else {}
    for r in found if ranks else []:
        assert built[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@pytest.mark.parametrize("ranks", [True, False])
def test_added_tokens(ranks):
    """The string of an added token is its id, as the plain tokenizer has it."""
    files = tokenizer_files()
    encode = packing._encoder(files["vocabulary"], files["ranks"] if ranks else None)
    plain = Tokenizer.from_file(files["vocabulary"])
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f" {end} ", f"x\n\n{end}\n\ny", f"a{end}b", f"  {end}  {end}'s", "<|endoftext|", "<|endoftext |>", f"{end}\u0301", f"é {end}\u00a0z", end.upper(), f"<{end}>", "<|" + end + "|>"]
    rng = random.Random(3)
    texts += ["".join(rng.choices([end, " ", "\n", "ab", "<|", "|>", "1", "!", "é"], k=12)) for _ in range(500)]
    for text in texts:
        assert list(encode(text)) == plain.encode(text, add_special_tokens=False).ids
    assert list(encode(texts[0])) == [64, 220, 50256, 275]


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), **tokenizer_files()).count() == 0
