"""Mixing: apportionment against giving out seats one by one, and the mix's promises."""

import random
from fractions import Fraction

import pytest

from quillstack.llm import mixing


def one_by_one(shares, seats, most):
    found = [0] * len(shares)
    for _ in range(seats):
        open_ = [i for i, x in enumerate(shares) if x and found[i] < most[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (Fraction(shares[i]) / (2 * found[i] + 1), -i))
        found[best] += 1
    return found


@pytest.mark.parametrize("seed", range(150))
def test_sainte_lague(seed):
    rng = random.Random(seed)
    shares = [rng.choice([0, 1, rng.randrange(1, 50), rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 12))]
    seats = rng.randrange(0, 120)
    most = [rng.choice([1000, rng.randrange(0, 30)]) for _ in shares]
    assert mixing.sainte_lague(shares, seats, most) == one_by_one(shares, seats, most)
    assert mixing.sainte_lague(shares, seats) == one_by_one(shares, seats, [10**6] * len(shares))


def test_targets_stop_at_the_cap():
    assert mixing.capped_targets([10, 10, 10], [1, 2, 3], 3) == [5, 10, 15]
    assert mixing.capped_targets([1, 100, 100], [3, 1, 1], 3) == [3, 99, 99]
    assert mixing.capped_targets([0, 0], [1, 2], 3) == [0, 0]
    found = mixing.capped_targets([2, 3, 500, 40], [1, 2, 3, 1], 3)
    assert sum(found) == 545 and all(t <= 3 * s for t, s in zip(found, [2, 3, 500, 40], strict=True))


def rows():
    rng = random.Random(4)
    sources = ["a", "b", "é", "z", "", None]
    data = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 400])), rng.choice(sources + ["a"] * 6)) for i in range(400)]
    return data + [(5, "same row again", "a")] * 20 + [(None, "no id here", "b"), (900, None, "b"), (901, "tiny", "tiny")]


def test_mix(spark):
    data = rows()
    table = spark.createDataFrame([(i, t, s, 1, "n") for i, t, s in data], "doc_id long, text string, source string, size int, number string")
    found = mixing.mix(table).collect()
    order = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["spans"]))
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted(map(order, found)) == sorted(map(order, again))
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.capped_targets([sizes[s] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))], 3), strict=True))
    assert len(found) == len(data)
    by_target = {}
    for r in found:
        assert r["taken"] == sum((x["to"] - x["from"]) * x["times"] for x in r["spans"])
        assert r["taken"] <= 3 * r["size"]
        by_target.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sorted(by_target) == sorted((sizes[s], float(targets[s])) for s in names)
    for (_, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= max(16, 0.01 * target)


@pytest.mark.parametrize("cap", [1, 3])
def test_targets_of_any_number_of_sources(spark, cap):
    """The plan that only sums reach the driver for has the driver's targets, and quotas nearest to them."""
    rng = random.Random(cap)
    sizes = {"": 5, None: 700, "aé": 0, "Z": 1} | {f"s{i}": rng.choice([1, 10, 300, 10**7]) for i in range(40)} | {"hot": 10**9, "é": 3}
    sums = spark.createDataFrame([(n, s, 1) for n, s in sizes.items()], "source string, source_size long, source_rows long")
    key = lambda r: (r["source"] is None, r["source"] or "")
    planned, levelled = (sorted(f(sums, (1, 2, 3), cap, 64).collect(), key=key) for f in (mixing._planned, mixing._levelled))
    same = lambda r: (r["source"], r["source_size"], r["number"], r["target"], r["block_words"])
    assert list(map(same, planned)) == list(map(same, levelled))
    assert all(abs(a["quota"] - b["quota"]) <= 1 for a, b in zip(planned, levelled, strict=True))
    assert all(abs(r["quota"] * r["block_words"] - r["target"]) <= max(16, 0.01 * r["target"]) for r in levelled)
    assert mixing._levelled(sums.limit(0), (1, 2, 3), cap, 64).count() == 0
    assert {r["target"] for r in mixing._levelled(sums.where("source_size = 0"), (1, 2, 3), cap, 64).collect()} == {0.0}


def test_mix_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    test_mix(spark)
    test_null_and_empty(spark)


def test_equal_rows_are_dealt_to_all_shards(spark, monkeypatch):
    """Nine of ten rows are equal: shards hold no more than their share, and targets are met."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    monkeypatch.setattr(mixing, "MOST_EQUAL", 50)
    data = [(1, "w " * 10, "a")] * 900 + [(i, "w " * 10, "ab"[i % 2]) for i in range(100)]
    held = []
    real = mixing.materialize

    def seen(df, label):
        found = real(df, label)
        if label == "dealt":
            held.extend(r["count"] for r in found.groupBy("number", "shard").count().collect())
        return found

    monkeypatch.setattr(mixing, "materialize", seen)
    table = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(table).collect()
    assert len(found) == 1000 and len(held) >= 18 and max(held) < 160
    for target in {r["target"] for r in found}:
        assert abs(sum(r["taken"] for r in found if r["target"] == target) - target) <= 0.01 * target + 16


def test_small_sources_beside_a_hot_one(spark):
    """Each comes near its target, whatever the blocks of the large one."""
    small = {"b": 10, "c": 30, "d": 40, "e": 1, "f": 200, "g": 5000}
    data = [(i, "w " * 2000, "a") for i in range(300)] + [(1000 + n, "w " * n, s) for s, n in small.items()]
    found = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).where("doc_id >= 1000").collect()
    assert {r["doc_id"] - 1000: r["target"] for r in found} == {n: 3.0 * n for n in small.values()}
    for r in found:
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"]


def test_every_source_has_its_seats_one_by_one(spark):
    """Tiny sources and huge ones: of each size of block, quotas are those of giving out one block after another."""
    rng = random.Random(8)
    sizes = {f"s{i:02}": rng.choice([0, 1, 2, 7, 10, 99, 150, 230, 450, 900, 5000, 20_000, 90_000]) for i in range(60)}
    sums = spark.createDataFrame([(n, s, 1) for n, s in sizes.items()], "source string, source_size long, source_rows long")
    targets = mixing.capped_targets(list(sizes.values()), [(1, 2, 3)[k % 3] for k in range(60)], 3)
    for plan in (mixing._planned, mixing._levelled):
        found = sorted(plan(sums, (1, 2, 3), 3, 64).collect(), key=lambda r: r["number"])
        assert len({r["block_words"] for r in found}) > 4
        for own in {r["block_words"] for r in found}:
            level = [k for k, r in enumerate(found) if r["block_words"] == own]
            seats = round(sum(targets[k] for k in level) / own)
            assert [found[k]["quota"] for k in level] == one_by_one([targets[k] for k in level], seats, [seats] * len(level))


def test_sources_with_one_prefix_are_many_tasks(spark, monkeypatch):
    """5000 sources whose names begin alike: ranges of them are even."""
    from quillstack.operators import order

    held = []
    real = order.ranged

    def seen(rows_, *by):
        found = real(rows_.repartition(4), *by)
        held.extend(r["count"] for r in found.groupBy("_bucket").count().collect())
        return found

    monkeypatch.setattr(order, "ranged", seen)
    sums = spark.createDataFrame([(f"https://site.example/{i:05}", i % 90, 1) for i in range(5000)], "source string, source_size long, source_rows long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    found = mixing._levelled(sums, (1, 2, 3), 3, 64).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["number"] for r in sorted(found, key=lambda r: r["source"])] == list(range(5000))
    assert len(held) == 4 and max(held) < 2000


def test_shards_have_few_rows_and_groups(spark, monkeypatch):
    """Rows without a word make shards too; of over SHARDS shards a source's quota is shared among groups first."""
    for name, value in (("SHARD_ROWS", 50), ("SHARD_WORDS", 400), ("SHARDS", 3)):
        monkeypatch.setattr(mixing, name, value)
    held = []
    real = mixing.materialize

    def seen(df, label):
        found = real(df, label)
        if label == "dealt":
            held.extend(r["count"] for r in found.groupBy("number", "shard").count().collect())
            held.append(-max(r["groups"] for r in found.select("groups").distinct().collect()))
        return found

    monkeypatch.setattr(mixing, "materialize", seen)
    data = [(i, "", "empty") for i in range(1000)] + [(i, "w " * 20, "ab"[i % 2]) for i in range(600)]
    found = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert len(found) == 1600 and max(held) < 120 and min(held) <= -5
    for target in {r["target"] for r in found}:
        assert abs(sum(r["taken"] for r in found if r["target"] == target) - target) <= 0.01 * target + 16


def test_null_and_empty(spark):
    kinds = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kinds)).count() == 0
    row = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], kinds)).orderBy("doc_id").collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in row] == [(0, 0, 0.0, 0)] * 2


@pytest.mark.parametrize(("seed", "cap", "block_words"), [(1, 3, 1), (2, 3, 5), (3, 1, 7), (4, 3, 64), (5, 2, 3), (6, 3, 2)])
def test_any_number_of_sources_has_one_plan(spark, seed, cap, block_words):
    """The plan on the executors is the driver's, quotas and ties too: many equal sources, or some beside large ones."""
    rng = random.Random(seed)
    kinds = [[1000], [999, 1000, 1001], [0, 1, 10, 300, 10**7], [7000, 13, 10**9], [rng.randrange(1, 90_000) for _ in range(50)], [350, 450, 100 * block_words]][seed - 1]
    sizes = {f"s{i:03}": rng.choice(kinds) for i in range(rng.choice([60, 157]))} | {None: 4321, "": 0}
    sums = spark.createDataFrame([(n, s, 1) for n, s in sizes.items()], "source string, source_size long, source_rows long")
    planned, levelled = (sorted(map(tuple, f(sums, (1, 2, 3), cap, block_words).collect()), key=lambda r: r[2]) for f in (mixing._planned, mixing._levelled))
    assert planned == levelled


@pytest.mark.parametrize("seed", range(6))
def test_seats_one_by_one(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "QUOTIENT_RANGES", 8)
    monkeypatch.setattr(mixing, "TIED_SOURCES_BITS", 2)
    rng = random.Random(seed)
    kinds = [1, 3, 5, 15, 10**20] if seed == 5 else [[1], [2, 6, 10], list(range(1, 50)), [1, 4000], [7, 21, 35, 10**6]][seed]
    shares = [rng.choice(kinds) for _ in range(40)]
    table = spark.createDataFrame([(i, str(x)) for i, x in enumerate(shares)], "number long, units string")
    for seats in (1, 13, 40, rng.randrange(50, 400)):
        found = dict(mixing._seats(table, sum(shares), seats).collect())
        assert [found.get(i, 0) for i in range(40)] == one_by_one(shares, seats, [seats] * 40)


def test_no_switch_changes_the_mix(spark, monkeypatch):
    """More sources than the driver plans for, and more equal rows than one task counts, in files of any layout."""
    data = rows() + [(i, "w " * 90, f"s{i % 31}") for i in range(1000, 1400)] + [(7, "w " * 10, "a")] * 300 + [(7, "v " * 10, None)] * 200
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    shown = lambda df: sorted((str(r["doc_id"]), r["size"], r["source_size"], r["target"], r["taken"], str(r["spans"])) for r in df.collect())
    before = shown(mixing.mix(table))
    for name, value in (("MOST_EQUAL", 16), ("MOST_SOURCES", 2)):
        monkeypatch.setattr(mixing, name, value)
        assert shown(mixing.mix(table.repartition(5))) == before
