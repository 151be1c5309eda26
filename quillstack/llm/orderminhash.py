"""Order MinHash: fingerprints of texts that follow edit distance, not set overlap alone.

Every k-mer of a text is numbered by its occurrences before it, so that repeats count. A hash of (k-mer, number) deals
it to one of ``sketches`` groups; of each group the ``tuple_size`` k-mers with the least hashes are selected, kept in
the order in which they stand in the text, and hashed as a tuple. Two fingerprints agree at a sketch if the same
k-mers are least and stand in the same order, which edits that move text break even where the set of k-mers stays.
Dealing k-mers to groups takes one pass over a text for all sketches, but leaves groups of a short text without a
tuple, and so without order. With ``whole`` each sketch selects from all k-mers of the text by a hash of its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import batched, materialize, partitions, rows, with_rows

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bits of a k-mer's hash in a sort key; the rest are its place in the text. Longer texts sort by index instead.
_HASH_BITS, _PLACE_BITS = 44, 20
#: Ranges of ids, whose first keys the driver holds; in larger corpora ranges are longer.
MOST_RANGES = 1 << 18
#: Hashes of k-mers that are held at once, for some sketches.
_HELD = 1 << 17


@dataclass(frozen=True)
class Settings:
    k: int = 10
    tuple_size: int = 2
    sketches: int = 64
    whole: bool = False

    def __post_init__(self) -> None:
        if self.k < 1 or self.tuple_size < 1 or self.sketches < 1 or self.sketches & (self.sketches - 1):
            raise ValueError("k and tuple_size must be 1 or more, sketches a power of two")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    h ^= h >> np.uint64(29)
    h *= _A
    return h ^ (h >> np.uint64(32))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _kmers(points: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-mer; of the whole text if that is shorter."""
    k = min(k, len(points))
    done, h, power, step = 0, np.zeros(len(points), dtype=np.uint64), int(_A), 1
    part = points + np.uint64(1)
    # h is of `done` characters, part of `step` (a power of two): joined where k has that bit
    while step <= k:
        if k & step:
            n = len(points) - done - step + 1
            h = h[:n] * np.uint64(pow(int(_A), step, 1 << 64)) + part[done : done + n]
            done += step
        part = part[:-step] * np.uint64(power) + part[step:] if 2 * step <= k else part
        power, step = power * power % (1 << 64), 2 * step
    return _mixed(h)


def _sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 44 high bits of hashes, sorted, ties by place; and the places."""
    h = h >> np.uint64(64 - _HASH_BITS)
    if len(h) <= 1 << _PLACE_BITS:
        key = (h << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        key.sort()
        return key >> np.uint64(_PLACE_BITS), (key & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    place = np.argsort(h, kind="stable")
    return h[place], place


def sketch(text: str | None, settings: Settings = Settings()) -> np.ndarray:  # noqa: B008
    """A number for each sketch, 0 where the text has no k-mer for it."""
    out = np.zeros(settings.sketches, dtype=np.uint32)
    if not text:
        return out
    h, place = _sorted(_kmers(_points(text), settings.k))
    n = len(h)
    at = np.arange(n)
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    number = at - np.maximum.accumulate(np.where(fresh, at, 0))
    own = np.empty(n, dtype=np.uint64)
    own[place] = _mixed(h * _C + number.astype(np.uint64))
    if settings.whole:
        return _whole(own, settings)
    # few k-mers are least: of long texts only those under a bound are sorted, unless a group has too few of them
    group_bits = settings.sketches.bit_length() - 1
    within = own << np.uint64(group_bits)
    bound = 32 * settings.tuple_size * settings.sketches / n
    for some in ([np.flatnonzero(within < np.uint64(int(bound * 2**64)))] if bound < 0.5 else []) + [np.arange(n)]:
        least, where = _sorted(own[some])
        group = (least >> np.uint64(_HASH_BITS - group_bits)).astype(np.int64)
        first = np.searchsorted(group, np.arange(settings.sketches + 1))
        if len(some) == n or np.all(np.diff(first) >= settings.tuple_size):
            break
    ahead, size = first[:-1], np.diff(first)
    picked = np.full((settings.sketches, settings.tuple_size), n, dtype=np.int64)  # n: none
    for j in range(settings.tuple_size):
        has = size > j
        picked[has, j] = some[where[ahead[has] + j]]
    picked.sort(axis=1)  # text order
    value = np.zeros(settings.sketches, dtype=np.uint64)
    hashes = np.append(own, np.uint64(0))
    for j in range(settings.tuple_size):
        value = _mixed(value * _C + hashes[picked[:, j]])
    out[:] = value >> np.uint64(32)
    out[out == 0] = 1
    out[size == 0] = 0
    return out


def _whole(own: np.ndarray, settings: Settings) -> np.ndarray:
    """A number for each sketch, which selects from all k-mers by their hashes times its own odd number."""
    n, size = len(own), min(settings.tuple_size, len(own))
    factors = _mixed(np.arange(1, settings.sketches + 1, dtype=np.uint64) * _C) | np.uint64(1)
    picked = np.full((settings.sketches, settings.tuple_size), n, dtype=np.int64)  # n: none
    step = max(1, _HELD // n)
    for at in range(0, settings.sketches, step):
        keys = own * factors[at : at + step, None]
        each = np.arange(len(keys))
        for j in range(size):
            least = keys.argmin(axis=1)
            picked[at : at + step, j] = least
            keys[each, least] = ~np.uint64(0)
    picked.sort(axis=1)  # text order
    value = np.zeros(settings.sketches, dtype=np.uint64)
    hashes = np.append(own, np.uint64(0))
    for j in range(settings.tuple_size):
        value = _mixed(value * _C + hashes[picked[:, j]])
    out = (value >> np.uint64(32)).astype(np.uint32)
    out[out == 0] = 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of sketches that agree, of those that either text has; 1 if neither has any."""
    some = (a != 0) | (b != 0)
    return float((a[some] == b[some]).mean()) if some.any() else 1.0


def text_of(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following`` as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _key(i: int | None, tie: int, row: str) -> tuple:
    """Sorts as documents follow each other: ids from the greatest, null last; equal ids by a hash of their texts, then by row."""
    return i is None, -(i or 0), -tie, row


def _order() -> list[Column]:
    """The same, for Spark."""
    return [F.col("id").desc_nulls_last(), F.col("tie").desc(), F.col("row").asc()]


def _bounds(thin: DataFrame, parts: int) -> list[tuple]:
    """The key of the first row of each range, of ``parts`` ranges at most; row splits ids that repeat, and null ones."""
    out = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("row", pa.string())])

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = min(rows(batches, "id", "tie", "row"), key=lambda r: _key(*r), default=None)
        if found:
            yield from batched([found], out)

    each = thin.select("id", "tie", "row").repartitionByRange(parts, *_order()).mapInArrow(least, "id long, tie long, row string")
    return sorted(_key(*r) for r in each.collect())  # a row for each range


def _ranged(docs: DataFrame, thin: DataFrame, parts: int) -> DataFrame:
    """(range, guest, id, text) from (id, tie, row, text), in partitions by range, a range's rows in order.

    The first row of a range follows the last one of the range before, and comes there too, as a guest. The first key
    of each range is all that leaves the tables.
    """
    bounds = docs.sparkSession.sparkContext.broadcast(_bounds(thin, parts))

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = bounds.value
        for b in batches:
            keys = [_key(*r) for r in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("id", "tie", "row")), strict=True)]
            number = [bisect_right(first, k) - 1 for k in keys]
            leads = [k for k, (n, key) in enumerate(zip(number, keys, strict=True)) if first[n] == key]
            for some, range_, guest in ((b, number, False), (b.take(pa.array(leads, pa.int64())), [(number[k] - 1) % len(first) for k in leads], True)):
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(range_, pa.int32()), pa.array([guest] * some.num_rows), *some.columns], names=["range", "guest", *some.schema.names])

    dealt = docs.select("id", "tie", "row", "text").mapInArrow(visits, "range int, guest boolean, id long, tie long, row string, text string")
    return dealt.repartition(max(1, parts // 4), "range").sortWithinPartitions("range", "guest", *_order())


def fingerprints(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 16 << 20) -> DataFrame:  # noqa: B008
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one with the next smaller id, after the last the first; ids that repeat follow each
    other by a hash of their texts, equal rows by their place, and null ids come last; ranges split either. A null text is empty; an empty text's fingerprint is all
    zeros, and is like another empty one. The only document is its own next. An empty table gives an empty result.
    """
    docs = with_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))).withColumn("tie", F.xxhash64("text"))
    thin = materialize(docs.select("id", "tie", "row", F.octet_length("text").cast("long").alias("bytes")), "order")
    parts = min(MOST_RANGES, 4 * partitions(docs.sparkSession, thin.agg(F.sum("bytes")).first()[0] or 0, 4 * range_bytes))
    out = pa.schema(
        [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            held = None
            for range_, guest, i, text in rows(batches, "range", "guest", "id", "text"):
                text = text or ""
                if held and held[0] != range_:
                    held = None
                if guest and held is None:
                    continue  # another guest has closed this range
                own = sketch(text, settings)
                if held:
                    _, before, whole, print_ = held
                    changed = edited(whole, text)
                    other = sketch(changed, settings)
                    yield (before, len(whole), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), text_of(print_), text_of(other), likeness(print_, other), likeness(print_, own))
                held = None if guest else (range_, i, text, own)

        yield from batched(found(), out)

    kinds = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _ranged(docs, thin, parts).mapInArrow(run, kinds).withColumnRenamed("id", id_col)
