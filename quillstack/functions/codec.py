"""Variable-byte codecs of posting lists: Arrow functions over whole columns, for export and import.

Two conventions: low groups first with the high bit on a number's last byte, and high groups first with the high bit
on all but the last. Queries use arrays; bytes are for files that other programs read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType


def encode_low_first(numbers) -> bytes:  # noqa: ANN001
    out = bytearray()
    for n in numbers:
        n = int(n)
        while n > 127:
            out.append(n & 127)
            n >>= 7
        out.append(n | 128)
    return bytes(out)


def decode_low_first(data: bytes) -> list[int]:
    found, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b & 128:
            found.append(n)
            n = shift = 0
    return found


def decode_high_first(data: bytes) -> list[int]:
    found, n = [], 0
    for b in data:
        n = n << 7 | b & 127
        if not b & 128:
            found.append(n)
            n = 0
    return found


def encode_high_first(numbers) -> bytes:  # noqa: ANN001
    out = bytearray()
    for n in numbers:
        n = int(n)
        groups = [n & 127]
        while n := n >> 7:
            groups.append(n & 127 | 128)
        out += bytes(reversed(groups))
    return bytes(out)


def posting_numbers(postings) -> list[int]:  # noqa: ANN001
    """What a posting list is written as: documents, then for each its gap, its positions' number and their gaps."""
    out, before = [len(postings)], 0
    for doc, positions in postings:
        out += [doc - before, len(positions)]
        before, at = doc, 0
        for p in positions:
            out.append(p - at)
            at = p
    return out


def postings_of(numbers: list[int]) -> list[tuple[int, int, list[int]]]:
    """(document, tf, positions) of each posting of a decoded list."""
    it = iter(numbers)
    found, doc = [], 0
    for _ in range(next(it, 0)):
        doc += next(it)
        tf, at, positions = next(it), 0, []
        for _ in range(tf):
            at += next(it)
            positions.append(at)
        found.append((doc, tf, positions))
    return found


def _coded(numbers: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of lists that follow each other in ``numbers``, and where each begins and the last ends."""
    numbers = numbers.astype(np.uint64)
    width = np.ones(len(numbers), np.int64)
    for k in range(1, 10):
        width += numbers >> np.uint64(7 * k) > 0
    ends = np.cumsum(width)
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        own = np.flatnonzero(width > k)
        last = np.where(width[own] == k + 1, 128, 0).astype(np.uint64)
        out[ends[own] - width[own] + k] = numbers[own] >> np.uint64(7 * k) & np.uint64(127) | last
    return out.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(lengths))]


def encode_all(lists: list) -> list[bytes]:
    """``encode_low_first`` of many lists, all their numbers at once."""
    lengths = np.array([len(x) for x in lists], np.int64)
    numbers = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
    data, cuts = _coded(numbers, lengths)
    cuts = cuts.tolist()
    return [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def _decoded(held: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of strings of bytes that follow each other, of ``bounds``; and where each one's numbers begin and the last end."""
    final = held >= 128
    to = np.flatnonzero(final)
    of = np.searchsorted(bounds, to, side="right") - 1
    since = np.maximum(np.append(0, to[:-1] + 1)[: len(to)], bounds[of])
    numbers = np.zeros(len(to), np.int64)
    for k in range(int((to - since).max(initial=-1)) + 1):
        own = np.flatnonzero(since + k <= to)
        numbers[own] |= (held[since[own] + k] & 127).astype(np.int64) << 7 * k
    return numbers, np.append(0, np.cumsum(final))[bounds]


def decode_all(parts: list[bytes]) -> list[list[int]]:
    """``decode_low_first`` of many strings of bytes, all at once; of numbers under 2**63. A number without an end is none."""
    numbers, cuts = _decoded(np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64)))
    cuts, whole = cuts.tolist(), numbers.tolist()
    return [whole[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def _since(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Differences, of the values at ``heads`` from 0."""
    found = np.diff(values, prepend=0)
    found[heads] = values[heads]
    return found


def _upto(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values so far of each run, of ``sizes`` that follow each other."""
    sums = np.cumsum(values)
    return sums - np.repeat(np.append(0, sums)[np.cumsum(sizes) - sizes], sizes)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64()).to_numpy(zero_copy_only=False)


def encode_lists(lists: pa.Array, headless: bool = False) -> pa.Array:
    """Bytes of lists of postings, by document; what ``posting_numbers`` says, of all lists at once. ``headless`` ones
    lack the number of documents and the first one's id, which go ahead of them; they have a document at least."""
    docs_of, held = _sizes(lists), lists.flatten()
    tf_of = _sizes(held.field("positions"))
    docs = held.field("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
    positions = held.field("positions").flatten().cast(pa.int64()).to_numpy(zero_copy_only=False)
    first, list_of = np.cumsum(docs_of) - docs_of, np.repeat(np.arange(len(docs_of)), docs_of)
    start, post_of = np.cumsum(tf_of) - tf_of, np.repeat(np.arange(len(docs)), tf_of)
    before = np.append(0, np.cumsum(tf_of))  # positions before a posting
    numbers = np.zeros(len(docs_of) + 2 * len(docs) + len(positions), np.int64)
    numbers[np.arange(len(docs_of)) + 2 * first + before[first]] = docs_of
    at = list_of + 1 + 2 * np.arange(len(docs)) + start
    numbers[at], numbers[at + 1] = _since(docs, first[docs_of > 0]), tf_of
    numbers[list_of[post_of] + 3 + 2 * post_of + np.arange(len(positions))] = _since(positions, start[tf_of > 0])
    sizes = 1 + 2 * docs_of + before[first + docs_of] - before[first]
    if headless:
        begin = np.cumsum(sizes) - sizes
        numbers, sizes = np.delete(numbers, np.append(begin, begin + 1)), sizes - 2
    data, cuts = _coded(numbers, sizes)
    found = pa.Array.from_buffers(pa.binary(), len(docs_of), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    return pc.if_else(lists.is_valid(), found, pa.scalar(None, pa.binary())) if lists.null_count else found


def decode_lists(data: pa.Array) -> pa.Array:
    """Lists of (doc_id, tf, positions) of bytes; what ``postings_of`` says, of all lists at once."""
    parts = pc.fill_null(data, b"")
    lengths = pc.binary_length(parts).to_numpy(zero_copy_only=False)
    held = np.frombuffer(b"".join(parts.to_pylist()), np.uint8)
    numbers, cuts = _decoded(held, np.append(0, np.cumsum(lengths, dtype=np.int64)))
    plain, at, docs_of = numbers.tolist(), [], []
    for begin, end in zip((cuts := cuts.tolist()), cuts[1:], strict=False):
        n, i = (plain[begin], begin + 1) if begin < end else (0, begin)
        docs_of.append(n)
        for _ in range(n):  # where a posting begins follows from the one before
            if i + 1 >= end or i + 2 + plain[i + 1] > end:
                raise ValueError("a posting list ends before its postings")
            at.append(i)
            i += 2 + plain[i + 1]
    at, docs_of = np.array(at, np.int64), np.array(docs_of, np.int64)
    tf = numbers[at + 1]
    gaps = numbers[np.repeat(at + 2 - (np.cumsum(tf) - tf), tf) + np.arange(int(tf.sum()))]
    positions = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), pa.array(_upto(gaps, tf)).cast(pa.int32()))
    docs = pa.array(_upto(numbers[at], docs_of)).cast(pa.int32())
    rows = pa.StructArray.from_arrays([docs, pa.array(tf).cast(pa.int32()), positions], names=["doc_id", "tf", "positions"])
    mask = data.is_null() if data.null_count else None
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(docs_of)), pa.int32()), rows, mask=mask)


def _each(column: pd.Series, run) -> pd.Series:  # noqa: ANN001
    """A function of lists on a column's values, nulls kept."""
    there = column.notna()
    found = pd.Series([None] * len(column), index=column.index, dtype=object)
    if there.any():
        found[there] = pd.Series(run(column[there].tolist()), index=column.index[there], dtype=object)
    return found


@F.pandas_udf(BinaryType())
def vbyte_encode(numbers: pd.Series) -> pd.Series:
    return _each(numbers, encode_all)


@F.pandas_udf(ArrayType(LongType()))
def vbyte_decode(data: pd.Series) -> pd.Series:
    return _each(data, decode_all)


@F.pandas_udf(BinaryType())
def vb_encode_be(numbers: pd.Series) -> pd.Series:
    return numbers.map(encode_high_first, na_action="ignore")


@F.pandas_udf(ArrayType(LongType()))
def vb_decode_be(data: pd.Series) -> pd.Series:
    return data.map(decode_high_first, na_action="ignore")


@F.arrow_udf(BinaryType())
def encode_postings(postings: pa.Array) -> pa.Array:
    """From array<struct<doc_id, positions>>, by document."""
    return encode_lists(postings)


POSTINGS = ArrayType(StructType([StructField("doc_id", IntegerType()), StructField("tf", IntegerType()), StructField("positions", ArrayType(IntegerType()))]))


@F.arrow_udf(POSTINGS)
def decode_postings(data: pa.Array) -> pa.Array:
    return decode_lists(data)


def decode_postings_at(data: Column, offset: Column, length: Column) -> Column:
    """The list that a longer string of bytes holds at an offset."""
    return decode_postings(F.substring(data, offset.cast("int") + 1, length.cast("int")))


def vbyte_size(number: Column) -> Column:
    """Bytes that a number takes, without encoding it."""
    return F.lit(1) + sum((number >= F.lit(1 << 7 * k)).cast("int") for k in range(1, 9))


def posting_size(postings: Column) -> Column:
    """Bytes of an encoded posting list, from array<struct<doc_id, positions>>: a sum of gap sizes, all in the JVM."""
    add = lambda a, b: a + b
    gaps = lambda a: F.transform(a, lambda x, i: x - F.coalesce(F.get(a, i - 1), F.lit(0)))
    sizes = lambda a: F.aggregate(F.transform(gaps(a), lambda x: vbyte_size(x).cast("long")), F.lit(0).cast("long"), add)
    own = F.transform(postings, lambda p: vbyte_size(F.size(p["positions"])).cast("long") + sizes(p["positions"]))
    return vbyte_size(F.size(postings)).cast("long") + sizes(F.transform(postings, lambda p: p["doc_id"])) + F.aggregate(own, F.lit(0).cast("long"), add)
