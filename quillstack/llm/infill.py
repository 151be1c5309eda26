"""Fill-in-middle transformation, with cuts at lines by rank and select on packed bitvectors.

The texts of a few documents lie in one buffer. A bitvector has a one where a byte ends a line, packed in words, with
a directory of the ones before each block. The ones between a document's two ends are its number of lines n; two ranks
are drawn from 0 to n, and select on them gives the bytes to cut at. A second bitvector, of the bytes that begin a code
point, gives lengths in code points by rank. No text is split into a list of lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ("<P>", "<S>", "<M>")
#: Rows, and bytes of text, that share a bitvector; a longer text has one alone.
ROWS, BYTES = 256, 8 << 20
_NEWLINE = 10


class Bits:
    """A packed bitvector with a directory: the ones before each block of ``BLOCK`` words of 64 bits."""

    BLOCK = 8

    def __init__(self, flags: np.ndarray) -> None:
        packed = np.packbits(flags, bitorder="little")
        step = 8 * self.BLOCK
        self.words = np.zeros((len(packed) // step + 1) * self.BLOCK, "<u8")  # a spare block, for the position at the end
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).reshape(-1, self.BLOCK).sum(1, dtype=np.int64)
        self.ahead = np.append(0, np.cumsum(ones))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each of some positions."""
        word = at // 64
        block = word // self.BLOCK
        own = self.words.reshape(-1, self.BLOCK)[block]
        place = word % self.BLOCK
        whole = np.where(np.arange(self.BLOCK) < place[:, None], np.bitwise_count(own), 0).sum(1, dtype=np.int64)
        part = own[np.arange(len(at)), place] & ((np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1))
        return self.ahead[block] + whole + np.bitwise_count(part)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Positions of ones by their number, from 0."""
        block = np.searchsorted(self.ahead, nth, side="right") - 1
        own = self.words.reshape(-1, self.BLOCK)[block]
        upto = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.int64)
        rest = nth - self.ahead[block]
        place = (upto <= rest[:, None]).sum(1)
        rest -= np.where(place > 0, upto[np.arange(len(nth)), place - 1], 0)
        word = np.ascontiguousarray(own[np.arange(len(nth)), place])
        bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * self.BLOCK + place) * 64 + (np.cumsum(bits, axis=1) <= rest[:, None]).sum(1)


def line_ends(data: np.ndarray, offsets: np.ndarray) -> Bits:
    """Of texts in one buffer: ones at line feeds, and at the last byte of each text that is not empty."""
    flags = data == _NEWLINE
    last = offsets[1:][np.diff(offsets) > 0] - 1
    flags[last] = True
    return Bits(flags)


def draws(seed: int, i: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for an id; a null id is an empty one."""
    found = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    return tuple(int(found[k : k + 8], 16) for k in (0, 8, 16, 24))  # type: ignore[return-value]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings without nulls; offsets begin at 0."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows, of ROWS rows and about BYTES bytes at most."""
    sizes = np.diff(_buffer(texts)[1])
    start = held = 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and (k - start >= ROWS or held + n > BYTES):
            yield start, k
            start, held = k, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


_OUT = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def infilled(ids: Sequence[int | None], texts: pa.Array, rate: int, spm: int, seed: int, markers: Sequence[str]) -> pa.RecordBatch:
    """The rows of some texts without nulls, which share one bitvector."""
    data, offsets = _buffer(texts)
    starts, ends = offsets[:-1], offsets[1:]
    lines = line_ends(data, offsets)
    ahead = lines.rank(starts)
    n = lines.rank(ends) - ahead
    h = np.array([draws(seed, i) for i in ids], dtype=np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = np.repeat(starts[:, None], 2, axis=1)
    cut = cuts > 0
    at[cut] = lines.select((ahead[:, None] + cuts - 1)[cut]) + 1
    chars = Bits((data & 0xC0) != 0x80)
    upto = chars.rank(np.column_stack([starts, at]).ravel()).reshape(-1, 3)
    p, s, m = (x.encode() for x in markers)
    raw = data.tobytes()
    forms, outputs = [], []
    for k, (start, end, one, two) in enumerate(zip(starts.tolist(), ends.tolist(), *at.T.tolist(), strict=True)):
        if start == end or h[k, 2] % 100 >= rate or any(raw.find(x, start, end) >= 0 for x in (p, s, m)):
            forms.append("plain")
            outputs.append(raw[start:end])
            continue
        prefix, middle, suffix = raw[start:one], raw[one:two], raw[two:end]
        forms.append("spm" if h[k, 3] % 100 < spm else "psm")
        outputs.append(b"".join((s, suffix, p, prefix, m, middle) if forms[-1] == "spm" else (p, prefix, s, suffix, m, middle)))
    plain = np.array([f == "plain" for f in forms], dtype=bool)
    sizes = [pa.array(upto[:, k + 1] - upto[:, k], pa.int64(), mask=plain) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *sizes, pa.array(outputs, pa.binary()).cast(pa.string())], schema=_OUT)


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, markers: Sequence[str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) for every row.

    n is a text's number of lines. ``rate`` of a hundred texts are cut into prefix, middle and suffix at two of the
    n + 1 places around lines, of which ``spm`` of a hundred have their suffix first; numbers come from the id and
    ``seed`` alone, so that a rerun gives the same. A text that is empty or holds a marker stays plain, with null
    lengths; lengths are in code points. A null text is an empty one, a null id draws as an empty one and stays null,
    repeated rows give equal rows. Texts of any length are cut whole. An empty table gives an empty result.
    """
    if len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _slices(texts):
                yield infilled(ids.slice(a, b - a).to_pylist(), texts.slice(a, b - a), rate, spm, seed, markers)

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = thin.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output and its form tell of.

    Each marker stands once in an output that is not plain, as none is in its text and markers in angle brackets
    cannot begin in a text's end.
    """
    p, s, m = markers
    behind = F.substring_index(output, m, -1)
    ahead = F.substring_index(output, m, 1)
    first = lambda mark, then: F.substring(F.substring_index(ahead, then, 1), F.lit(len(mark) + 1), F.char_length(output))
    return F.when(form == "psm", F.concat(first(p, s), behind, F.substring_index(ahead, s, -1))).when(form == "spm", F.concat(F.substring_index(ahead, p, -1), behind, first(s, p))).otherwise(output)
