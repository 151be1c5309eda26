"""Token counts without token ids: pieces are counted once for each distinct pre-token.

A pre-token is a stretch of text that no merge of the vocabulary leaves or enters, so the pieces of a text are those
of its pre-tokens. Documents are cut in batches: each batch has a table of its distinct pre-tokens, in the order of
their hashes, and for each document how often it has which. Tables meet by ranges of hashes, where each distinct
pre-token of all batches is counted once; the counts go back to the batches, are joined to the documents' frequencies
and summed. A table travels as one row for each range, not as one for each pre-token.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import materialize, partitions, rows

#: Bytes of text of a batch; a longer text is a batch alone.
BATCH_BYTES = 8 << 20
#: Bytes of pre-tokens of a range of hashes, about, and pre-tokens in a row of a batch's table as it is written.
RANGE_BYTES, TABLE_ROW = 8 << 20, 8192
_SPACE = "▁"
#: Comes back as it is from a vocabulary that leaves texts as they are.
_PROBE = "ﬁ  Ａé \n x"


class Pieces:
    """A vocabulary with byte pieces that normalizes nothing but for the blank it sets before a text.

    Which characters follow each other in a piece tells where texts can be cut. ASCII characters that are in no piece
    with another are pre-tokens alone. The others are of two classes that no piece mixes: ASCII characters that are no
    letters, with what stands beside them in pieces; and all that is left. A run of either, with the blanks before it,
    is a pre-token.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        texts = [library.id_to_piece(k) for k in range(library.get_piece_size()) if not (library.is_byte(k) or library.is_control(k) or library.is_unknown(k))]
        pairs = {pair for t in texts for pair in zip(t, t[1:], strict=False)}
        paired = {c for pair in pairs for c in pair}
        ascii_ = {chr(k) for k in range(128)} - {" "}
        alone = ascii_ - paired
        if any(b == _SPACE != a for a, b in pairs) or "\n" not in alone or library.decode(library.encode(_PROBE)) != _PROBE:
            raise ValueError("not a vocabulary whose pieces end at blanks and line feeds, and that leaves texts as they are")
        marks = {c for c in ascii_ & paired if not c.isalpha()}
        inner = {(a, b) for a, b in pairs if a != _SPACE}
        while more := {b if a in marks else a for a, b in inner if (a in marks) != (b in marks)}:
            marks |= more
        kind = lambda chars: "".join(map(re.escape, sorted(chars)))
        rest = f"[^ {_SPACE}{kind(alone | marks)}]+"
        self._pattern = re.compile(f"[{kind(alone)}]|[ {_SPACE}]*(?:{rest}{f'|[{kind(marks)}]+' if marks else ''})|[ {_SPACE}]+")
        self.encode = library.encode
        self.own = len(self.encode("\n"))

    def pre_tokens(self, text: str) -> list[str]:
        """With the blank that the vocabulary sets before a text that is not empty."""
        return self._pattern.findall(f" {text}") if text else []

    def count(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of pre-tokens in the middle of a text: a line feed before each takes the blank to itself."""
        return [len(ids) - self.own for ids in self.encode([f"\n{w}" for w in pre_tokens])]


@functools.lru_cache(maxsize=2)
def loaded(model: str) -> Pieces:
    """Once for each worker."""
    return Pieces(model)


_SPLIT = pa.schema([("batch", pa.string()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("gaps", pa.binary()), ("times", pa.binary()), ("first", pa.int32()), ("words", pa.string())])
_SPLIT_KINDS = "batch string, id long, n_bytes long, gaps binary, times binary, first int, words string"


def packed(numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Runs of numbers, the ends of which are given, as variable bytes: seven bits each, the lowest first."""
    v = numbers.astype(np.uint64)
    width = 1 + sum((v >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 9))
    to = np.cumsum(width)
    out = np.zeros(int(to[-1]) if len(to) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        own = np.flatnonzero(width > k)
        out[to[own] - width[own] + k] = (v[own] >> np.uint64(7 * k) & np.uint64(127)) | np.where(width[own] > k + 1, 128, 0).astype(np.uint64)
    cuts = np.append(0, to)[np.append(0, ends)]
    data = out.tobytes()
    return [data[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, ends of each row's numbers) of a column that ``packed`` filled."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
    final = held < 128
    to = np.flatnonzero(final)
    since = np.append(0, to[:-1] + 1)[: len(to)]
    found = np.zeros(len(to), np.int64)
    for k in range(int((to - since).max(initial=-1)) + 1):
        own = np.flatnonzero(since + k <= to)
        found[own] |= (held[since[own] + k] & 127).astype(np.int64) << 7 * k
    return found, np.append(0, np.cumsum(final))[at[1:] - at[0]]


def _joined(words: list[str]) -> str:
    """Pre-tokens in one string. A line feed is one alone, and none is empty."""
    return "\n".join("" if w == "\n" else w for w in words)


def _words(joined: str) -> list[str]:
    return [w or "\n" for w in joined.split("\n")]


def _hashed(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _rows(name: str, *found: tuple) -> pa.RecordBatch:
    columns = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(found)), *(pa.array(list(c), t.type) for c, t in zip(columns, list(_SPLIT)[1:], strict=True))], schema=_SPLIT)


def _batch(name: str, docs: list[tuple[int | None, int, np.ndarray, np.ndarray]], known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A batch's documents (id, n_bytes, gaps between the numbers of their pre-tokens, times), and its table (n_bytes, first, words)."""
    words = list(known)
    order = np.argsort(_hashed(words), kind="stable")
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    for k in range(0, len(docs), 256):
        some = docs[k : k + 256]
        lengths = np.array([len(d[2]) for d in some])
        ends, of = np.cumsum(lengths), np.repeat(np.arange(len(some)), lengths)
        which, times = number[np.concatenate([d[2] for d in some])], np.concatenate([d[3] for d in some])
        own = np.lexsort((which, of))
        gaps = np.diff(which[own], prepend=0)
        begins = (ends - lengths)[lengths > 0]
        gaps[begins] = which[own][begins]
        yield _rows(name, *((i, n, g, t, None, None) for (i, n, *_), g, t in zip(some, packed(gaps, ends), packed(times[own], ends), strict=True)))
    for k in range(0, len(words), TABLE_ROW):
        held = [words[x] for x in order[k : k + TABLE_ROW]]
        yield _rows(name, (None, sum(map(len, held)), None, None, k, _joined(held)))


def _split(batches: Iterable[pa.RecordBatch], model: str, batch_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    own, part, number, size = loaded(model), TaskContext.get().partitionId(), 0, 0
    docs: list[tuple] = []
    known: dict[str, int] = {}
    for i, text in rows(batches, "id", "text"):
        n = len(text.encode())
        if docs and size + n > batch_bytes:
            yield from _batch(f"{part}-{number}", docs, known)
            docs, known, number, size = [], {}, number + 1, 0
        counted = Counter(own.pre_tokens(text))
        which = np.fromiter((known.setdefault(w, len(known)) for w in counted), np.int64, len(counted))
        docs.append((i, n, which, np.fromiter(counted.values(), np.int64, len(counted))))
        size += n
    if docs:
        yield from _batch(f"{part}-{number}", docs, known)


def _ranged(batches: Iterable[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """(range, batch, first, words): rows of tables, cut at ranges of hashes, of which there are ``ranges``."""
    schema = pa.schema([("range", pa.int32()), ("batch", pa.string()), ("first", pa.int32()), ("words", pa.string())])
    for b in batches:
        held = []
        for name, first, joined in rows([b], "batch", "first", "words"):
            words = _words(joined)
            of = ((_hashed(words) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(words)]
            held += [(int(of[x]), name, first + x, _joined(words[x:y])) for x, y in zip(cuts, cuts[1:], strict=False)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _sums(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """(id, n_bytes, n_tokens) of a batch's documents, from how many pieces each of its pre-tokens has."""
    gaps, ends = unpacked(docs["gaps"].combine_chunks())
    times, _ = unpacked(docs["times"].combine_chunks())
    starts = np.append(0, ends)[:-1]
    upto = np.append(0, np.cumsum(gaps))
    which = upto[1:] - np.repeat(upto[starts], ends - starts)
    own, to = unpacked(counts["pieces"].combine_chunks())
    lengths = np.diff(np.append(0, to))
    at = np.repeat(counts["first"].to_numpy() - (to - lengths), lengths) + np.arange(len(own))
    pieces = np.zeros(len(own), np.int64)
    pieces[at] = own
    sums = np.append(0, np.cumsum(pieces[which] * times))
    return pa.table({"id": docs["id"], "n_bytes": docs["n_bytes"], "n_tokens": pa.array(sums[ends] - sums[starts], pa.int64())})


def count(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row: UTF-8 bytes, and pieces of the whole text by ``model``.

    A null text is an empty one, of no bytes and tokens; null ids stay null, repeated rows and ids count each; texts
    of any length are counted whole, in a batch of their own; over_limit says that there are over ``limit`` tokens.
    An empty table gives an empty result. The file at ``model`` is read by every task.

    What meets in one task is a batch's text at most, its documents' frequencies and its distinct pre-tokens, or what
    batches have of a range of hashes: a pre-token that all documents have is there once for each batch.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = materialize(thin.mapInArrow(lambda batches: _split(batches, model, batch_bytes), _SPLIT_KINDS), "split")
    tables = split.where("words IS NOT NULL")
    ranges = partitions(spark, tables.agg(F.sum("n_bytes")).first()[0] or 0, RANGE_BYTES)

    def counted(group: pa.Table) -> pa.Table:
        number: dict[str, int] = {}
        which, ends = [], []
        for joined in group["words"].to_pylist():
            which += [number.setdefault(w, len(number)) for w in _words(joined)]
            ends.append(len(which))
        pieces = np.array(loaded(model).count(list(number)), np.int64)[which]  # each is counted once
        return pa.table({"of": group["batch"], "first": group["first"], "pieces": pa.array(packed(pieces, np.array(ends)), pa.binary())})

    cut = tables.select("batch", "first", "words").mapInArrow(lambda batches: _ranged(batches, ranges), "range int, batch string, first int, words string")
    pieces = cut.groupBy("range").applyInArrow(counted, "of string, first int, pieces binary")
    own = split.where("words IS NULL").select("batch", "id", "n_bytes", "gaps", "times")
    found = own.groupBy("batch").cogroup(pieces.groupBy("of")).applyInArrow(_sums, "id long, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
