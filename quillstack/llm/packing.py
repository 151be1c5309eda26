"""Best-fit packing by minimum bin slack, on the histogram of piece lengths.

A sequence holds ``capacity`` tokens, so pieces have at most ``capacity`` different lengths however large the corpus
is. The histogram of lengths is all that packing needs: for each bin a bitset subset-sum over the lengths that are
left finds the fullest feasible combination, which is taken away as often as the histogram still holds it. What
comes out is a short list of patterns; each piece then finds its place from its length and its rank among pieces of
that length, which two prefix sums give.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import batched, materialize, rows

CAPACITY, END = 1024, 2


def _encoder(vocabulary: str, ranks: str | None):
    """text -> ids. With ``ranks``, the same vocabulary as ranks of byte strings, ids come from the faster library."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    if ranks:
        import public_tokenizers
        import tiktoken

        added = {t.content: i for i, t in found.get_added_tokens_decoder().items()}
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=added)
        return lambda text: encoding.encode(text, allowed_special="all")
    return lambda text: found.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes the rest."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def fullest(left: dict[int, int], room: int, slack: int = 0) -> list[int]:
    """Lengths, as many of each as ``left`` has at most, with the greatest sum that is no more than ``room``.

    Of combinations within ``slack`` of that sum, the one with the greatest lengths: small ones are easier to place
    later.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    steps = []  # (length, how many at most, the sums that smaller lengths reach)
    for length in sorted(x for x in left if x <= room):
        most = min(left[length], room // length)
        steps.append((length, most, reach))
        many, part = most, 1
        while many > 0:  # multiplicities as powers of two
            part = min(part, many)
            reach |= reach << length * part & mask
            many, part = many - part, part * 2
    high = reach.bit_length() - 1
    low, taken = max(0, high - slack), []
    for length, most, smaller in reversed(steps):
        for n in range(min(most, high // length), -1, -1):
            least = max(0, low - n * length)
            if smaller >> least & (1 << (high - n * length - least + 1)) - 1:
                break
        taken += [length] * n
        low, high = max(0, low - n * length), high - n * length
    return taken


def _plan(histogram: dict[int, int], capacity: int, slack: int) -> list[tuple[int, list[int]]]:
    left, found = {k: n for k, n in histogram.items() if n}, []
    while left:
        head = max(left)
        rest = left | {head: left[head] - 1}
        pattern = [head, *fullest({k: n for k, n in rest.items() if n}, capacity - head, slack)]
        need = {k: pattern.count(k) for k in set(pattern)}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        found.append((times, pattern))
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of every bin pattern; each bin opens with the greatest length left.

    Filling early bins to the brim can leave nothing to fill later ones: the plan is made with a few allowances of
    slack (relaxed minimum bin slack), and the one with the fewest bins is taken.
    """
    total = sum(k * n for k, n in histogram.items())
    least = max(-(-total // capacity), sum(n for k, n in histogram.items() if 2 * k > capacity))
    best: list[tuple[int, list[int]]] = []
    for slack in (0, capacity // 64, capacity // 16, capacity // 4, capacity):
        found = _plan(histogram, capacity, slack)
        if not best or sum(t for t, _ in found) < sum(t for t, _ in best):
            best = found
        if sum(t for t, _ in best) == least:
            break
    return best


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), by length and rank: where pieces of a rank go."""
    found, ranks, sequence = [], {}, 0
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            found.append((length, first, times, sequence, offset))
            ranks[length] = first + times
            offset += length
        sequence += times
    return np.array(sorted(found), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of every row: (id, piece, start, length, ids_crc32, part, nth[, ids]).

    nth is a piece's rank among those of its length in its task, part the task; they hold only once written.
    """
    from pyspark import TaskContext

    fields = [(n, pa.int64() if n not in ("piece", "part") else pa.int32()) for n in ("id", "piece", "start", "length", "ids_crc32", "part", "nth")]
    out = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(vocabulary, ranks), TaskContext.get().partitionId(), [0] * (capacity + 1)

        def found() -> Iterator[tuple]:
            for i, text in rows(batches, "id", "text"):
                ids = np.array([*encode(text or ""), end], dtype="<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + n]
                    yield (i, k, start, n, zlib.crc32(own.tobytes()), part, seen[n], *([own.astype(np.int32)] if keep_ids else []))
                    seen[n] += 1

        yield from batched(found(), out)

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids
    return thin.mapInArrow(run, kinds)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Places every row's tokens: (id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A null text is an empty one, which is the end token alone. Repeated rows and ids are packed each; a null id
    stays null. A text of any length is cut into full pieces, the first of which may be shorter. The strings of
    the vocabulary's added tokens in a text are those tokens. An empty table gives an empty result. ``keep_ids`` adds the tokens, so that
    ``sequences`` can be built.
    """
    spark = docs.sparkSession
    found = materialize(pieces(docs, vocabulary, ranks, capacity, end, id_col, text_col, keep_ids), "pieces")
    per = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = materialize(per.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))), "lengths")
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    width = max(histogram.values(), default=0) + 1
    # not broadcast, however small its file is: runs of numbers are far larger in memory
    ranked = found.join(per.drop("n").hint("merge"), ["length", "part"]).withColumn("rank", F.col("ahead") + F.col("nth"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        t = table.value
        at = np.searchsorted(t[:, 0] * width + t[:, 1], length.to_numpy() * width + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 3] + rank.to_numpy() - t[at, 1], "offset": t[at, 4]})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from what ``pack`` gives with ``keep_ids``; a sequence has ``capacity`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
