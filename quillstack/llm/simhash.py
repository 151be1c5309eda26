"""SimHash near-duplicates, found through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at fixed positions. Two fingerprints that differ in at most three bits agree in
at least five of the eight positional bytes: that is the guaranteed minimum. The index posts every distinct
fingerprint under each of the 70 choices of four (position, byte) terms. Within a posting list the shared positional
bytes of each pair are tallied; pairs under the minimum, such as those that share the list's four bytes only, go
uncompared, and the others are verified bit by bit. (Lists of single bytes hold 1/256 of all fingerprints each, so
tallying over those would grow with the square of the corpus.)

Links inside a list are kept as a spanning forest: connectivity is whole, and no list emits its pairs. A long list is
searched by flipping bits instead, which is linear in its members and finds the same links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import batched, materialize, named, partitions, rows
from quillstack.llm.components import connected_components

BYTES, WIDTH = 8, 64
#: Positional bytes of an index term, and how many terms a fingerprint has.
TERM, TERMS = 4, 70
SEED = 42
#: Lists with more members than this are compared one by one, those over the second by flipping bits.
SHORT, FLIP_OVER = 32, 4096
#: Postings of a task, about.
TASK_POSTINGS = 2_000_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and split at \x20 \x09-\x0D only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(WIDTH, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 32768):
        to = min(n, at + 32768)
        h = np.array([digest(whole[a : b - 1], seed) for a, b in zip(starts[at:to], last[at:to], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """(id, fp, row) of every row; fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType
    out = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("row", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        yield from batched(((i, signed(fingerprint(t, shingle, seed)), row) for i, t, row in rows(batches, "id", "text", "row")), out)

    if kind.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError(f"{id_col} must be an integer column")
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), named(row_col).alias("row"))
    return thin.mapInArrow(run, "id long, fp long, row string")


def _terms(fp: Column) -> list[Column]:
    """The 70 index terms of a fingerprint: four bytes, under the number of the choice of positions."""
    found = []
    for k, chosen in enumerate(combinations(range(BYTES), TERM)):
        term = F.lit(k).cast("long")
        for p in chosen:
            term = F.shiftleft(term, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")))
        found.append(term)
    return found


def shared_bytes(xor: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, from their exclusive or."""
    return (np.ascontiguousarray(xor).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def _root(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = up.get(y, y)
        x = y
    return x


def _join(up: dict[int, int], a: int, b: int) -> None:
    a, b = _root(up, a), _root(up, b)
    if a != b:
        up[max(a, b)] = min(a, b)


class Tally:
    """Pairs that met in posting lists, that reached the minimum of shared bytes, and that were verified."""

    met = reached = verified = 0

    def near(self, xor: np.ndarray, radius: int) -> np.ndarray:
        """Where pairs are within ``radius``: count filter first, then bit by bit."""
        some = np.flatnonzero(shared_bytes(xor) >= BYTES - radius)
        found = some[np.bitwise_count(xor[some]) <= radius]
        self.met, self.reached, self.verified = self.met + len(xor), self.reached + len(some), self.verified + len(found)
        return found


def _labels(run: np.ndarray, radius: int, tally: Tally) -> np.ndarray:
    """For the members of one long list: the index of the first member of each one's component within the list."""
    m = len(run)
    label = np.arange(m)
    if m <= FLIP_OVER:
        for i in range(m - 1):
            near = tally.near(run[i + 1 :] ^ run[i], radius) + i + 1
            if len(near):
                met = np.unique(np.append(label[near], label[i]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        return label
    order = np.argsort(run)
    known = run[order]
    free = [b for b in range(WIDTH) if np.any((run ^ run[0]) >> np.uint64(b) & np.uint64(1))]
    masks = [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(free, r)]
    changed = True
    while changed:
        before = label.copy()
        for mask in masks:
            want = run ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(known, want), m - 1)
            hit = np.flatnonzero(known[at] == want)
            other = order[at[hit]]
            np.minimum.at(label, label[hit], label[other])
            label = label[label]
        changed = not np.array_equal(before, label)
    return label


def _links(batches: Iterable[pa.RecordBatch], radius: int, tally: Tally | None = None) -> Iterator[pa.RecordBatch]:
    """The spanning forest of the links that the posting lists of one partition hold."""
    read = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not read:
        return
    key, fp = (np.concatenate([x[k] for x in read]) for k in (0, 1))
    del read
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order].view(np.uint64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(first, len(key)))
    up: dict[int, int] = {}
    tally = tally or Tally()
    short = np.repeat((length <= SHORT) & (length > 1), length)
    k, f = key[short], fp[short]
    for d in range(1, SHORT):  # members d apart in a short list, for all short lists at once
        pair = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else ()
        if not len(pair):
            break
        pair = pair[tally.near(f[pair + d] ^ f[pair], radius)]
        for a, b in np.unique(np.stack([f[:-d][pair], f[d:][pair]], axis=1), axis=0).tolist():
            _join(up, a, b)
    for at in np.flatnonzero(length > SHORT):
        run = fp[first[at] : first[at] + length[at]]
        for i, j in enumerate(_labels(run, radius, tally).tolist()):
            if i != j:
                _join(up, int(run[i]), int(run[j]))
    found = np.array([(x, _root(up, x)) for x in list(up)], dtype=np.uint64).reshape(-1, 2).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) that connect exactly what pairs of distinct fingerprints within ``radius`` bits connect.

    ``prints`` has a distinct column fp. ``radius`` is 3 at most: the guaranteed minimum is 8 - radius bytes, and it
    must be over the four that a list's members share, to tell anything.
    """
    if not 0 < radius < BYTES - TERM:
        raise ValueError("lists share four of eight bytes: radius must be 1 to 3")
    n = prints.count()
    posted = prints.select(F.explode(F.array(*_terms(F.col("fp")))).alias("key"), "fp")
    spread = posted.repartition(partitions(prints.sparkSession, TERMS * n, TASK_POSTINGS), "key")
    return spread.mapInArrow(lambda it: _links(it, radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """(id_col, fingerprint, component_id, component_size, component_root, row) for every row.

    Texts with the same fingerprint meet first, so that copies are one entry of the index. component_id is the
    smallest id reachable over links, itself included; component_root is the same for the rows of a component and for
    no other. A null or empty text has fingerprint 0 and is linked like any
    other; repeated rows and ids keep their rows; a null id stays null and counts in sizes only; an empty table gives
    an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, seed, row_col), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    roots = connected_components(links(classes.select("fp"), radius))
    placed = materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    whole = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size")), "whole")
    known = materialize(placed.select("fp", "root").join(whole, "root"), "known")
    return prints.join(known, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component_size",
        F.col("root").alias("component_root"),
        "row",
    )
