"""Fill-in-middle against a plain version, and rank and select against sums."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import infill


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_rank_and_select(n, share):
    flags = np.random.default_rng(n).random(n) < share
    bits = infill.Bits(flags)
    upto = np.append(0, np.cumsum(flags))
    assert (bits.rank(np.arange(n + 1)) == upto).all()
    assert (bits.select(np.arange(upto[-1])) == np.flatnonzero(flags)).all()


def plain(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in infill.MARKERS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = ["".join(rng.choice(["a", "\n", "é", "𝒳", " ", "<", "S", ">", "\r", "\x00", "word "]) for _ in range(rng.randrange(300))) for _ in range(200)]
    return [None, "", "\n", "a", "a\n", "\n\n\n", "has <P> in it", "é\nü\n𝒳", *some, "line é\n" * 150_000, "x" * 1_000_000, some[0], some[0]]


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 0), (0, 50)])
def test_transform_and_back(spark, texts, rate, spm):
    ids = [None if k == 4 else k // 2 for k in range(len(texts))]  # repeated ids, a null one
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, output string, n int").repartition(3)
    found = infill.transform(docs, rate, spm)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    shown = lambda i, *rest: str((i, *rest))
    assert sorted(shown(r["doc_id"], *tuple(r)[1:6]) for r in rows) == sorted(shown(i, *plain(i, t, rate, spm)) for i, t in zip(ids, texts, strict=True))
    assert sorted(r["back"] for r in rows) == sorted(t or "" for t in texts)


def test_slices_share_a_bitvector_by_bytes(monkeypatch, texts):
    import pyarrow as pa

    monkeypatch.setattr(infill, "BYTES", 500)
    held = pa.array([t or "" for t in texts])
    parts = list(infill._slices(held))
    assert parts[0][0] == 0 and parts[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert all(b - a == 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= 500 for a, b in parts)


def test_empty_and_markers(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.transform(docs).count() == 0
    with pytest.raises(ValueError):
        infill.transform(docs, markers=("<P>", "<P>", "<M>"))
