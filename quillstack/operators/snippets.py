"""Where tokens stand in their texts, and the shortest passage of a text that has most words of a query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions import text as T

#: Tokens before and after the passage that a snippet shows.
AROUND = 5


def spans(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, pos, term, start, end) of the tokens of a text: from character ``start``, counted from 0, up to ``end``.

    What stands between tokens is cut out beside them; their lengths add up within a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = rows.select(id_col, F.transform(F.arrays_zip(T.originals_v2(text).alias("o"), T.gaps_v2(text).alias("g")), lambda x: F.struct(x["o"].alias("o"), F.char_length(x["g"]).alias("gap"))).alias("l"))
    each = cut.select(id_col, F.posexplode("l").alias("at", "t")).select(id_col, (F.col("at") + 1).alias("pos"), F.col("t.o").alias("o"), F.col("t.gap").alias("gap"))
    upto = F.sum(F.col("gap") + F.coalesce(F.char_length("o"), F.lit(0))).over(Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", upto.cast("int")).where(F.col("o").isNotNull())
    return each.select(id_col, "pos", F.lower("o").alias("term"), (F.col("end") - F.char_length("o")).alias("start"), "end")


def passages(found: DataFrame, words: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """(id_col, first, last, words): positions of the shortest passage with most of the words, of those the first one.

    From each place of a word, the next place of every word tells where a passage that begins there ends: windows over
    the places of the words alone.
    """
    words = list(dict.fromkeys(w.lower() for w in words))
    own = found.where(F.col("term").isin(words)).select(id_col, "pos", "term")
    ahead = Window.partitionBy(id_col).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    next_ = [F.min(F.when(F.col("term") == w, F.col("pos"))).over(ahead).alias(f"w{k}") for k, w in enumerate(words)]
    own = own.select(id_col, "pos", F.array_compact(F.array(*next_)).alias("at"))
    own = own.select(id_col, F.struct((-F.size("at")).alias("less"), (F.array_max("at") - F.col("pos")).alias("length"), F.col("pos").alias("first")).alias("p"))
    best = own.groupBy(id_col).agg(F.min("p").alias("p"))
    return best.select(id_col, F.col("p.first").alias("first"), (F.col("p.first") + F.col("p.length")).alias("last"), (-F.col("p.less")).alias("words"))


def snippets(rows: DataFrame, words: Sequence[str], around: int = AROUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, snippet, words): each text from ``around`` tokens before its passage to as many after, as it stands there.

    A text without any of the words has no row. Texts are read for their tokens and once more for the passage.
    """
    at = spans(rows, id_col, text_col)
    best = passages(at, words, id_col)
    near = at.join(best, id_col).where((F.col("pos") >= F.col("first") - around) & (F.col("pos") <= F.col("last") + around))
    ends = near.groupBy(id_col).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("words").alias("words"))
    return rows.select(id_col, text_col).join(ends, id_col).select(id_col, F.substring(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start")).alias("snippet"), "words")
