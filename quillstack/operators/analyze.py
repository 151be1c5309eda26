"""Fields of documents to tokens: normalise, cut, number, filter, stem."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.functions.stem import stem_terms


@dataclass(frozen=True)
class CleanOptions:
    #: title, abstract, sections, body, in any order; a name that repeats is a field each time, an unknown one is none.
    fields: Sequence[str] = ("title", "abstract", "sections")
    #: None keeps all; terms, or a one-column table, which joins instead where it is large.
    stopwords: Sequence[str] | DataFrame | None = T.STOPWORDS
    stem: bool = False
    keep_original: bool = False
    remove_numbers: bool = False
    tokenizer: str = "v1"
    ascii_lower: bool = False
    dehyphenate: bool = False
    #: Tabs inside a text: blanks, or deleted as one tokenizer of old did.
    tabs_as_blanks: bool = True
    #: Canonical composition before all else; an Arrow function, so for corpora that need it only.
    nfc: bool = False


def normalized(text: Column, options: CleanOptions = CleanOptions()) -> Column:  # noqa: B008
    """A text as one line without control characters."""
    text = F.coalesce(text, F.lit(""))
    if options.nfc:
        text = T.nfc(text)
    if options.dehyphenate:
        text = T.dehyphenate(text)
    return T.line_ends_as_blanks(T.controls_out(text, options.tabs_as_blanks))


def terms(text: Column, options: CleanOptions = CleanOptions()) -> Column:  # noqa: B008
    """The terms of a text in order, before any filter."""
    text = normalized(text, options)
    return T.tokens_v2(text) if options.tokenizer == "v2" else T.tokens_v1(text, options.ascii_lower)


def numbered(text: Column, options: CleanOptions = CleanOptions()) -> Column:  # noqa: B008
    """array<struct<term, orig, pos>>; positions count from 1 before any filter, so that gaps stay."""
    if options.keep_original:
        return F.transform(T.originals_v2(normalized(text, options)), lambda t, i: F.struct(T.lower(t, options.ascii_lower).alias("term"), t.alias("orig"), (i + 1).alias("pos")))
    return F.transform(terms(text, options), lambda t, i: F.struct(t.alias("term"), F.lit(None).cast("string").alias("orig"), (i + 1).alias("pos")))


def fields(rows: DataFrame, options: CleanOptions = CleanOptions()) -> Column:  # noqa: B008
    """array<struct<name, text>> of the chosen fields, in the order chosen."""
    section_list = F.col("sections") if "sections" in rows.columns else F.lit(None).cast("array<string>")
    if dict(rows.dtypes).get("sections") == "string":
        section_list = T.split_and_trim(F.col("sections"))
    if "body" in rows.columns:
        section_list = F.coalesce(section_list, F.array("body"))
    split = F.transform(section_list, lambda s: F.struct(T.section_name(s).alias("name"), T.section_text(s).alias("text")))
    empty = F.array().cast("array<struct<name: string, text: string>>")
    found = [empty]
    for name in options.fields:
        if name in ("sections", "body"):
            found.append(F.coalesce(split, empty))
        elif name in ("title", "abstract") and name in rows.columns:
            found.append(F.array(F.struct(F.lit(name).alias("name"), F.coalesce(name, F.lit("")).alias("text"))))
    return F.concat(*found)


def all_tokens(rows: DataFrame, options: CleanOptions = CleanOptions()) -> Column:  # noqa: B008
    """array<struct<term, pos>> of all chosen fields, before any filter; positions restart in each field."""
    return F.flatten(F.transform(fields(rows, options), lambda f: T.numbered(terms(f["text"], options))))


def keep(tokens: DataFrame, options: CleanOptions = CleanOptions()) -> DataFrame:  # noqa: B008
    """Tokens without numbers and stopwords, which are compared before stemming; then stemmed."""
    if options.remove_numbers:
        tokens = tokens.where(~T.is_number(F.col("term")))
    if isinstance(options.stopwords, DataFrame):
        stop = options.stopwords.toDF("_stop")
        tokens = tokens.join(stop, F.col("term") == F.col("_stop"), "left_anti")
    elif options.stopwords:
        tokens = tokens.where(~F.col("term").isin(list(options.stopwords)))
    return stem_terms(tokens) if options.stem else tokens


def explode_tokens(rows: DataFrame, id_col: str, texts: Column, options: CleanOptions = CleanOptions()) -> DataFrame:  # noqa: B008
    """(id_col, field_idx, field, pos, term, orig) of array<struct<name, text>>, filtered and stemmed."""
    each = rows.select(id_col, F.posexplode(texts).alias("field_idx", "f"))
    found = each.select(id_col, "field_idx", F.col("f.name").alias("field"), F.explode(numbered(F.col("f.text"), options)).alias("t"))
    return keep(found.select(id_col, "field_idx", "field", "t.pos", "t.term", "t.orig"), options)


def clean(rows: DataFrame, options: CleanOptions = CleanOptions(), id_col: str = "paper_id") -> DataFrame:  # noqa: B008
    """Tokens of extracted rows."""
    return explode_tokens(rows, id_col, fields(rows, options), options)


def cleaned(rows: DataFrame, tokens: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """Nested rows (docid, fields, meta) of tokens and the extracted rows that they are of, for export."""
    token = F.struct("pos", "term", "orig")
    per = tokens.groupBy(id_col, "field_idx", "field").agg(F.transform(F.array_sort(F.collect_list(token)), lambda t: F.struct(t["term"], t["orig"], t["pos"])).alias("tokens"))
    nested = per.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("field_idx", F.col("field").alias("name"), "tokens"))).alias("f"))
    nested = nested.withColumn("fields", F.transform("f", lambda x: F.struct(x["name"], x["tokens"]))).drop("f")
    meta = F.struct("authors", "pub_date", "source").alias("meta")
    none = F.array().cast("array<struct<name: string, tokens: array<struct<term: string, orig: string, pos: int>>>>")
    return rows.select(id_col, meta).join(nested, id_col, "left").select(F.col(id_col).alias("docid"), F.coalesce("fields", none).alias("fields"), "meta")


def cleaned_rows(rows: DataFrame, options: CleanOptions = CleanOptions(), id_col: str = "paper_id") -> DataFrame:  # noqa: B008
    """``cleaned`` of ``clean``, each row's fields in the row, so that no token is shuffled; rows that share an id keep
    their own. Stemming and a table of stopwords need tokens as rows: for those it is ``cleaned``."""
    if options.stem or isinstance(options.stopwords, DataFrame):
        return cleaned(rows, clean(rows, options, id_col), id_col)
    wanted = lambda t: F.lit(True)
    if options.stopwords or options.remove_numbers:
        out = list(options.stopwords or [])
        wanted = lambda t: ~t["term"].isin(out) & (~T.is_number(t["term"]) if options.remove_numbers else F.lit(True))
    kept = lambda f: F.transform(F.filter(numbered(f["text"], options), wanted), lambda t: F.struct(t["term"], t["orig"], t["pos"]))
    each = F.transform(fields(rows, options), lambda f: F.struct(f["name"].alias("name"), kept(f).alias("tokens")))
    found = F.filter(each, lambda f: F.size(f["tokens"]) > 0)  # fields that a filter leaves without a token have none
    return rows.select(F.col(id_col).alias("docid"), found.alias("fields"), F.struct("authors", "pub_date", "source").alias("meta"))


def tokens_of_cleaned(rows: DataFrame) -> DataFrame:
    """Tokens of nested rows, as ``clean`` gives them; a position that is no integer is 0."""
    each = rows.select(F.col("docid").alias("paper_id"), F.posexplode("fields").alias("field_idx", "f"))
    flat = each.select("paper_id", "field_idx", F.col("f.name").alias("field"), F.explode("f.tokens").alias("t"))
    return flat.select("paper_id", "field_idx", "field", F.coalesce("t.pos", F.lit(0)).alias("pos"), "t.term", "t.orig").where(F.col("term").isNotNull())
