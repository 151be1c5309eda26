"""Papers to flat rows: ids, titles, abstracts, sections, authors, dates and DOIs, each by its chain of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions.text import first_non_empty, normalize_whitespace, sanitize

_TEXTS = "array<struct<text: string>>"


def _join(parts: Column, by: str) -> Column:
    """Texts that are not empty, joined; sections join with two line feeds, which white space makes one blank."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), by)


def paper_id(paper: Column, metadata_id: Column, file_name: Column) -> Column:
    return first_non_empty(paper, metadata_id, F.regexp_replace(file_name, r"\.[^.]*$", ""))


def title(metadata_title: Column, top: Column) -> Column:
    return sanitize(first_non_empty(metadata_title, top))


def json_texts(raw: Column) -> Column:
    """The texts of a JSON array of strings, or of objects with a text."""
    elements = F.from_json(raw, "array<string>")
    object_text = lambda x: F.get_json_object(x, "$.text")
    return F.transform(elements, lambda x: F.when(x.startswith("{"), object_text(x)).otherwise(x))


def abstract(raw: Column, body: Column) -> Column:
    """The abstract's parts; where they are blank, the body's texts of sections of that very name."""
    own = _join(json_texts(raw), " ")
    named = F.filter(body, lambda x: x["section"].isin("Abstract", "ABSTRACT", "abstract"))
    other = _join(F.transform(named, lambda x: x["text"]), " ")
    return normalize_whitespace(F.coalesce(F.nullif(F.trim(own), F.lit("")), other, F.lit("")))


def sections(body: Column) -> Column:
    """"Name: text" of each section in the order in which they come first; texts without a name are the Body."""
    named = lambda x: F.when(F.trim(F.coalesce(x["section"], F.lit(""))) == "", F.lit("Body")).otherwise(x["section"])
    full = F.transform(F.filter(body, lambda x: F.coalesce(x["text"], F.lit("")) != ""), lambda x: F.struct(named(x).alias("section"), x["text"].alias("text")))
    text_of = lambda s: F.array_join(F.transform(F.filter(full, lambda x: x["section"] == s), lambda x: x["text"]), "\n\n")
    each = F.transform(F.array_distinct(F.transform(full, lambda x: x["section"])), lambda s: sanitize(F.concat(s, F.lit(": "), text_of(s))))
    return F.coalesce(each, F.array().cast("array<string>"))


def authors(raw: Column) -> Column:
    """First, middle and last names; else a name or an address; authors that are strings as they are."""
    element = F.from_json(raw, "array<string>")
    at = lambda x, key: F.coalesce(F.get_json_object(x, f"$.{key}"), F.lit(""))
    middle = lambda x: F.coalesce(F.array_join(F.filter(F.from_json(F.get_json_object(x, "$.middle"), "array<string>"), lambda m: m != ""), " "), at(x, "middle"))

    def one(x: Column) -> Column:
        names = F.array_join(F.filter(F.array(at(x, "first"), middle(x), at(x, "last")), lambda p: p != ""), " ")
        return F.when(x.startswith("{"), first_non_empty(names, at(x, "name"), at(x, "email"))).otherwise(x)

    return sanitize(F.coalesce(F.array_join(F.filter(F.transform(element, one), lambda x: x != ""), "; "), F.lit("")))


def doi(own: Column, other_ids: Column, bib: Column) -> Column:
    """The paper's own, else its first other one, else that of the first reference that has one."""
    cited = F.get(F.filter(F.map_values(bib), lambda b: F.size(b["other_ids"]["DOI"]) > 0), 0)
    return first_non_empty(own, F.get(other_ids["DOI"], 0), F.get(cited["other_ids"]["DOI"], 0))


def pub_date(time: Column, date: Column, year: Column, bib: Column) -> Column:
    """The paper's own time, date or year; else the year of the first reference that has one."""
    cited = F.get(F.filter(F.map_values(bib), lambda b: b["year"].isNotNull() & (b["year"] != "")), 0)
    return first_non_empty(time, date, year, cited["year"])


def source(paper: Column) -> Column:
    return F.when(paper.startswith("PMC"), F.lit("pmc")).otherwise(F.lit("pdf"))


def extract(papers: DataFrame) -> DataFrame:
    """Extracted rows of papers as ``sources.readers.papers`` reads them; sections stay an array."""
    m = lambda name: F.col(f"metadata.{name}")
    body = F.coalesce("body_text", F.array().cast("array<struct<section: string, text: string>>"))
    found = papers.select(
        paper_id(F.col("paper_id"), m("paper_id"), F.col("orig_file")).alias("paper_id"),
        title(m("title"), F.col("title")).alias("title"),
        abstract(F.col("abstract"), body).alias("abstract"),
        sections(body).alias("sections"),
        authors(m("authors")).alias("authors"),
        pub_date(m("publish_time"), m("publish_date"), m("year"), F.col("bib_entries")).alias("pub_date"),
        doi(m("doi"), m("other_ids"), F.col("bib_entries")).alias("doi"),
        "orig_file",
    )
    return found.withColumns({"doi_or_id": first_non_empty(F.col("doi"), F.col("paper_id")), "source": source(F.col("paper_id"))}).drop("doi")
