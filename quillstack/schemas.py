"""Schemas of the files and tables; readers never infer one."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:  # noqa: ANN003
    return StructType([StructField(n, t) for n, t in fields.items()])


_S, _I, _L = StringType(), IntegerType(), LongType()
_IDS = MapType(_S, ArrayType(_S))

#: A paper, one object a file. What may be of several kinds is read as its raw JSON text.
PAPER = _struct(
    paper_id=_S,
    metadata=_struct(paper_id=_S, title=_S, authors=_S, doi=_S, publish_time=_S, publish_date=_S, year=_S, other_ids=_IDS),
    title=_S,
    abstract=_S,
    body_text=ArrayType(_struct(section=_S, text=_S)),
    bib_entries=MapType(_S, _struct(year=_S, other_ids=_IDS)),
)
EXTRACTED = _struct(paper_id=_S, title=_S, abstract=_S, sections=ArrayType(_S), authors=_S, pub_date=_S, doi_or_id=_S, source=_S, orig_file=_S)
EXTRACTED_FIELDS = ("paper_id", "title", "abstract", "sections", "authors", "pub_date", "doi_or_id", "source")
TOKEN = _struct(term=_S, orig=_S, pos=_I)
CLEANED = _struct(docid=_S, fields=ArrayType(_struct(name=_S, tokens=ArrayType(TOKEN))), meta=_struct(authors=_S, pub_date=_S, source=_S))
FORWARD_BLOCK = _struct(docid=_S, postings=ArrayType(_struct(term=_S, positions=ArrayType(_I))))
FORWARD = _struct(docid=_S, postings=ArrayType(_struct(wordid=_I, freq=_I, positions=ArrayType(_I))))
LEXICON = _struct(word_id=_I, term=_S, doc_freq=_I, term_freq=_L, offset=_L, bytes=_L, skip_meta=_S, barrel_id=_I)
TERMS = _struct(term=_S, word_id=_I)
DOCID_MAP = _struct(orig_id=_S, doc_id=_I)
BARREL_METADATA = _struct(barrel_id=_I, start_term=_S, end_term=_S, offset=_L, size=_L, term_count=_I)
BARREL_BLOB = _struct(barrel_id=_I, content=BinaryType())
METRICS = _struct(query_id=_L, time_ms=DoubleType(), mem_kb=_L)
