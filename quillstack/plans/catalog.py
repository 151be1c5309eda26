"""The query catalogue: each query by name, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack import schemas
from quillstack.functions import codec
from quillstack.functions import text as T
from quillstack.functions.stem import STEP_2, STEP_3, STEP_4, porter_stem, stem_terms
from quillstack.operators import analyze, barrels, extract, index, metrics, order, search, suggest
from quillstack.sources.shared import written
from quillstack.sources.spread import pieces, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- tables and their SQL ---------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    keys = {"documents": ["doc_id"], "pages": ["page_id"]}.get(name, [])
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *keys)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def token_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, l): the terms of a text column in order."""
    return docs.select(id_col, T.tokens_v1(F.col(text_col)).alias("l"))


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, term) of a text column."""
    return docs.select(id_col, F.posexplode(T.tokens_v1(F.col(text_col))).alias("at", "term")).select(id_col, (F.col("at") + 1).alias("pos"), "term")


def posted(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) of documents."""
    return index.document_postings(docs, T.numbered(T.tokens_v1(F.col("text")))).drop("dl")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, doc_freq, term_freq, bytes) of documents: how long encoded lists are."""
    return index.list_bytes_of_documents(documents(spark, sf_dir).select("doc_id", "text"), T.numbered(T.tokens_v1(F.col("text"))))


def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, block, postings) of documents."""
    return index.lists_of_documents(documents(spark, sf_dir).select("doc_id", "text"), T.numbered(T.tokens_v1(F.col("text"))))


def sized_token_rows(docs: DataFrame) -> DataFrame:
    """The same, with dl: how many there are in the document."""
    cut = docs.select("doc_id", T.tokens_v1(F.col("text")).alias("l"))
    found = cut.select("doc_id", F.size("l").cast("long").alias("dl"), F.posexplode("l").alias("at", "term"))
    return found.select("doc_id", (F.col("at") + 1).alias("pos"), "term", "dl")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.counts(token_rows(documents(spark, sf_dir)))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, doc_freq, term_freq). A document's term counts need no table of postings: both sums combine early."""
    return index.lexicon(counted(spark, sf_dir))


def whole_index(spark: SparkSession, sf_dir: str, positions: bool = False) -> index.Index:
    docs = documents(spark, sf_dir)
    sized = docs.select("doc_id", F.size(T.tokens_v1(F.col("text"))).cast("long").alias("dl"))
    found = (index.postings if positions else index.counts)(sized_token_rows(docs))
    return index.Index(docs.select("doc_id", F.col("doc_id").cast("string").alias("orig_id")), found, index.lexicon(found), sized, derived=True)


def _tok(text: str, lower: bool = True) -> str:
    inner = f"lower({text})" if lower else text
    for _ in range(2):
        inner = f"regexp_replace({inner}, '(\\p{{L}})''(\\p{{L}})', '\\1' || chr(57344) || '\\2', 'g')"
    return f"list_transform(regexp_extract_all({inner}, '[\\p{{L}}\\p{{N}}' || chr(57344) || ']+'), lambda z: replace(z, chr(57344), ''''))"


TOKENS = f"l AS (SELECT doc_id, {_tok('text')} AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM l)"
COUNTS = f"{TOKENS}, p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL)"
LEXICON = f"{COUNTS}, x AS (SELECT term, count(*)::INT AS doc_freq, sum(tf)::BIGINT AS term_freq FROM p GROUP BY term)"
LENGTHS = "dl AS (SELECT doc_id, len(l) AS dl FROM l), c AS (SELECT count(*) AS n, sum(dl) AS total_len, sum(dl) / count(*)::DOUBLE AS avgdl FROM dl)"
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOPWORDS)


# -- text -------------------------------------------------------------------------------------------------------------

#: Texts that the documents have no case of: apostrophes, control characters, hyphens at line ends.
SAMPLES = (
    (1, "Don't 'tis rock'n'roll a'b'c'd x'1 dogs' can''t"),
    (2, "state-of-the-art O’Neill’s it’s"),
    (3, "a\tb\nc\rd\x01e"),
    (4, "  two \t\t words\x0b\x0chere \r\n"),
    (5, "hyphen-\nated and re-\r\njoined"),
    (6, "Ω Δ2 Ünïcode ÉCOLE 2020 ٣"),
    (7, ""),
    (8, "A | B |  | C: d | E"),
)


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLES), "id int, s string")


def _sql_text(s: str) -> str:
    return "||".join("'" + p.replace("'", "''") + "'" if p.isprintable() else f"chr({ord(p)})" for p in _runs(s)) or "''"


def _runs(s: str) -> list[str]:
    found: list[str] = []
    for c in s:
        if found and c.isprintable() and found[-1].isprintable():
            found[-1] += c
        else:
            found.append(c)
    return found


SAMPLES_SQL = "(VALUES " + ", ".join(f"({i}, {_sql_text(s)})" for i, s in SAMPLES) + ") v(id, s)"


@query(f"WITH {TOKENS} SELECT doc_id, pos::INT AS pos, term FROM t")
def tokenize_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(documents(spark, sf_dir))


@query(f"SELECT id, array_to_string({_tok('s')}, ' ') AS tokens FROM {SAMPLES_SQL}")
def tokenize_v1_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark).select("id", F.array_join(T.tokens_v1(F.col("s")), " ").alias("tokens"))


_V2 = "s"
for _mark, _code in (("''", 57344), ("’", 57345)) * 2:
    _V2 = f"regexp_replace({_V2}, '(\\p{{L}}){_mark}(\\p{{L}})', '\\1' || chr({_code}) || '\\2', 'g')"
_V2 = f"list_transform(regexp_extract_all({_V2}, '[\\p{{L}}\\p{{N}}' || chr(57344) || chr(57345) || ']+'), lambda z: replace(replace(z, chr(57344), ''''), chr(57345), '’'))"


#: All documents, and the samples under negative ids.
BOTH_SQL = f"(SELECT doc_id AS id, text AS s FROM documents UNION ALL SELECT -id, s FROM {SAMPLES_SQL}) w"


def documents_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("s")).union(samples(spark).select((-F.col("id")).cast("long"), "s"))


@query(f"SELECT id, array_to_string({_V2}, ' ') AS originals, lower(array_to_string({_V2}, ' ')) AS tokens FROM {BOTH_SQL}")
def tokenize_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = documents_and_samples(spark, sf_dir)
    return both.select("id", F.array_join(T.originals_v2(F.col("s")), " ").alias("originals"), F.array_join(T.tokens_v2(F.col("s")), " ").alias("tokens"))


@query(f"SELECT doc_id, len({_V2.replace('regexp_replace(s,', 'regexp_replace(text,')}) AS n_tokens FROM documents")
def tokenize_v2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.size(T.tokens_v2(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT id, array_to_string(regexp_extract_all(lower(s), '[a-z0-9'']+'), ' ') AS tokens FROM {BOTH_SQL}")
def query_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_and_samples(spark, sf_dir).select("id", F.array_join(T.query_tokens(F.col("s")), " ").alias("tokens"))


_NORMAL = "trim(regexp_replace(replace({0}, chr(13), ''), '[ \\t\\n\\x0B\\f]+', ' ', 'g'), ' ')"
_SANE = _NORMAL.format("translate({0}, chr(9) || chr(10) || chr(13), '   ')")


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS text FROM documents UNION ALL SELECT -id, {_NORMAL.format('s')} FROM {SAMPLES_SQL}")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = documents(spark, sf_dir).select("doc_id", "text").union(samples(spark).select((-F.col("id")).cast("long"), "s"))
    return both.select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_SANE.format('text')} AS text FROM documents UNION ALL SELECT -id, {_SANE.format('s')} FROM {SAMPLES_SQL}")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = documents(spark, sf_dir).select("doc_id", "text").union(samples(spark).select((-F.col("id")).cast("long"), "s"))
    return both.select("doc_id", T.sanitize(F.col("text")).alias("text"))


_CONTROLS = "regexp_replace({0}, '[\\x00-\\x1F]', '', 'g')"


@query(
    f"SELECT id, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS trimmed, {_CONTROLS.format('replace(s, chr(10), chr(32))')} AS tabs_deleted, "
    f"{_CONTROLS.format('translate(s, chr(10) || chr(9), chr(32) || chr(32))')} AS tabs_blank, regexp_replace(s, '-[\\r\\n]+', '', 'g') AS joined, "
    f"translate(s, chr(10) || chr(13) || chr(9), '   ') AS one_line FROM {BOTH_SQL}"
)
def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return documents_and_samples(spark, sf_dir).select(
        "id",
        T.trim_edges(s).alias("trimmed"),
        T.controls_out(s, tabs_as_blanks=False).alias("tabs_deleted"),
        T.controls_out(s).alias("tabs_blank"),
        T.dehyphenate(s).alias("joined"),
        T.line_ends_as_blanks(s).alias("one_line"),
    )


@query("SELECT doc_id, nfc_normalize(text) AS text, nfc_normalize(replace(lang, 'e', 'e' || chr(769))) AS composed FROM documents")
def nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.nfc("text").alias("text"), T.nfc(F.replace("lang", F.lit("e"), F.lit("e\u0301"))).alias("composed"))


@query(f"SELECT doc_id, translate(text, '{T.UPPER}', '{T.LOWER}') AS ascii_lower, lower(text) AS unicode_lower FROM documents")
def lowercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.lower(F.col("text"), True).alias("ascii_lower"), T.lower(F.col("text")).alias("unicode_lower"))


@query(f"WITH {TOKENS} SELECT doc_id, pos::INT AS pos, term FROM t WHERE term NOT IN ({STOP_SQL})")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.keep(token_rows(documents(spark, sf_dir)))


@query(f"WITH {TOKENS} SELECT doc_id, pos::INT AS pos, term FROM t WHERE term NOT IN (SELECT lower(p_name) FROM part UNION SELECT unnest([{STOP_SQL}]))")
def stopword_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(w,) for w in T.STOPWORDS], "term string")
    stop = table(spark, sf_dir, "part").select(F.lower("p_name").alias("term")).union(listed).distinct()
    return analyze.keep(token_rows(documents(spark, sf_dir)), analyze.CleanOptions(stopwords=stop))


@query(f"WITH {TOKENS} SELECT doc_id, pos::INT AS pos, term FROM t WHERE NOT regexp_full_match(term, '\\p{{Nd}}+')")
def remove_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.keep(token_rows(documents(spark, sf_dir)), analyze.CleanOptions(stopwords=None, remove_numbers=True))


_PART = "(SELECT doc_id, unnest(list_filter(list_transform(string_split(concat(lang, ': ', text), ' | '), lambda z: trim(z, ' ' || chr(9) || chr(10) || chr(13))), lambda z: z <> '')) AS s FROM documents)"


@query(
    f"SELECT doc_id, CASE WHEN strpos(s, ':') BETWEEN 1 AND 50 THEN substr(s, 1, strpos(s, ':') - 1) ELSE 'body' END AS name, "
    f"CASE WHEN strpos(s, ':') BETWEEN 1 AND 50 THEN substr(s, strpos(s, ':') + 1) ELSE s END AS section FROM {_PART}"
)
def field_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = documents(spark, sf_dir).select("doc_id", F.explode(T.split_and_trim(F.concat("lang", F.lit(": "), "text"))).alias("s"))
    return parts.select("doc_id", T.section_name(F.col("s")).alias("name"), T.section_text(F.col("s")).alias("section"))


@query("SELECT doc_id, array_to_string(" + _PART.removeprefix("(SELECT doc_id, unnest(").replace(") AS s FROM documents)", "") + ", '||') AS parts FROM documents")
def split_and_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.split_and_trim(F.concat("lang", F.lit(": "), "text")), "||").alias("parts"))


_FIELD_SQL = f"WITH f AS (SELECT doc_id, 0 AS field_idx, 'title' AS field, split_part(text, chr(10), 1) AS s FROM documents UNION ALL SELECT doc_id, 1, CASE WHEN strpos(text, ':') BETWEEN 1 AND 50 THEN substr(text, 1, strpos(text, ':') - 1) ELSE 'body' END, CASE WHEN strpos(text, ':') BETWEEN 1 AND 50 THEN substr(text, strpos(text, ':') + 1) ELSE text END FROM documents), l AS (SELECT doc_id, field_idx, field, {_tok('s')} AS l FROM f), t AS (SELECT doc_id, field_idx, field, unnest(l) AS term, generate_subscripts(l, 1)::INT AS pos FROM l)"


def fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows with a title, which is the first line, and a body."""
    return documents(spark, sf_dir).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"))


@query(f"{_FIELD_SQL} SELECT doc_id, field_idx, field, pos, term FROM t WHERE term NOT IN ({STOP_SQL})")
def field_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.clean(fielded(spark, sf_dir), analyze.CleanOptions(fields=("title", "body")), "doc_id").drop("orig")


@query(f"{_FIELD_SQL} SELECT term, doc_id, count(*)::INT AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM t GROUP BY term, doc_id")
def field_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, options = fielded(spark, sf_dir), analyze.CleanOptions(fields=("title", "body"), stopwords=None)
    found = index.document_postings(rows, analyze.all_tokens(rows, options)).drop("dl")
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(f"WITH {TOKENS} SELECT role, count(*) AS tokens, count(DISTINCT term) AS terms FROM (SELECT role, unnest({_tok('text')}) AS term FROM conversations) GROUP BY role")
def conversation_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("role", F.explode(T.tokens_v1(F.col("text"))).alias("term"))
    return rows.groupBy("role").agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("terms"))


@query(f"SELECT term, count(DISTINCT page_id)::INT AS doc_freq, count(*) AS term_freq FROM (SELECT page_id, unnest({_tok('url')}) AS term FROM pages) GROUP BY term")
def page_url_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lexicon(index.counts(token_rows(table(spark, sf_dir, "pages"), "page_id", "url"), "page_id"), "page_id")


#: Words and their published stems.
STEMS = {
    "is": "is", "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "hopefulness": "hope", "formative": "form", "electrical": "electr", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "adoption": "adopt", "defensible": "defens", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "viruses": "virus", "virus": "viru", "person's": "person'", "2020": "2020",
}


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(w.replace("'", "''"), s.replace("'", "''")) for w, s in STEMS.items()) + ") v(term, stem)")
def porter_stem_goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STEMS], "term string").select("term", porter_stem("term").alias("stem"))


def _shape_sql(x: str) -> str:
    """C and V for consonants and vowels; a y is a vowel after a consonant. Runs of up to six y."""
    found = f"regexp_replace(regexp_replace({x}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    found = f"regexp_replace({found}, '^y', 'C')"
    for _ in range(3):
        found = f"replace(replace({found}, 'Cy', 'CV'), 'Vy', 'VC')"
    return found


def _measure_sql(x: str) -> str:
    return f"len(regexp_extract_all({_shape_sql(x)}, 'V+C+'))"


def _cut_sql(n: int, x: str = "w") -> str:
    return f"left({x}, length({x}) - {n})"


def _strip_sql(rules: Iterable[tuple[str, str]], least: int) -> str:
    """The first suffix that a word ends with decides."""
    cases = []
    for suffix, instead in rules:
        fits = f"{_measure_sql(_cut_sql(len(suffix)))} > {least}"
        fits += f" AND regexp_matches({_cut_sql(3)}, '[st]$')" if suffix == "ion" else ""
        cases.append(f"WHEN suffix(w, '{suffix}') THEN CASE WHEN {fits} THEN {_cut_sql(len(suffix))} || '{instead}' ELSE w END")
    return f"CASE WHEN strlen(term) <= 2 THEN w {' '.join(cases)} ELSE w END"


#: Ends in consonant, vowel, consonant of one byte each, the last none of w, x and y.
_SHORT_SQL = "({shape} LIKE '%CVC' AND regexp_matches({x}, '[\x00-\x7F]$') AND NOT regexp_matches({x}, '[wxy]$'))"


def stems_sql(terms: str) -> str:
    """CTEs up to ``stems`` (term, w): the published steps as SQL, of (term) rows."""
    short = lambda x: _SHORT_SQL.format(shape=_shape_sql(x), x=x)
    double = f"(length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right({_shape_sql('w')}, 1) = 'C' AND NOT regexp_matches(w, '[lsz]$'))"
    whole = "strlen(term) <= 2"
    return (
        f"k0 AS (SELECT term, CASE WHEN {whole} THEN term WHEN suffix(term, 'sses') OR suffix(term, 'ies') THEN {_cut_sql(2, 'term')} WHEN suffix(term, 's') AND NOT suffix(term, 'ss') THEN {_cut_sql(1, 'term')} ELSE term END AS w FROM {terms}), "
        f"k1 AS (SELECT term, w, CASE WHEN {whole} OR suffix(w, 'eed') THEN 0 WHEN suffix(w, 'ed') AND contains({_shape_sql(_cut_sql(2))}, 'V') THEN 2 WHEN suffix(w, 'ing') AND contains({_shape_sql(_cut_sql(3))}, 'V') THEN 3 ELSE 0 END AS cut FROM k0), "
        f"k2 AS (SELECT term, cut, CASE WHEN {whole} THEN w WHEN suffix(w, 'eed') THEN CASE WHEN {_measure_sql(_cut_sql(3))} > 0 THEN {_cut_sql(1)} ELSE w END ELSE left(w, length(w) - cut) END AS w FROM k1), "
        f"k3 AS (SELECT term, CASE WHEN cut = 0 THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN {double} THEN {_cut_sql(1)} WHEN {_measure_sql('w')} = 1 AND {short('w')} THEN w || 'e' ELSE w END AS w FROM k2), "
        f"k4 AS (SELECT term, CASE WHEN NOT {whole} AND suffix(w, 'y') AND contains({_shape_sql(_cut_sql(1))}, 'V') THEN {_cut_sql(1)} || 'i' ELSE w END AS w FROM k3), "
        f"k5 AS (SELECT term, {_strip_sql(STEP_2, 0)} AS w FROM k4), k6 AS (SELECT term, {_strip_sql(STEP_3, 0)} AS w FROM k5), k7 AS (SELECT term, {_strip_sql([(x, '') for x in STEP_4], 1)} AS w FROM k6), "
        f"k8 AS (SELECT term, CASE WHEN NOT {whole} AND suffix(w, 'e') AND ({_measure_sql(_cut_sql(1))} > 1 OR ({_measure_sql(_cut_sql(1))} = 1 AND NOT {short(_cut_sql(1))})) THEN {_cut_sql(1)} ELSE w END AS w FROM k7), "
        f"stems AS (SELECT term, CASE WHEN NOT {whole} AND suffix(w, 'll') AND {_measure_sql('w')} > 1 THEN {_cut_sql(1)} ELSE w END AS w FROM k8)"
    )


#: All terms of the documents, and the published words, whose rules the documents may have no case of.
_STEMMED = "(SELECT DISTINCT term FROM t UNION SELECT * FROM (VALUES " + ", ".join("('{}')".format(w.replace("'", "''")) for w in STEMS) + ") v(term))"


@query(f"WITH {TOKENS}, {stems_sql(_STEMMED)} SELECT term, w AS stem FROM stems")
def porter_stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(w,) for w in STEMS], "term string")
    terms = token_rows(documents(spark, sf_dir)).select("term").union(listed).distinct()
    return terms.select("term", porter_stem("term").alias("stem"))


@query(f"WITH {TOKENS}, {stems_sql('(SELECT DISTINCT term FROM t)')} SELECT doc_id, pos::INT AS pos, w AS term FROM t JOIN stems USING (term)")
def stemmed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stem_terms(token_rows(documents(spark, sf_dir)))


# -- extraction -------------------------------------------------------------------------------------------------------


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers, in JSON as files have it, parsed by the schema of papers."""
    doc, third = F.col("doc_id"), F.col("doc_id") % 3
    lines = F.split("text", "\n")
    body = F.transform(lines, lambda x, i: F.struct(F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, F.lit("")).otherwise(F.col("source")).alias("section"), x.alias("text")))
    author = F.to_json(F.struct(F.col("lang").alias("first"), F.array(F.lit("M."), F.lit("")).alias("middle"), F.col("source").alias("last")))
    authors = F.when(third == 0, F.concat(F.lit("["), author, F.lit(',{"name":"Only Name"},"Plain Author"]'))).when(third == 1, '[{"first":"","last":"","email":"a@b.c"}]')
    bib = F.when(
        doc % 4 == 0,
        F.concat(F.lit('{"BIBREF0":{"year":null,"other_ids":{"DOI":[]}},"BIBREF1":{"year":'), (doc % 100 + 1900).cast("string"), F.lit(',"other_ids":{"DOI":["10.1/'), doc.cast("string"), F.lit('"]}}}')),
    ).otherwise("{}")
    abstract = F.when(third == 0, F.concat(F.lit("["), F.to_json(F.struct(F.get(lines, 0).alias("text"))), F.lit(',"and a string"]'))).otherwise("[]")
    raw = F.concat(
        F.lit('{"metadata":'),
        F.to_json(F.struct(F.when(doc % 2 == 0, F.concat(F.get(lines, 0), F.lit("\tX"))).otherwise("").alias("title"), F.when(doc % 5 == 0, F.concat(F.lit("10.9/"), doc)).alias("doi"), F.when(doc % 7 == 0, F.lit("2021-03-04")).alias("publish_time"))),
        F.lit(',"paper_id":'),
        F.when(doc % 2 == 0, F.concat(F.lit('"PMC'), doc, F.lit('"'))).otherwise('""'),
        F.lit(',"title":"Top Title","bib_entries":'),
        bib,
        F.lit(',"abstract":'),
        abstract,
        F.lit(',"body_text":'),
        F.to_json(body),
        F.lit("}"),
    )
    parsed = documents(spark, sf_dir).select("doc_id", F.from_json(raw, schemas.PAPER).alias("p"), authors.alias("authors"), F.concat(F.lit("f"), doc, F.lit(".xml.json")).alias("orig_file"))
    return parsed.select("doc_id", "p.*", "authors", "orig_file").withColumn("metadata", F.col("metadata").withField("authors", F.col("authors"))).drop("authors")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir)
    return extract.extract(rows).withColumn("doc_id", F.regexp_extract("orig_file", r"(\d+)", 1).cast("long"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'PMC' || doc_id ELSE 'f' || doc_id || '.xml' END AS paper_id, CASE WHEN doc_id % 2 = 0 THEN 'pmc' ELSE 'pdf' END AS source FROM documents")
def extract_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select("doc_id", "paper_id", "source")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_SANE.format('split_part(text, chr(10), 1) || chr(9) || chr(88)')} ELSE 'Top Title' END AS title FROM documents")
def extract_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select("doc_id", "title")


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_NORMAL.format('split_part(text, chr(10), 1) || chr(32) || $$and a string$$')} ELSE '' END AS abstract FROM documents")
def extract_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select("doc_id", "abstract")


@query(
    "WITH b AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, lang, source, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM b), "
    "n AS (SELECT doc_id, i, s, CASE WHEN i % 3 = 0 THEN lang WHEN i % 3 = 1 THEN 'Body' ELSE source END AS section FROM e WHERE s <> ''), "
    f"g AS (SELECT doc_id, section, min(i) AS first, {_SANE.format('section || $$: $$ || string_agg(s, chr(10) || chr(10) ORDER BY i)')} AS x FROM n GROUP BY doc_id, section) "
    "SELECT d.doc_id, coalesce(x, '') AS sections FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x, ' | ' ORDER BY first) AS x FROM g GROUP BY doc_id) USING (doc_id)"
)
def extract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select("doc_id", F.array_join("sections", " | ").alias("sections"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' M. ' || source || '; Only Name; Plain Author' WHEN 1 THEN 'a@b.c' ELSE '' END AS authors FROM documents")
def extract_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select("doc_id", "authors")


@query(
    "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '2021-03-04' WHEN doc_id % 4 = 0 THEN (doc_id % 100 + 1900)::VARCHAR ELSE '' END AS pub_date, "
    "CASE WHEN doc_id % 5 = 0 THEN '10.9/' || doc_id WHEN doc_id % 4 = 0 THEN '10.1/' || doc_id WHEN doc_id % 2 = 0 THEN 'PMC' || doc_id ELSE 'f' || doc_id || '.xml' END AS doi_or_id FROM documents"
)
def extract_dates_and_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).select("doc_id", "pub_date", "doi_or_id")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'pmc' ELSE 'pdf' END AS class, coalesce(nullif(replace(lang, 'en', ''), ''), source, '') AS fallback FROM documents")
def source_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    named = F.concat(F.replace("lang", F.lit("en"), F.lit("PMC")), F.col("doc_id").cast("string"))
    return docs.select("doc_id", extract.source(named).alias("class"), T.first_non_empty(F.replace("lang", F.lit("en"), F.lit("")), F.col("source")).alias("fallback"))


# -- index ------------------------------------------------------------------------------------------------------------


@query(f"WITH {COUNTS} SELECT term, doc_id, tf::INT AS tf FROM p")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


@query(f"WITH {TOKENS} SELECT term, doc_id, count(*)::INT AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM t GROUP BY term, doc_id")
def postings_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = posted(documents(spark, sf_dir))
    return found.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(f"WITH {LEXICON} SELECT * FROM x", )
def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark, sf_dir)


@query(f"WITH {LEXICON} SELECT term, doc_freq, term_freq, (row_number() OVER (ORDER BY term))::INT AS word_id FROM x")
def lexicon_wordid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_word_ids(lexicon(spark, sf_dir)).select("term", "doc_freq", "term_freq", "word_id")


@query("SELECT 'doc-' || doc_id AS orig_id, (dense_rank() OVER (ORDER BY doc_id))::INT AS internal_id FROM documents")
def docid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.concat(F.lit("doc-"), "doc_id").alias("orig"), "doc_id")
    return index.document_map(docs, "orig", "doc_id").withColumnRenamed("doc_id", "internal_id")


@query(
    f"WITH {LEXICON}, w AS (SELECT term, (row_number() OVER (ORDER BY term))::INT AS word_id FROM x) "
    "SELECT doc_id, count(*) AS words, sum(tf)::BIGINT AS freq, string_agg(word_id || ':' || tf, ' ' ORDER BY word_id) AS forward FROM p JOIN w USING (term) GROUP BY doc_id"
)
def forward_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(counted(spark, sf_dir), "counts")  # texts are cut into terms once, for lexicon and lists
    words = index.with_word_ids(index.lexicon(found))
    rows = index.forward(found.withColumn("positions", F.array().cast("array<int>")), words)
    pair = F.transform("postings", lambda p: F.concat(p["wordid"].cast("string"), F.lit(":"), p["freq"].cast("string")))
    total = F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + p["freq"])
    return rows.select(F.col("docid").alias("doc_id"), F.size("postings").cast("long").alias("words"), total.alias("freq"), F.array_join(pair, " ").alias("forward"))


@query(f"WITH {LEXICON} SELECT DISTINCT term FROM (SELECT unnest({_tok('text')}) AS term FROM benchmark) WHERE term NOT IN (SELECT term FROM x WHERE doc_freq > 1)")
def forward_missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.tokens_v1(F.col("text"))).alias("term"))
    return index.missing_terms(own, lexicon(spark, sf_dir).where("doc_freq > 1"))


@query(f"WITH {COUNTS} SELECT doc_id, sum(tf)::BIGINT AS dl FROM p GROUP BY doc_id")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lengths(counted(spark, sf_dir))


@query(f"WITH {COUNTS} SELECT doc_id AS internal_id, sum(tf)::BIGINT AS dl FROM p GROUP BY doc_id")
def forward_doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths from a forward index by original ids, of all documents."""
    found = written(counted(spark, sf_dir), "counts").withColumn("positions", F.array().cast("array<int>"))
    rows = index.forward(found, index.with_word_ids(index.lexicon(found))).withColumn("docid", F.concat(F.lit("d"), "docid"))
    docs = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("orig_id"))
    return index.lengths_of_forward(rows, docs).withColumnRenamed("doc_id", "internal_id")


@query("SELECT corpus, count(*) AS n, count(url) AS urls FROM (SELECT 'pages' AS corpus, url FROM pages UNION ALL SELECT 'documents', NULL FROM documents) GROUP BY corpus")
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = index.union(pages=table(spark, sf_dir, "pages"), documents=documents(spark, sf_dir))
    return both.groupBy("corpus").agg(F.count("*").alias("n"), F.count("url").alias("urls"))


@query(f"WITH {TOKENS}, {LENGTHS} SELECT n, total_len::BIGINT AS total_len, round(avgdl, 6) AS avgdl FROM c")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whole_index(spark, sf_dir)
    return index.corpus_stats(found.docs, found.doc_stats).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {LEXICON} SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS terms, sum(doc_freq)::BIGINT AS postings, sum(term_freq)::BIGINT AS tokens FROM x")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = lexicon(spark, sf_dir).agg(F.count("*").alias("terms"), F.sum("doc_freq").alias("postings"), F.sum("term_freq").alias("tokens"))
    return documents(spark, sf_dir).agg(F.count("*").alias("docs")).crossJoin(sums)  # one row each


@query(f"WITH {COUNTS} SELECT term, doc_id, doc_id - lag(doc_id, 1, 0::BIGINT) OVER (PARTITION BY term ORDER BY doc_id) AS doc_gap FROM p")
def gap_encode_docids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.gaps(counted(spark, sf_dir)).select("term", "doc_id", "doc_gap")


@query(f"WITH {COUNTS} SELECT term, doc_id FROM p")
def gap_decode_docids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.documents_of_gaps(index.gap_lists(documents(spark, sf_dir).select("doc_id", "text"), T.tokens_v1(F.col("text")), bits=8))


@query(
    f"WITH {TOKENS}, g AS (SELECT term, doc_id, pos, pos - lag(pos, 1, 0::BIGINT) OVER (PARTITION BY term, doc_id ORDER BY pos) AS gap FROM t) "
    "SELECT term, doc_id, string_agg(gap::VARCHAR, ',' ORDER BY pos) AS gaps FROM g GROUP BY term, doc_id"
)
def gap_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = posted(documents(spark, sf_dir))
    return found.select("term", "doc_id", F.array_join(index.position_gaps(F.col("positions")).cast("array<string>"), ",").alias("gaps"))


def _vbyte_sql(x: str) -> str:
    return "(1 + " + " + ".join(f"(({x}) >= {1 << 7 * k})::INT" for k in range(1, 5)) + ")"


@query(
    f"WITH {TOKENS}, q AS (SELECT term, doc_id, pos, pos - lag(pos, 1, 0::BIGINT) OVER (PARTITION BY term, doc_id ORDER BY pos) AS gap FROM t), "
    f"d AS (SELECT term, doc_id, count(*) AS tf, sum({_vbyte_sql('gap')}) AS b FROM q GROUP BY term, doc_id), "
    f"e AS (SELECT term, doc_id, tf, b + {_vbyte_sql('tf')} + {_vbyte_sql('doc_id - lag(doc_id, 1, 0::BIGINT) OVER (PARTITION BY term ORDER BY doc_id)')} AS b FROM d), "
    f"s AS (SELECT term, count(*)::INT AS doc_freq, sum(tf)::BIGINT AS term_freq, (sum(b) + {_vbyte_sql('count(*)')})::BIGINT AS bytes FROM e GROUP BY term) "
    "SELECT term, doc_freq, term_freq, bytes, (row_number() OVER (ORDER BY term))::INT AS word_id, "
    "coalesce(sum(bytes) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", "
    "'{\"df\":' || doc_freq || ',\"skip_interval\":128}' AS skip_meta FROM s"
)
def posting_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_offsets(listed(spark, sf_dir)).drop("barrel_id")


@query(f"SELECT doc_id, {_vbyte_sql('n_chars')} AS size, {_vbyte_sql('doc_id * 1000')} AS wide FROM documents")
def vbyte_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", codec.vbyte_size(F.col("n_chars")).alias("size"), codec.vbyte_size(F.col("doc_id") * 1000).alias("wide"))


@query(f"SELECT doc_id, n_chars AS number, {_vbyte_sql('n_chars')}::INT AS size FROM documents")
def vbyte_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = documents(spark, sf_dir).select("doc_id", codec.vbyte_encode(F.array("n_chars")).alias("b"))
    return data.select("doc_id", F.get(codec.vbyte_decode("b"), 0).alias("number"), F.octet_length("b").alias("size"))


@query("SELECT doc_id, n_chars AS number, doc_id AS second FROM documents")
def vb_be_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = documents(spark, sf_dir).select("doc_id", codec.vb_encode_be(F.array("n_chars", "doc_id")).alias("b"))
    both = data.withColumn("n", codec.vb_decode_be("b"))
    return both.select("doc_id", F.get("n", 0).alias("number"), F.get("n", 1).alias("second"))


@query("SELECT * FROM (VALUES (1, '129,2'), (2, '0'), (3, '16384')) v(id, numbers)")
def vb_be_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, bytearray(b"\x81\x01\x02")), (2, bytearray(b"\x00")), (3, bytearray(b"\x81\x80\x00"))], "id int, b binary")
    return rows.select("id", F.array_join(codec.vb_decode_be("b").cast("array<string>"), ",").alias("numbers"))


@query(f"WITH {TOKENS} SELECT term, doc_id::INT AS doc_id, count(*)::INT AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM t GROUP BY term, doc_id")
def posting_list_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting list to bytes and back."""
    lists = posting_lists(spark, sf_dir)
    back = lists.select("term", codec.encode_postings("postings").alias("b")).select("term", F.explode(codec.decode_postings("b")).alias("p"))
    return back.select("term", "p.doc_id", "p.tf", F.array_join(F.col("p.positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS block FROM documents")
def block_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.numbered(documents(spark, sf_dir).select("doc_id"), "doc_id", order.by_number("doc_id"), "row")
    return rows.select("doc_id", F.floor((F.col("row") - 1) / 100).alias("block"))


# -- search -----------------------------------------------------------------------------------------------------------


def _search_sql(words: list[str], every: bool = True, binary: bool = True, k: int = 10) -> str:
    values = ", ".join(f"('{w}')" for w in words)
    tf = "1.0" if binary else "tf"
    having = "HAVING count(DISTINCT p.term) = (SELECT count(*) FROM known)" if every else ""
    return (
        f"WITH {LEXICON}, {LENGTHS}, q AS (SELECT col0 AS term, count(*) AS times FROM (VALUES {values}) GROUP BY col0), known AS (SELECT term, doc_freq FROM x WHERE term IN (SELECT term FROM q)) "
        f"SELECT p.doc_id, round(sum(times * ln((n - doc_freq + 0.5::DOUBLE) / (doc_freq + 0.5::DOUBLE) + 1) * 2.5::DOUBLE * {tf} / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / avgdl) + {tf})), 6) AS score "
        f"FROM p JOIN known USING (term) JOIN q USING (term) JOIN dl USING (doc_id) CROSS JOIN c GROUP BY p.doc_id {having} ORDER BY score DESC, p.doc_id LIMIT {k}"
    )


def _ranked(found: DataFrame, k: int = 10) -> DataFrame:
    """Scores to six places, in their order and then by id: what another engine's rounding leaves equal."""
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


@query(_search_sql(["the"]))
def search_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.search_single(whole_index(spark, sf_dir), "the of", None))


@query(_search_sql(["the", "of"]))
def search_multi_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.search_multi(whole_index(spark, sf_dir), "The, of", None))


@query(_search_sql(["the", "and"], binary=False))
def search_multi_actual_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.search_multi(whole_index(spark, sf_dir), "the and", None, "actual"))


@query(_search_sql(["the", "the", "of"]))
def search_dup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.search_multi(whole_index(spark, sf_dir), "the the of", None))


@query(_search_sql(["the", "zzz"]))
def search_unknown_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.search_multi(whole_index(spark, sf_dir), "the zzz", None))


@query(_search_sql(["zzz"]))
def search_no_known_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.search_multi(whole_index(spark, sf_dir), "zzz", None))


SYNONYMS = (("the", "der", 1), ("the", "le", 2), ("the", "la", 3), ("of", "de", 1))


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SYNONYMS), "term string, synonym string, rank int")


@query(_search_sql(["the", "of", "der", "le", "de"]))
def search_semantic_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.search_semantic(whole_index(spark, sf_dir), "the of", synonyms(spark), None))


@query(_search_sql(["the", "of", "der", "le", "de"], every=False))
def search_semantic_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.search_semantic(whole_index(spark, sf_dir), "the of", synonyms(spark), None, "or"))


@query(f"WITH {COUNTS} SELECT doc_id FROM p WHERE term = 'the' INTERSECT SELECT doc_id FROM p WHERE term = 'of' INTERSECT SELECT doc_id FROM p WHERE term = 'and'")
def posting_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.intersect(whole_index(spark, sf_dir), ["the", "of", "and"])


#: Ranges of so few ids that small tables have many of them.
_BITS = 3
_SATURATION = "2.5::DOUBLE * {tf} / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / avgdl) + {tf})"


def _bounded_index(spark: SparkSession, sf_dir: str) -> index.Index:
    found = whole_index(spark, sf_dir)
    corpus = index.corpus_stats(found.docs, found.doc_stats)
    held = written(found.postings, "postings")
    return replace(found, postings=held, corpus=corpus, blocks=index.posting_blocks(held, corpus, _BITS))


@query(
    f"WITH {COUNTS}, {LENGTHS} SELECT term, p.doc_id >> {_BITS} AS block, count(*)::INT AS docs, min(p.doc_id) AS first_id, max(p.doc_id) AS last_id, max(tf)::INT AS max_tf, "
    f"round(max({_SATURATION.format(tf='1.0')}), 6) AS top_binary, round(max({_SATURATION.format(tf='tf')}), 6) AS top_actual FROM p JOIN dl USING (doc_id) CROSS JOIN c GROUP BY term, p.doc_id >> {_BITS}"
)
def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bounded search reads instead of postings: each term's greatest scores by range of ids."""
    docs, whole = documents(spark, sf_dir), whole_index(spark, sf_dir)
    dealt = docs.select("doc_id", "text").repartition(pieces(docs), F.shiftright("doc_id", _BITS))  # a range's documents are one task's, and its postings stay there
    own = index.document_postings(dealt, T.numbered(T.tokens_v1(F.col("text"))), dealt=True)
    found = index.posting_blocks(own, index.corpus_stats(whole.docs, whole.doc_stats), _BITS)
    return found.drop("avgdl").withColumns({c: F.round(c, 6) for c in ("top_binary", "top_actual")})


@query(_search_sql(["the", "of"]))
def search_bounded_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.bounded(_bounded_index(spark, sf_dir), ["the", "of"], bits=_BITS))


@query(_search_sql(["the", "of", "der", "le", "de"], every=False, binary=False))
def search_bounded_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.bounded(_bounded_index(spark, sf_dir), ["the", "of", "der", "le", "de"], "or", "actual", bits=_BITS))


# -- suggestions and barrels ------------------------------------------------------------------------------------------


@query(f"WITH {LEXICON} SELECT term FROM x WHERE starts_with(term, 're') ORDER BY term_freq DESC, term LIMIT 10")
def suggest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggest(lexicon(spark, sf_dir), "RE")


@query(f"WITH {LEXICON} SELECT term, term_freq FROM x WHERE starts_with(term, 'th') ORDER BY term_freq DESC, term LIMIT 10")
def suggest_with_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggest_with_freq(lexicon(spark, sf_dir), "th")


@query(
    f"WITH {LEXICON}, e AS (SELECT term, term_freq, unnest(range(1, length(term) + 1)) AS k FROM x), f AS (SELECT left(term, k) AS prefix, term, term_freq FROM e), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY term_freq DESC, term) AS n FROM f) "
    "SELECT prefix, string_agg(term || '=' || term_freq, ' ' ORDER BY n) AS suggestions FROM r WHERE n <= 10 GROUP BY prefix"
)
def suggest_all_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that suggestions are served from: every prefix of every term, with its ten best."""
    pairs = F.transform("suggestions", lambda x: F.concat(x["term"], F.lit("="), x["term_freq"].cast("string")))
    return suggest.completions(lexicon(spark, sf_dir)).select("prefix", F.array_join(pairs, " ").alias("suggestions"))


@query(f"WITH {LEXICON} SELECT term FROM x WHERE false")
def suggest_empty_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggest(lexicon(spark, sf_dir), "")


@query(f"WITH {LEXICON} SELECT count(*) > 0 AS contained FROM x WHERE term = 'the'")
def contains_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.contains(lexicon(spark, sf_dir), "The")


@query(
    f"WITH {LEXICON}, n AS (SELECT DISTINCT substr(term, 1, k) AS prefix FROM (SELECT term, unnest(range(1, length(term) + 1)) AS k FROM x)) "
    "SELECT count(*) + 1 AS nodes, (SELECT sum(strlen(term))::BIGINT FROM x) AS term_bytes, (count(*) + 1) * 64 + (SELECT sum(strlen(term))::BIGINT FROM x) AS bytes FROM n"
)
def trie_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.memory(lexicon(spark, sf_dir))


BARREL_SQL = "(('0x' || substr(md5(term), 1, 8))::BIGINT % 10)::INT"


@query(f"WITH {LEXICON} SELECT term, {BARREL_SQL} AS barrel_id FROM x")
def barrel_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barrels.assign(lexicon(spark, sf_dir)).select("term", "barrel_id")


@query(
    f"WITH o AS ({SQL['posting_offsets']}), y AS (SELECT *, {BARREL_SQL} AS barrel_id FROM o) "
    "SELECT barrel_id, min(term) AS start_term, max(term) AS end_term, min(\"offset\") AS \"offset\", sum(bytes)::BIGINT AS size, count(*)::INT AS term_count FROM y GROUP BY barrel_id"
)
def barrel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barrels.metadata_of_sizes(listed(spark, sf_dir))


@query(f"SELECT DISTINCT {BARREL_SQL} AS barrel_id FROM (VALUES ('virus'), ('cell'), ('the'), ('of')) v(term)")
def preload_barrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return barrels.needed(spark.createDataFrame([("virus",), ("cell",), ("the",), ("of",)], "term string"))


@query("SELECT (event_id % 10)::INT AS barrel_id, max(event_id) AS \"at\" FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 3")
def barrel_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("event_id") % 10).cast("int").alias("barrel_id"), F.col("event_id").alias("at"))
    return barrels.resident(events)


# -- metrics ----------------------------------------------------------------------------------------------------------

_RANK = "list_sort(list(value))[least(floor({0} * count(value) / 100.0)::BIGINT, count(value) - 1) + 1]"


@query(f"SELECT event_type, {_RANK.format(50)} AS p50, {_RANK.format(95)} AS p95, {_RANK.format(99)} AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"], (50, 95, 99))


_STATS = f"count(value) AS query_count, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS avg_time_ms, min(value) AS min_time_ms, max(value) AS max_time_ms, {_RANK.format(50)} AS p50_time_ms, {_RANK.format(95)} AS p95_time_ms, {_RANK.format(99)} AS p99_time_ms"


def _query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.query_stats(table(spark, sf_dir, "events"), "value")
    return found.withColumns({"total_ms": F.round("total_ms", 4), "avg_time_ms": F.round("avg_time_ms", 6)})


@query(f"SELECT {_STATS} FROM events")
def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query_stats(spark, sf_dir)


@query(
    f"WITH s AS (SELECT {_STATS}, max(event_id) / 1024.0::DOUBLE AS peak FROM events) SELECT 'query_count' AS key, query_count::DOUBLE AS value FROM s UNION ALL SELECT 'avg_time_ms', avg_time_ms FROM s "
    "UNION ALL SELECT 'p95_time_ms', p95_time_ms FROM s UNION ALL SELECT 'peak_memory_mb', peak FROM s"
)
def stats_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory = metrics.memory_stats(table(spark, sf_dir, "events"), "event_id", "event_id")
    return metrics.stats_rows(_query_stats(spark, sf_dir).crossJoin(memory))  # one row each


@query("SELECT max_by(event_id, event_id) / 1024.0::DOUBLE AS current_memory_mb, max(event_id) / 1024.0::DOUBLE AS peak_memory_mb FROM events")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.memory_stats(table(spark, sf_dir, "events"), "event_id", "event_id")


@query("SELECT event_id, value AS time_ms FROM events WHERE value > 100")
def slow_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.slow(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("time_ms")))


@query("SELECT source, round(count(*) / (floor(sum(n_chars) / 1000.0) + 0.01), 6) AS docs_per_second FROM documents GROUP BY source")
def indexing_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"), (F.sum("n_chars") / 1000.0).alias("seconds"))
    return sums.select("source", F.round(metrics.throughput(F.col("docs"), F.col("seconds")), 6).alias("docs_per_second"))
