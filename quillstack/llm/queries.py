"""The queries of this subpackage, each over its whole table, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import backoff, importance, infill, mixing, negatives, orderminhash, packing, simhash, template, tokencount, topk, urlmodel, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_files() -> dict[str, str]:
    """The public vocabulary that packing uses, and the same as ranks."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


#: The rules that pages are judged by.
URL_RULES = (
    urlmodel.Rule("net", "/", "block"),
    urlmodel.Rule("example.net", "/en/", "allow"),
    urlmodel.Rule("example.com", "/de/", "block"),
    urlmodel.Rule("org", "/fr/", "allow"),
)


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.ranked(warc.archive_and_index(_read(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "position")


def op2_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlmodel.judge(_read(spark, sf_dir, "pages"), URL_RULES).drop("url")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.fingerprints(_read(spark, sf_dir, "documents"), orderminhash.Settings(whole=True))


def op4_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(_read(spark, sf_dir, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).drop("component_root", "row")


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(_read(spark, sf_dir, "documents")).drop("row").withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).drop("row")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("spans", "row")


def op10_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), **tokenizer_files())


def op11_pre_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.transform(_read(spark, sf_dir, "documents"))
    restored = infill.restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index_merge": op1_warc_index_merge,
    "op2_url_language_models": op2_url_language_models,
    "op3_order_minhash": op3_order_minhash,
    "op4_template_deduction": op4_template_deduction,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_stupid_backoff": op6_stupid_backoff,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_sainte_lague_mix": op9_sainte_lague_mix,
    "op10_minimum_bin_slack": op10_minimum_bin_slack,
    "op11_pre_token_counts": op11_pre_token_counts,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What SQL has no means for has no entry: language models of URLs (2), sketches (3), HTML (4), XXH64 (5), hashed
#: models and Gumbel keys (7), seeded choices (9), tokenizers (10, 11).
ORACLE_SQL: dict[str, str] = {
    "op1_warc_index_merge": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest, trim(split_part(coalesce(url, ''), '#', 1)) AS u FROM pages),
        f AS (SELECT digest, min(page_id) AS first FROM p WHERE bytes >= 100 GROUP BY digest),
        r AS (SELECT *, CASE WHEN strpos(u, '://') > 0 AND NOT suffix(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE u END AS r FROM p),
        h AS (SELECT *, regexp_extract(r, '^[^/?]*') AS h, regexp_replace(r, '^[^/?]*', '') AS path FROM r),
        k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(h, '^.*@', '')), ':80$', ''), ':443$', ''), '^www[.]', '') AS host FROM h),
        n AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || coalesce(nullif(lower(path), ''), '/') AS urlkey,
            strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y-%m-%dT%H:%M:%SZ') AS "timestamp" FROM k)
        SELECT page_id, bytes AS payload_bytes, n.digest AS payload_digest,
            CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
            urlkey, "timestamp", row_number() OVER (ORDER BY urlkey, "timestamp", page_id NULLS LAST) AS position
        FROM n LEFT JOIN f ON n.digest = f.digest AND bytes >= 100""",
    "op6_stupid_backoff": f"""
        WITH l AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
        t AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM l),
        b AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t),
        o1 AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL), c1 AS (SELECT w, sum(n) AS n FROM o1 GROUP BY w),
        o2 AS (SELECT doc_id, v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY ALL), c2 AS (SELECT v, w, sum(n) AS n FROM o2 GROUP BY ALL),
        d AS (SELECT doc_id, len(l) AS own, sum(len(l)) OVER () - len(l) AS rest FROM l),
        s AS (SELECT b.doc_id, c1.n - o1.n AS a1, cv.n - ov.n AS context, c2.n - o2.n AS a2, b.v, d.rest FROM b JOIN d USING (doc_id)
            JOIN o1 ON o1.doc_id = b.doc_id AND o1.w = b.w JOIN c1 ON c1.w = b.w
            LEFT JOIN o1 ov ON ov.doc_id = b.doc_id AND ov.w = b.v LEFT JOIN c1 cv ON cv.w = b.v
            LEFT JOIN o2 ON o2.doc_id = b.doc_id AND o2.v = b.v AND o2.w = b.w LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w),
        u AS (SELECT *, CASE WHEN a1 > 0 THEN ln(a1) - ln(rest) ELSE -ln(rest + 1) END AS one FROM s),
        r AS (SELECT doc_id, sum(CASE WHEN v IS NULL THEN one WHEN a2 > 0 THEN ln(a2) - ln(context) ELSE ln(0.4) + one END) AS score FROM u GROUP BY doc_id)
        SELECT doc_id, own AS n_tokens, round(coalesce(score, 0), 6) AS log_score, CASE WHEN own > 0 THEN round(score / own, 6) END AS mean_log_score
        FROM d LEFT JOIN r USING (doc_id)""",
    "op8_exact_top_k": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, a.r, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS l, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        n AS (SELECT *, len(l) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
        p AS (SELECT *, array_to_string(l[1:a], '') AS p, array_to_string(l[a + 1:b], '') AS m, array_to_string(l[b + 1:], '') AS s,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, row_number() OVER () AS r, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.r AS ar, b.vec_id, b.r, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id)::INT AS rank
            FROM p JOIN s ON p.ar = s.ar AND NOT s.same WHERE p.nth <= 5 AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
