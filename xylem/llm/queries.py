"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm import exact_dedup, mixing, near_dedup, packing, quality, repeats, secrets, toxicity, warc, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.verdicts(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.verdicts(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5's targets per source, which SQL can express."""
    docs = table(spark, sf_dir, "documents").select("source", mixing.size_of(F.col("text")).alias("size"))
    return mixing.targets(docs).select("source", "source_size", F.round("target", 3).alias("target"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6's base columns, which SQL can express."""
    return quality.document_counts(table(spark, sf_dir, "documents")).drop("lang", "source")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7's pattern counts, which SQL can express."""
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (mixing_targets, quality_base, secrets_base, op1_near_dedup, op2_warc, op3_exact_dedup, op4_toxicity, op5_mixing, op6_quality, op7_secrets, op8_tokens, op9_repeats, op10_packing)}

ORACLES = {
    "op1_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
        s AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM l),
        e AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON r.doc_id = e.u),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT l.doc_id, len(l.s) AS n_shingles, m.component_id, l.doc_id = m.component_id AS kept FROM l JOIN m USING (doc_id)""",
    "op2_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g USING (t)""",
    "mixing_targets": r"""
        WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS source_size FROM documents GROUP BY source),
        n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
        w AS (SELECT *, [3.0, 1.0, 2.0][nth % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM n),
        l AS (SELECT a.cap / a.weight AS ratio, (SELECT 1.5 * sum(source_size) FROM w)::DOUBLE AS goal, sum(CASE WHEN b.cap / b.weight < a.cap / a.weight THEN b.cap ELSE 0 END) AS held,
            sum(CASE WHEN b.cap / b.weight < a.cap / a.weight THEN 0 ELSE b.weight END) AS rest FROM w a, w b GROUP BY a.nth, a.cap, a.weight),
        f AS (SELECT arg_min((goal - held) / rest, ratio) AS level FROM l WHERE (goal - held) / rest <= ratio)
        SELECT source, source_size, round(coalesce(least(cap, level * weight), cap), 3) AS target FROM w, f""",
    "quality_base": r"""
        WITH w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
        k AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM x),
        c AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) t(j) WHERE n > 1 GROUP BY r),
        b AS (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w)
        SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
        FROM b LEFT JOIN c USING (r)""",
    "secrets_base": r"""
        SELECT doc_id,
            len(list_filter(regexp_extract_all(coalesce(text, ''), '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8))::BIGINT AS n_assign,
            len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::BIGINT AS n_access,
            len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32))::BIGINT AS n_hex
        FROM documents""",
}
