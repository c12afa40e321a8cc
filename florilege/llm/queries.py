"""Registered queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm import language, leakage, maincontent, mixing, neardup, residue, sitelines, spam, split, textstats
from florilege.llm.common import cut, table


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cleaned_body", "file", "source_url", "text")


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quality_assessment", "source_url", "reasons")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = split.split_oversized(table(spark, d, "hsh_vectors", "id", "text"), ["id"])
    return parts.where((F.col("n_pieces") > 1) & F.col("id").isNotNull()).select("id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(spark, d, "hsh_vectors"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(table(spark, d, "quality_assessment", "file", "language"), _bodies(spark, d))


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    labels, bodies = table(spark, d, "quality_assessment", "file", "language"), _bodies(spark, d)
    return language.page_languages(bodies, language.fit(labels, bodies))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    model = language.fit(table(spark, d, "quality_assessment", "file", "language"), _bodies(spark, d))
    return language.text_segments(table(spark, d, "hsh_vectors", "id", "text"), model)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "hsh_vectors", "id", "source_url", "text"), ["id"], _reasons(spark, d)).where("id IS NOT NULL").select("id").distinct()


def p3_marked(spark: SparkSession, d: str) -> DataFrame:
    return residue.marked(table(spark, d, "hsh_vectors", "id", "source_url", "text"), _reasons(spark, d))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "hsh_vectors", "id", "source_url", "chunk_index", "text"), _reasons(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "hsh_vectors", "id", "text"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(table(spark, d, "hsh_vectors", "id", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, d, "hsh_vectors", "source_url", "text")).select("host", "line_key")


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.without_repeated_lines(table(spark, d, "hsh_vectors", "id", "source_url", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return maincontent.furniture(table(spark, d, "hsh_vectors", "id", "source_url", "text"), ["id"]).where("id IS NOT NULL")


def p6_content(spark: SparkSession, d: str) -> DataFrame:
    return maincontent.main_content(table(spark, d, "hsh_vectors", "id", "source_url", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return textstats.not_prose(_bodies(spark, d), _reasons(spark, d))


def p7_statistics(spark: SparkSession, d: str) -> DataFrame:
    return textstats.statistics(_bodies(spark, d), _reasons(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return cut(mixing.token_counts(table(spark, d, "documents", "doc_id", "source", "text")))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_sizes(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam(table(spark, d, "documents", "doc_id", "lang", "text")).select("doc_id")


def p10_curves(spark: SparkSession, d: str) -> DataFrame:
    rows = spam.judged(table(spark, d, "documents", "doc_id", "lang", "text"))
    return rows.select("doc_id", "words", "links", "tags", *[F.round(m, 4).alias(m) for m in spam.MEASURES], *[f"far_{m}" for m in spam.MEASURES], "kind", "share")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_pages, p2_segments, p3_found, p3_marked, p3_kept, p4_found, p4_groups, p5_found, p5_cleaned, p6_found, p6_content, p7_found, p7_statistics, p8_found, p8_report, p9_mixture, p9_shares, p10_found, p10_curves)}


def oracle_sql() -> dict[str, str]:
    key = r"trim(regexp_replace(regexp_replace(lower(l), '\p{Nd}+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))"
    return {
        "p1_found": "SELECT DISTINCT id FROM hsh_vectors WHERE length(text) > 1000",
        "p5_found": rf"""
            WITH r AS (SELECT lower(regexp_extract(source_url, '://([^/?#]*)', 1)) AS host, source_url AS u, text FROM hsh_vectors WHERE text IS NOT NULL),
            p AS (SELECT lower(regexp_extract(source_url, '://([^/?#]*)', 1)) AS host, count(DISTINCT source_url) AS n FROM hsh_vectors GROUP BY 1),
            x AS (SELECT host, u, unnest(string_split(text, chr(10))) AS l FROM r),
            k AS (SELECT host, u, {key} AS line_key FROM x),
            c AS (SELECT host, line_key, count(DISTINCT u) AS n FROM k WHERE length(line_key) >= 10 GROUP BY ALL)
            SELECT c.host, c.line_key FROM c JOIN p USING (host) WHERE c.n >= 5 AND c.n * 100 >= 5 * p.n""",
        "p8_found": r"""
            WITH a AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
            b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
            x AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM a), y AS (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b),
            p AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM x), q AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM y)
            SELECT DISTINCT doc_id, item_id FROM p JOIN q USING (g)""",
    }
