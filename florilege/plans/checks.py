"""Registered queries of filters, lists, judgements and diagnostics over the chunk and quality tables.

Judgements have no table of their own here; their fields are derived from chunk indexes, so that every rule fires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import answers, questions
from florilege.functions import text as T
from florilege.functions import urls as U
from florilege.operators import evaluation, retrieval
from florilege.plans import sql as S
from florilege.plans.search import _LATEST, _chunks, _queries
from florilege.plans.web import table

FACULTY = "Fakultät II"
VERDICT_FORMS = ("fully_grounded", "Mostly_Grounded", "unsupported", "egal", "")


def faculty_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "source_url", "faculty").where(F.col("faculty").isin(FACULTY, ""))
    return rows.groupBy(U.host(F.col("source_url")).alias("host"), "faculty").agg(F.count(F.lit(1)).alias("n"))


def sanitized_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "quality_assessment", "file", "topic_tags", "reasons").where("file IS NOT NULL").distinct()
    both = F.concat(F.coalesce("topic_tags", F.array().cast("array<string>")), F.transform(F.coalesce("topic_tags", F.array().cast("array<string>")), lambda x: F.upper(x)), F.coalesce("reasons", F.array().cast("array<string>")))
    return rows.select("file", F.size(questions.dedupe(both)).cast("long").alias("items"), F.array_join(F.slice(questions.dedupe(both), 1, 2), "|").alias("first"))


def sanitized_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hsh_vectors", "id", "quality_score").where("id IS NOT NULL").distinct()
    return rows.select("id", "quality_score", evaluation.clean_score(F.col("quality_score")).alias("score"))


def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "text").select("id", T.clip(F.col("text"), 200).alias("clip"))


def stale_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hsh_vectors", "source_url", "crawl_date").where("source_url IS NOT NULL").withColumn("date", F.col("crawl_date").try_cast("date"))
    newest = rows.agg(F.max("date")).first()[0]
    pages = rows.groupBy("source_url").agg(F.min("crawl_date").alias("least"), F.min("date").alias("oldest"))
    return pages.select("source_url", answers.stale(F.array(F.col("oldest").cast("string")), F.lit(newest).cast("date")).alias("stale"))


def blocked_results(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "source_url")
    return rows.where(~F.coalesce(F.col("source_url").startswith("https://karriere."), F.lit(False))).groupBy("source_url").agg(F.count(F.lit(1)).alias("n"))


def context_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "source_url", "title", "section_heading", "text", "sparse_indices", "sparse_values")
    hits = retrieval.sparse_dot(rows, _queries(rows), "id", "query_id", "sparse_indices", "sparse_values", 4).join(rows.select("id", "source_url", "title", "section_heading", "text"), "id")
    return answers.context_blocks(hits).select("query_id", F.length("context").alias("length"))


def reranked(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "title", "text", "sparse_indices", "sparse_values")
    asked = _queries(rows)
    hits = retrieval.sparse_dot(rows, asked, "id", "query_id", "sparse_indices", "sparse_values", 6).join(rows.select("id", "text"), "id").join(asked.select("query_id", F.col("title").alias("question")), "query_id")
    return retrieval.overlap_reranker(hits, "query_id", "text", "question").select("query_id", "id", "rerank", "rank")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hsh_vectors", "chunk_index").where("chunk_index IS NOT NULL").distinct()
    c = F.col("chunk_index")
    scores = {f: ((c * (k + 2)) % 8 - 1).cast("string") for k, f in enumerate(evaluation.RUBRIC)}
    verdict = F.element_at(F.array(*[F.lit(v) for v in VERDICT_FORMS]), (c % 5) + 1)
    return evaluation.finalize(rows.withColumns({**scores, "verdict": verdict, "satisfied": c % 3 != 0, "score": (c % 6).cast("int")}))


def judgements(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("chunk_index", *evaluation.RUBRIC, "verdict", "overall_score")


def diagnoses(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("chunk_index")
    rows = _judged(spark, d).withColumns({
        "stage_1": F.col("overall_score"), "stage_2": ((c * 7) % 101).cast("double"), "missing_required": c % 4 == 0, "missing_optional": c % 2 == 0, "forbidden": c % 11 == 0, "unsupported": c % 13 == 0, "retrieved": c % 5 != 0,
        "clarification_expected": c % 6 == 0, "dialog_behavior": c % 4, "refused": c % 9 == 0, "expected_behavior": F.when(c % 2 == 0, "direct_answer").otherwise("clarify"), "fairness_risk": F.when(c % 10 == 0, "Hoch").when(c % 3 == 0, "mittel").otherwise("low"),
    })
    return evaluation.diagnostics(rows).select("chunk_index", "failure_types", "stage_gap", "human_review")


QUERIES = (faculty_filter, sanitized_tags, sanitized_scores, clipped_texts, stale_pages, blocked_results, context_lengths, reranked, judgements, diagnoses)


def _sql() -> dict[str, str]:
    squeezed = rf"trim(regexp_replace(text, '[{S.SPACE}]+', ' ', 'g'))"
    field = lambda k: f"greatest(0, least(5, ((chunk_index * {k + 2}) % 8 - 1)))"
    cap = lambda k: f"CASE WHEN sat THEN {field(k)} ELSE least({field(k)}, 2) END"
    verdicts = "[" + ", ".join(map(S.lit, VERDICT_FORMS)) + "]"
    judged = f"""j0 AS (SELECT DISTINCT chunk_index, chunk_index % 3 <> 0 AS sat, lower({verdicts}[chunk_index % 5 + 1]) AS v FROM hsh_vectors WHERE chunk_index IS NOT NULL),
        j1 AS (SELECT chunk_index, sat, (chunk_index % 6)::INT AS source_retrieval, ({cap(1)})::INT AS evidence_sufficiency, ({field(2)})::INT AS answer_grounding, ({cap(3)})::INT AS citation_support, ({field(4)})::INT AS refusal_quality,
            CASE WHEN {S.among("v", evaluation.VERDICTS)} THEN v WHEN sat THEN 'partially_grounded' ELSE 'retrieval_failed' END AS w FROM j0),
        j AS (SELECT *, CASE WHEN NOT sat AND w IN ('fully_grounded', 'mostly_grounded') THEN 'wrong_source' ELSE w END AS verdict, round_even((source_retrieval + evidence_sufficiency + answer_grounding + citation_support + refusal_quality) / 25.0 * 100, 1)::DOUBLE AS overall_score FROM j1)"""
    rules = [
        ("chunk_index % 4 = 0", "missing_required_fact"), ("chunk_index % 2 = 0 AND overall_score < 90", "missing_optional_fact"), ("chunk_index % 11 = 0 OR chunk_index % 13 = 0", "hallucination"),
        ("(NOT sat AND chunk_index % 5 <> 0) OR verdict = 'wrong_source'", "wrong_source_retrieved"), ("(NOT sat AND chunk_index % 5 = 0) OR verdict = 'retrieval_failed'", "retrieval_failed"),
        ("sat AND evidence_sufficiency >= 3 AND answer_grounding <= 2", "answer_ignored_evidence"), ("citation_support <= 2 AND chunk_index % 5 <> 0", "citation_problem"), ("chunk_index % 6 = 0 AND chunk_index % 4 <= 2", "should_have_clarified"),
        ("chunk_index % 9 = 0 AND chunk_index % 2 = 0", "wrong_refusal"), ("abs(gap) >= 30", "stage_disagreement"), ("gap >= 30", "reference_too_strict"),
    ]
    failures = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for r, n in rules) + "], lambda x: x IS NOT NULL))"
    tags = "list_filter(list_transform(list_concat(coalesce(topic_tags, []), coalesce(reasons, [])), lambda x: lower(trim(x))), lambda x: x <> '')"
    flat = "SELECT id, unnest(sparse_indices) AS i, unnest(sparse_values)::DOUBLE AS v FROM {}"
    hits = lambda k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.id AS query_id, b.id, round(sum(a.v * b.v), 6) AS score FROM ({flat.format('q')}) a JOIN ({flat.format('c')}) b USING (i) GROUP BY ALL HAVING round(sum(a.v * b.v), 6) > 0)) WHERE rank <= {k}"
    words = lambda c: rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]{{2,}}'))"
    return {
        "faculty_filter": f"WITH {_LATEST} SELECT {S.host('source_url')} AS host, faculty, count(*) AS n FROM c WHERE faculty IN ('{FACULTY}', '') GROUP BY ALL",
        "sanitized_tags": f"""WITH f AS (SELECT DISTINCT file, topic_tags, reasons FROM quality_assessment WHERE file IS NOT NULL), t AS (SELECT file, {tags} AS t, list_concat(coalesce(topic_tags, []), coalesce(reasons, [])) AS o FROM f)
            SELECT file, len(list_distinct(t)) AS items, array_to_string(o[1:2], '|') AS first FROM t""",
        "sanitized_scores": "SELECT DISTINCT id, quality_score, greatest(0, least(5, coalesce(TRY_CAST(quality_score AS INT), 0)))::INT AS score FROM hsh_vectors WHERE id IS NOT NULL",
        "clipped_texts": f"WITH {_LATEST} SELECT id, CASE WHEN length({squeezed}) <= 200 THEN {squeezed} ELSE rtrim({squeezed}[1:199]) || '…' END AS clip FROM c",
        "stale_pages": """WITH m AS (SELECT max(TRY_CAST(crawl_date AS DATE)) AS m FROM hsh_vectors), p AS (SELECT source_url, min(TRY_CAST(crawl_date AS DATE)) AS o FROM hsh_vectors WHERE source_url IS NOT NULL GROUP BY 1)
            SELECT source_url, coalesce(date_diff('day', o, (SELECT m FROM m)) > 180, false) AS stale FROM p""",
        "blocked_results": f"WITH {_LATEST} SELECT source_url, count(*) AS n FROM c WHERE NOT coalesce(starts_with(source_url, 'https://karriere.'), false) GROUP BY 1",
        "context_lengths": f"""WITH {_LATEST}, h4 AS ({hits(4)}), b AS (SELECT query_id, length('[' || rank || '] ' || concat_ws(' – ', title, nullif(section_heading, '')) || chr(10) || coalesce(source_url, '') || chr(10) || chr(10) || coalesce(text, '')) AS n FROM h4 JOIN c USING (id))
            SELECT query_id, (sum(n) + 7 * (count(*) - 1))::INT AS length FROM b GROUP BY 1""",
        "reranked": f"""WITH {_LATEST}, h6 AS ({hits(6)}), r AS (SELECT h6.query_id, h6.id, h6.rank, round(len(list_intersect({words("q.title")}, {words("c.text")})) / greatest(len({words("q.title")}), 1), 6) AS rerank FROM h6 JOIN c ON c.id = h6.id JOIN q ON q.id = h6.query_id)
            SELECT query_id, id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC NULLS LAST, rank) AS rank FROM r""",
        "judgements": f"WITH {judged} SELECT chunk_index, {', '.join(evaluation.RUBRIC)}, verdict, overall_score FROM j",
        "diagnoses": f"""WITH {judged}, g AS (SELECT *, round_even(((chunk_index * 7) % 101)::DOUBLE - overall_score, 1) AS gap FROM j), f AS (SELECT *, {failures} AS f FROM g)
            SELECT chunk_index, array_to_string(f, '|') AS failure_types, gap AS stage_gap, (abs(gap) >= 30 OR chunk_index % 10 = 0 OR (chunk_index % 10 <> 0 AND chunk_index % 3 = 0 AND len(f) > 0)) AS human_review FROM f""",
    }


SQL = _sql()
