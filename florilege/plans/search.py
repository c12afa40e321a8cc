"""Registered queries of retrieval: both arms, fusion, context, boosts, glossary and similar terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.config import RetrievalConfig, SiteConfig
from florilege.functions import ids, questions
from florilege.functions import text as T
from florilege.operators import chunks, glossary, retrieval
from florilege.plans import guided
from florilege.plans import sql as S
from florilege.plans.web import table
from florilege.storage import cut

#: Questions of the registered queries, written for the test site.
QUESTIONS = (
    (1, "Was bedeutet BPO?"), (2, "Wie melde ich mich zur Prüfungsanmeldung an der Fakultät IV an?"), (3, "Wen kontaktiere ich wegen der Bewerbung in Fak 2?"), (4, "Wo finde ich das Formular für den Antrag?"),
    (5, "Was ist ein ECTS Punkt und was sind SWS?"), (6, "Wer ist Frau Dr. Muster?"), (7, "Wie lange dauert der Studiengang Robotik, und wann ist Studienbeginn?"), (8, "Welche Öffnungszeiten hat die Bibliothek heute?"),
    (9, "Was bedeutet K90 im Modul INF-204?"), (10, "Antrag online"), (11, "Legende der Prüfungsformen"), (12, ""),
)
K = 10


def question_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id long, query string")


def asked(id_: Column) -> Column:
    """The query set over chunks: ids whose first eight hex digits are divisible by 20."""
    return F.conv(F.substring(id_, 1, 8), 16, 10).cast("long") % 20 == 0


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct chunks by id, the latest crawl of each."""
    return chunks.latest(table(spark, d, "hsh_vectors", "id", "crawl_date", *columns).where("id IS NOT NULL")).drop("crawl_date")


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where(asked(F.col("id"))).withColumnRenamed("id", "query_id")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_topk(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"), "doc_id", "item_id", "text", K)


def bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(table(spark, d, "benchmark", "item_id", "text"), "item_id", "text").select("item_id", "term", F.round("weight", 6).alias("weight"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.dense_topk(rows, queries, "vec_id", "query_id", "embedding", K).select("query_id", "vec_id", "score")


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "sparse_indices", "sparse_values")
    return retrieval.sparse_dot(rows, _queries(rows), "id", "query_id", "sparse_indices", "sparse_values", K)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "source_url", "vector", "sparse_indices", "sparse_values")
    return retrieval.hybrid(rows, _queries(rows.drop("source_url")), RetrievalConfig())


def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.hashed_vectors(table(spark, d, "benchmark", "item_id", "text"), "item_id", "text")
    return out.select("item_id", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).cast("long").alias("terms"), F.size("vector").alias("dim"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where(asked(F.col("id"))).select(F.col("id").alias("query_id"), "id")


def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "source_url", "chunk_index", "section_heading")
    return retrieval.neighbours(_hits(spark, d), rows, reach=1).select("id", "near_id", F.col("distance").cast("int").alias("distance"))


def band_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "source_url", "chunk_index", "section_heading")
    return retrieval.neighbours(_hits(spark, d), rows, reach=2, same_section=True).select("id", "near_id", F.col("distance").cast("int").alias("distance"))


def augmented_length(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "source_url", "chunk_index", "section_heading", "text")
    hits = _hits(spark, d).join(rows.select("id", "text"), "id").withColumn("rank", F.lit(1))
    return retrieval.augmented(hits, rows).select("id", F.length("text").alias("length"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hsh_vectors", "source_url", "chunk_index").where("source_url IS NOT NULL").distinct()
    return rows.select("source_url", "chunk_index", ids.chunk_id(F.col("source_url"), F.col("chunk_index")).alias("id"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "source_url", "text")
    return rows.groupBy("source_url").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("characters"))


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk(table(spark, d, "cleaned_body", "file", "source_url", "text"), "text", ["file", "source_url"])


def latest_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hsh_vectors", "id", "crawl_date", "title").where("id IS NOT NULL")
    return chunks.latest(rows.groupBy("id", "crawl_date").agg(F.max("title").alias("title"))).select("id", F.date_format(F.col("crawl_date").try_cast("date"), "yyyy-MM-dd").alias("crawl_date"))


def query_codes(spark: SparkSession, d: str) -> DataFrame:
    out = questions.assess(question_rows(spark))
    return out.select("query_id", *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("codes", "abbreviations", "detected_faculties")])


def _headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hsh_vectors", F.col("section_heading").alias("query")).where("query IS NOT NULL").distinct()


def query_intents(spark: SparkSession, d: str) -> DataFrame:
    rows = question_rows(spark).select("query").union(_headings(spark, d)).distinct()
    return questions.assess(rows).select("query", F.array_join(F.filter("intents", lambda x: x != "person_lookup"), "|").alias("intents"))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    out = questions.variants(questions.assess(question_rows(spark)))
    return out.select("query_id", F.array_join("retrieval_terms", "|").alias("retrieval_terms"), "broad", "too_short", F.array_join("variants", "|").alias("variants"))


def payload_faculties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hsh_vectors", "source_url", "source_family", "document_group", "faculty").distinct()
    c = lambda n: F.coalesce(n, F.lit(""))
    return rows.select("source_url", c("source_family").alias("source_family"), c("document_group").alias("document_group"), c("faculty").alias("faculty"),
                       F.array_join(F.array_sort(retrieval.chunk_faculties(c("faculty"), c("source_url"), c("source_family"), c("document_group"))), "|").alias("faculties")).distinct()


def _search_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "title", "section_heading", "text", "source_url", "document_kind", "source_family", "document_group", "faculty")
    c = lambda n: F.coalesce(n, F.lit(""))
    return rows.withColumns({"search_text": retrieval.search_text(), "faculties": retrieval.chunk_faculties(c("faculty"), c("source_url"), c("source_family"), c("document_group"))})


def guided_topk(spark: SparkSession, d: str) -> DataFrame:
    asked_ = cut(questions.variants(questions.assess(question_rows(spark).where("query <> ''")), institution="Hochschule Nordfurt"))
    out = guided.search(cut(_search_rows(spark, d)), asked_)  # read by every stage of the search
    return out.select("query_id", "id", "score", "rank")


def boosted(spark: SparkSession, d: str) -> DataFrame:
    asked_ = questions.assess(question_rows(spark)).where("query_id = 4")
    rows = _search_rows(spark, d).select("id", "search_text", "faculties")
    return retrieval.with_boost(rows.crossJoin(F.broadcast(asked_))).select("id", "boost")  # one question


def rescue_scores(spark: SparkSession, d: str) -> DataFrame:
    asked_ = questions.assess(question_rows(spark)).where("query_id = 5")
    rows = _search_rows(spark, d).select("id", "search_text")
    return retrieval.with_rescue(rows.crossJoin(F.broadcast(asked_))).where("rescue > 0").select("id", "rescue")  # one question


def glossary_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "text", "source_url", "title", "faculty")
    return glossary.entries(rows)


def glossary_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked_ = questions.assess(question_rows(spark)).withColumn("phrases", F.concat("retrieval_terms", retrieval.aliases(F.col("retrieval_terms"))))
    return glossary.lookup(glossary_entries(spark, d), asked_)


def corpus_terms(spark: SparkSession, d: str) -> DataFrame:
    return glossary.corpus_terms(_chunks(spark, d, "text"), "id", "text").select("term", "mentions")


def similar_terms(spark: SparkSession, d: str) -> DataFrame:
    words = lambda t, c: table(spark, d, t, c).where(F.col(c).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z]{4,}"), 0)).alias("term"))
    known = words("documents", "text").groupBy("term").agg(F.count(F.lit(1)).alias("mentions"))
    return glossary.similar_terms(words("benchmark", "text").select(F.col("term").alias("asked")).distinct(), known).select("asked", "term", "mentions", "rank")


def term_corrections(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "title", "section_heading", "text")
    hits = rows.where(asked(F.col("id"))).withColumns({"query_id": F.col("id"), "rank": F.lit(1)})
    context = glossary.context_terms(hits)
    asked_ = context.select("query_id", F.concat("term", F.lit("s")).alias("asked"))
    return glossary.corrections(asked_, context)


QUERIES = (
    bm25_topk, bm25_weights, dense_topk, sparse_topk, hybrid_topk, hashed_embedding, neighbour_context, band_context, augmented_length, chunk_ids, chunk_stats, chunk_documents, latest_chunks, query_codes, query_intents,
    query_terms, payload_faculties, guided_topk, boosted, rescue_scores, glossary_entries, glossary_lookup, corpus_terms, similar_terms, term_corrections,
)

_LATEST = """h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(TRY_CAST(crawl_date AS DATE), DATE '0001-01-01') DESC, coalesce(crawl_date, '') DESC) AS rn FROM hsh_vectors WHERE id IS NOT NULL),
    c AS (SELECT * FROM h WHERE rn = 1), q AS (SELECT * FROM c WHERE ('0x' || id[1:8])::BIGINT % 20 = 0)"""
_TERMS = r"(SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]{{2,}}')) AS term FROM {table} WHERE text IS NOT NULL)"


def _bm25(table_: str, key: str) -> str:
    return f"""tf AS (SELECT {key}, term, count(*) AS tf FROM {_TERMS.format(key=key, table=table_)} GROUP BY ALL), dl AS (SELECT {key}, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS m FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        w AS (SELECT {key}, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m)) AS weight FROM tf JOIN dl USING ({key}) JOIN df USING (term), st)"""


def _sql() -> dict[str, str]:
    values = ", ".join(f"({i}, {S.lit(q)})" for i, q in QUESTIONS)
    dense = "SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.vector::DOUBLE[], c.vector::DOUBLE[]), 6) AS score FROM q, c WHERE q.vector IS NOT NULL AND c.vector IS NOT NULL"
    flat = "SELECT id, unnest(sparse_indices) AS i, unnest(sparse_values)::DOUBLE AS v FROM {}"
    sparse = f"SELECT a.id AS query_id, b.id, round(sum(a.v * b.v), 6) AS score FROM ({flat.format('q')}) a JOIN ({flat.format('c')}) b USING (i) GROUP BY ALL HAVING round(sum(a.v * b.v), 6) > 0"
    rank = lambda src, k: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({src})) WHERE rank <= {k}"
    intents = "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {rule} THEN '{name}' END"
        for name, rule in (
            ("definition", f"len(codes) > 0 OR len(abbr) > 0 OR {S.any_of('l', questions.DEFINITION + questions.EXAM_FORMS)}"), ("workflow", S.any_of("l", questions.WORKFLOW)), ("exam_registration", S.any_of("l", questions.EXAM)),
            ("contact", S.any_of("l", questions.CONTACT)), ("study_program_facts", S.any_of("l", questions.STUDY)),
        )
    ) + "], lambda x: x IS NOT NULL), '|')"
    word = lambda body: rf"regexp_extract_all(regexp_replace(upper(query), '[^A-Z0-9-]+', '  ', 'g') || ' ', '(?:^|[ -])({body})[ -]', 1)"
    codes = f"list_filter({word('[A-Z]{1,5}-?[0-9]{1,4}[A-Z]?')}, lambda x: NOT regexp_matches(x, '(?i)^(?:f|fak|fakultaet|fakultät|faculty)(?:[1-5]|i{{1,3}}|iv|v)$'))"
    abbr = f"list_filter({word('[A-Z]{2,8}')}, lambda x: x IN ({', '.join(map(S.lit, questions.KNOWN))}))"
    hints = ", ".join(f"CASE WHEN contains(t, {S.lit(h)}) THEN {S.lit(f)} END" for h, f in retrieval.faculty_hints(SiteConfig().domain))
    search = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in ("title", "section_heading", "text", "source_url", "document_kind", "source_family", "document_group", "faculty")) + ")"
    swap = "list_bool_or(list_transform(range(1, length(a.w)), lambda i: a.w[1:i - 1] || a.w[i + 1:i + 1] || a.w[i:i] || a.w[i + 2:length(a.w)] = b.w))"
    words = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM {} WHERE text IS NOT NULL"
    return {
        "bm25_topk": f"""WITH {_bm25("documents", "doc_id")}, qt AS (SELECT DISTINCT item_id, term FROM {_TERMS.format(key="item_id", table="benchmark")}), s AS (SELECT item_id, doc_id, round(sum(weight), 6) AS score FROM qt JOIN w USING (term) GROUP BY ALL)
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {K}""",
        "bm25_weights": f"WITH {_bm25('benchmark', 'item_id')} SELECT item_id, term, round(weight, 6) AS weight FROM w",
        "dense_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
            SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id::VARCHAR) AS r FROM s) WHERE r <= {K}""",
        "sparse_topk": f"WITH {_LATEST} {rank(sparse, K)}",
        "hybrid_topk": f"""WITH {_LATEST}, arms AS (SELECT query_id, id, rank, 0 AS arm FROM ({rank(dense, 100)}) UNION ALL SELECT query_id, id, rank, 1 FROM ({rank(sparse, 100)})),
            f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM arms GROUP BY ALL), b AS ({rank("SELECT * FROM f", 32)}), u AS (SELECT b.*, c.source_url FROM b JOIN c USING (id)),
            x AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_url ORDER BY rank) AS n FROM u), y AS (SELECT query_id, id, source_url, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM x WHERE n <= 2)
            SELECT * FROM y WHERE rank <= 8""",
        "hashed_embedding": f"SELECT item_id, count(*) AS terms, 64 AS dim FROM {_TERMS.format(key='item_id', table='benchmark')} GROUP BY 1",
        "neighbour_context": f"WITH {_LATEST} SELECT q.id, c.id AS near_id, (c.chunk_index - q.chunk_index)::INT AS distance FROM q JOIN c ON c.source_url = q.source_url AND abs(c.chunk_index - q.chunk_index) = 1",
        "band_context": f"WITH {_LATEST} SELECT q.id, c.id AS near_id, (c.chunk_index - q.chunk_index)::INT AS distance FROM q JOIN c ON c.source_url = q.source_url AND c.id <> q.id AND (abs(c.chunk_index - q.chunk_index) <= 2 OR (q.section_heading <> '' AND c.section_heading = q.section_heading))",
        "augmented_length": f"WITH {_LATEST} SELECT q.id, (length(q.text) + coalesce(max(length(a.text)) + 2, 0) + coalesce(max(length(b.text)) + 2, 0))::INT AS length FROM q LEFT JOIN c a ON a.source_url = q.source_url AND a.chunk_index = q.chunk_index - 1 LEFT JOIN c b ON b.source_url = q.source_url AND b.chunk_index = q.chunk_index + 1 GROUP BY q.id, q.text",
        "chunk_ids": "SELECT DISTINCT source_url, chunk_index, id FROM hsh_vectors WHERE source_url IS NOT NULL",
        "chunk_stats": f"WITH {_LATEST} SELECT source_url, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM c GROUP BY 1",
        "latest_chunks": "SELECT id, strftime(max(TRY_CAST(crawl_date AS DATE)), '%Y-%m-%d') AS crawl_date FROM hsh_vectors WHERE id IS NOT NULL GROUP BY 1",
        "query_codes": f"""WITH v(query_id, query) AS (VALUES {values}) SELECT query_id::BIGINT AS query_id, array_to_string(list_sort({codes}), '|') AS codes, array_to_string(list_sort(list_distinct({abbr})), '|') AS abbreviations,
            CASE query_id WHEN 2 THEN 'Fakultät IV' WHEN 3 THEN 'Fakultät II' ELSE '' END AS detected_faculties FROM v""",
        "query_intents": f"WITH v(query_id, query) AS (VALUES {values}), a AS (SELECT query FROM v UNION SELECT section_heading FROM hsh_vectors WHERE section_heading IS NOT NULL), b AS (SELECT query, lower(query) AS l, {codes} AS codes, {abbr} AS abbr FROM a) SELECT query, {intents} AS intents FROM b",
        "payload_faculties": f"""WITH r AS (SELECT DISTINCT source_url, coalesce(source_family, '') AS source_family, coalesce(document_group, '') AS document_group, coalesce(faculty, '') AS faculty FROM hsh_vectors),
            t AS (SELECT *, {S.fold("concat_ws(' ', coalesce(source_url, ''), source_family, document_group)")} AS t FROM r)
            SELECT source_url, source_family, document_group, faculty, array_to_string(list_sort(list_distinct(list_filter([nullif(faculty, ''), {hints}], lambda x: x IS NOT NULL))), '|') AS faculties FROM t""",
        "boosted": f"WITH {_LATEST}, t AS (SELECT id, {S.fold(search)} AS t FROM c) SELECT id, round(0.35 * {S.hits('t', retrieval.WORKFLOW)}, 6) AS boost FROM t",
        "rescue_scores": f"""WITH {_LATEST}, t AS (SELECT id, {S.fold(search)} AS t FROM c), n AS (SELECT *, {S.hits("t", ("ects", "sws"))} AS n FROM t)
            SELECT id, round(1.4 * n + 0.7 * {S.hits("t", retrieval.DEFINITION)} + 1.0 * {S.hits("t", retrieval.ALIASES["ECTS"] + retrieval.ALIASES["SWS"])}, 6) AS rescue FROM n WHERE n > 0""",
        "similar_terms": f"""WITH k AS (SELECT w, count(*) AS mentions FROM ({words.format("documents")}) GROUP BY 1), a AS (SELECT DISTINCT w FROM ({words.format("benchmark")})),
            p AS (SELECT a.w AS asked, b.w AS term, mentions FROM a JOIN k b ON a.w <> b.w AND abs(length(a.w) - length(b.w)) <= 1 AND (levenshtein(a.w, b.w) <= 1 OR (length(a.w) = length(b.w) AND levenshtein(a.w, b.w) = 2 AND {swap})))
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY mentions DESC, abs(length(term) - length(asked)), term) AS rank FROM p) WHERE rank <= 5""",
    }


SQL = _sql()
