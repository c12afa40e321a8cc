"""Registered queries over crawled pages: URLs, decisions, curation and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.functions import urls as U
from florilege.operators import crawl, pages, store
from florilege.plans import sql as S

URLS = "SELECT source_url AS url FROM hsh_vectors WHERE source_url IS NOT NULL UNION SELECT normalized_url FROM url_decisions WHERE normalized_url IS NOT NULL"


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def _urls(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "hsh_vectors").select(F.col("source_url").alias("url")).union(table(spark, d, "url_decisions").select("normalized_url"))
    return both.where("url IS NOT NULL").distinct()


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return U.with_normalized(_urls(spark, d), "url")


def url_decision(spark: SparkSession, d: str) -> DataFrame:
    return U.with_decision(url_normalize(spark, d)).select("url", "decision", "reason", "priority_score")


def url_slug(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("url", U.slug(F.col("url")).alias("slug"), U.loose(F.col("url")).alias("loose"), U.suffix(U.part(F.col("url"), 3)).alias("suffix"))


def url_decision_stats(spark: SparkSession, d: str) -> DataFrame:
    return pages.decision_statistics(U.with_decision(url_normalize(spark, d)))


def host_histogram(spark: SparkSession, d: str) -> DataFrame:
    return pages.host_histogram(table(spark, d, "hsh_vectors", "source_url"), "source_url")


def decision_store_upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(table(spark, d, "url_decisions"))


def decision_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = url_normalize(spark, d).select("normalized_url").distinct()
    return store.lookup(decision_store_upsert(spark, d), keys)


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cleaned_body", "file", "source_url", "text").where("file IS NOT NULL").distinct()


def page_title_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hsh_vectors", "id", "title", "text", "source_url").distinct()
    return rows.select("id", pages.title_of(F.col("title"), F.col("text"), F.col("source_url")).alias("title")).distinct()


def body_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.body_links(_bodies(spark, d))


def corpus_diff(spark: SparkSession, d: str) -> DataFrame:
    bodies = _bodies(spark, d)
    newest = bodies.agg(F.max(crawl.file_date())).first()[0]
    return crawl.corpus_diff(bodies, pages.body_links(bodies), newest)


def frontier_depth(spark: SparkSession, d: str) -> DataFrame:
    links = U.with_normalized(pages.body_links(_bodies(spark, d), "source_url"), "source_url", "src")
    edges = U.with_normalized(links, "link", "dst").select("src", "dst")
    seeds = edges.where(U.host(F.col("src")).startswith("f1.")).select(F.col("src").alias("url"))
    return crawl.frontier(edges, seeds).select("url", F.col("depth").cast("long").alias("depth"), "parent")


def errors_with_referrers(spark: SparkSession, d: str) -> DataFrame:
    blocked = table(spark, d, "url_decisions").where("decision = 'block'").select(F.col("normalized_url").alias("url"), F.col("reason").alias("error")).distinct()
    found = U.with_normalized(pages.body_links(_bodies(spark, d), "source_url"), "link", "url").select("url", F.col("source_url").alias("referrer"))
    return crawl.errors_with_referrers(blocked, found)


def crawl_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _bodies(spark, d).withColumn("title", F.lit(""))
    return pages.crawl_gate(rows, body="text").select("file", "word_count", "link_count", "duplicate_short_lines", "reasons", "keep")


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return _bodies(spark, d).select("file", T.word_count(c).alias("words"), T.token_count(c).alias("tokens"), T.table_lines(c).alias("tables"))


def language_markers(spark: SparkSession, d: str) -> DataFrame:
    german, english = T.marker_counts(F.col("text"), F.lit(""))
    rows = _bodies(spark, d).select("file", german.alias("german"), english.alias("english"))
    return rows.withColumn("language", T.marker_language(F.col("german"), F.col("english")))


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.older_versions(_bodies(spark, d)).withColumns({"title": F.lit(""), "faculty": F.lit(""), "content_type": F.when(F.lower("source_url").endswith(".pdf"), "pdf").otherwise("html")})
    return pages.assess(rows, "source_url", "title", "text", "content_type", "faculty", "duplicate")


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return _assessed(spark, d).select("file", "words", "tables", "language", "document_kind", "source_family", "document_group", "topic_tags", "reasons", "score", "keep", "kept")


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return pages.quality_report(_assessed(spark, d))


def quality_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pages.reason_counts(_assessed(spark, d))


def quality_against_filed(spark: SparkSession, d: str) -> DataFrame:
    filed = table(spark, d, "quality_assessment", "file", "keep").where("file IS NOT NULL").groupBy("file").agg(F.bool_or("keep").alias("filed"))
    return _assessed(spark, d).join(filed, "file").groupBy("kept", "filed").agg(F.count(F.lit(1)).alias("n"))


def version_dedup(spark: SparkSession, d: str) -> DataFrame:
    return pages.older_versions(table(spark, d, "cleaned_body", "file").where("file IS NOT NULL").distinct())


def page_faculties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hsh_vectors", "source_url").where("source_url IS NOT NULL").distinct()
    return rows.select("source_url", pages.page_faculty(F.col("source_url"), F.lit("")).alias("page"), pages.chunk_faculty(F.col("source_url")).alias("chunk"))


def clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    return pages.clean_bodies(table(spark, d, "cleaned_body", "file", "source_url", "text"), "file", "source_url", "text")


QUERIES = (
    url_normalize, url_decision, url_slug, url_decision_stats, host_histogram, decision_store_upsert, decision_lookup, page_title_fallback, body_links, corpus_diff, frontier_depth, errors_with_referrers, crawl_gate,
    text_counts, language_markers, quality_score, quality_report, quality_reasons, quality_against_filed, version_dedup, page_faculties, clean_bodies,
)


def _sql() -> dict[str, str]:
    norm, bodies = S.normalized(URLS), "(SELECT DISTINCT file, source_url, text FROM cleaned_body WHERE file IS NOT NULL)"
    store_ = """SELECT normalized_url, max({'t': coalesce(last_seen, first_seen), 's': coalesce(last_source, first_source, ''), 'd': decision, 'r': reason}) AS l,
                min({'t': first_seen, 's': coalesce(first_source, '')}) AS f, sum(seen_count)::BIGINT AS seen_count FROM url_decisions GROUP BY 1"""
    link = r"""list_distinct(list_transform(list_concat(regexp_extract_all(text, '\]\((https?://[^)\s]+)\)', 1), regexp_extract_all(text, '(https?://[^\s<>"()\[\]]+)', 1)), lambda x: regexp_replace(x, '[.,;:!?]+$', '')))"""
    links = f"SELECT DISTINCT {{key}}, unnest({link}) AS link FROM {bodies} WHERE text IS NOT NULL"
    file_date = r"TRY_CAST(nullif(regexp_extract(file, '(?:^|/)(\d{4}-\d{2}-\d{2})_[^/]*$', 1), '') AS DATE)"
    g, e = S.marker_counts("text", "''")
    short = r"lower(trim(regexp_replace(l, '^[#*\-\d.\s]+', '')))"
    title = "lower(source_url || ' ')"
    from florilege.operators.pages import ACTIONABLE, LINK, LOW_VALUE_TITLES, ROMAN

    codes = lambda test: " ".join(f"WHEN {test.format(c=c)} THEN '{n}'" for c, n in ROMAN)
    two = lambda a, b: f"lk AS ({links.format(key='source_url')}), {S.normalized(f'SELECT DISTINCT {a} AS url FROM lk UNION SELECT DISTINCT {b} FROM lk')}"
    return {
        "url_normalize": f"WITH {norm} SELECT * FROM n",
        "url_decision": f"WITH {norm}, {S.decided('n')} SELECT url, decision, reason, priority_score FROM d",
        "url_slug": rf"""WITH {norm} SELECT url, CASE WHEN s = '' THEN 'index' ELSE s END AS slug, lower((CASE WHEN sc <> '' THEN sc || '://' ELSE '' END) || au || regexp_replace(regexp_replace(pa, ';[^/]*$', ''), '/+$', '') || (CASE WHEN qu <> '' THEN '?' || qu ELSE '' END)) AS loose,
            regexp_extract(lower(regexp_replace(pa, '/+$', '')), '[^/](\.[^./]+)$', 1) AS suffix
            FROM (SELECT url, regexp_extract(url, '{S.PARTS}', 1) AS sc, regexp_extract(url, '{S.PARTS}', 2) AS au, regexp_extract(url, '{S.PARTS}', 3) AS pa, regexp_extract(url, '{S.PARTS}', 4) AS qu,
                  regexp_replace(regexp_replace({S.fold(S.path("url"))}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM n)""",
        "url_decision_stats": f"""WITH {norm}, {S.decided("n")}, s AS (SELECT decision, reason, normalized_url, row_number() OVER (PARTITION BY decision, reason ORDER BY normalized_url) AS r FROM (SELECT DISTINCT decision, reason, normalized_url FROM d WHERE decision = 'block')),
            x AS (SELECT decision, reason, string_agg(normalized_url, ' ' ORDER BY normalized_url) AS examples FROM s WHERE r <= 5 GROUP BY ALL)
            SELECT d.decision, d.reason, count(*) AS n, coalesce(any_value(x.examples), '') AS examples FROM d LEFT JOIN x USING (decision, reason) GROUP BY ALL""",
        "host_histogram": f"SELECT {S.host('source_url')} AS host, count(*) AS n FROM hsh_vectors WHERE {S.host('source_url')} <> '' GROUP BY 1 ORDER BY n DESC, host LIMIT 8",
        "decision_store_upsert": f"WITH s AS ({store_}) SELECT normalized_url, l.d AS decision, l.r AS reason, f.t AS first_seen, l.t AS last_seen, f.s AS first_source, l.s AS last_source, seen_count FROM s",
        "decision_lookup": f"WITH {norm}, s AS ({store_}) SELECT k.normalized_url, l.d AS decision, l.r AS reason FROM (SELECT DISTINCT normalized_url FROM n) k LEFT JOIN s USING (normalized_url)",
        "page_title_fallback": "SELECT DISTINCT id, coalesce(nullif(trim(title), ''), nullif(trim(regexp_extract(text, '(?m)^# (.*)$', 1)), ''), source_url) AS title FROM hsh_vectors",
        "body_links": f"SELECT * FROM ({links.format(key='file')}) WHERE link <> ''",
        "corpus_diff": f"""WITH m AS (SELECT max({file_date}) AS m FROM cleaned_body), k AS (SELECT source_url AS url, max({file_date}) AS d FROM cleaned_body WHERE source_url IS NOT NULL AND file IS NOT NULL GROUP BY 1)
            SELECT url, CASE WHEN d >= (SELECT m FROM m) - INTERVAL 7 DAY THEN 'fresh' ELSE 'stale' END AS state FROM k UNION ALL
            SELECT DISTINCT link, 'discovered' FROM ({links.format(key="file")}) WHERE link <> '' AND link NOT IN (SELECT url FROM k)""",
        "frontier_depth": f"""WITH RECURSIVE {two("source_url", "link")}, e AS (SELECT DISTINCT a.normalized_url AS src, b.normalized_url AS dst FROM lk JOIN n a ON a.url = lk.source_url JOIN n b ON b.url = lk.link WHERE link <> ''),
            f AS (SELECT DISTINCT src AS url, 0::BIGINT AS depth FROM e WHERE starts_with({S.host("src")}, 'f1.') UNION SELECT dst, depth + 1 FROM f JOIN e ON src = f.url AND src <> dst WHERE depth < 10),
            b AS (SELECT url, min(depth) AS depth FROM f GROUP BY 1)
            SELECT b.url, b.depth, (SELECT min(p.url) FROM e JOIN b p ON p.url = e.src WHERE e.dst = b.url AND e.src <> e.dst AND p.depth = b.depth - 1) AS parent FROM b""",
        "errors_with_referrers": f"""WITH {two("source_url", "link")}, r AS (SELECT normalized_url AS url, min(source_url) AS referrer FROM lk JOIN n ON n.url = lk.link WHERE link <> '' GROUP BY 1)
            SELECT b.url, coalesce(referrer, '(unknown)') AS referrer, error FROM (SELECT DISTINCT normalized_url AS url, reason AS error FROM url_decisions WHERE decision = 'block') b LEFT JOIN r USING (url)""",
        "crawl_gate": rf"""WITH b AS (SELECT * FROM {bodies}), l AS (SELECT file, source_url, text, unnest({S.LINES.format("text")}) AS l FROM b), k AS (SELECT file, source_url, text, {short} AS k, count(*) AS n FROM l WHERE length({short}) BETWEEN 3 AND 60 GROUP BY ALL),
            s AS (SELECT file, source_url, text, sum(n)::BIGINT AS n FROM k WHERE n >= 3 GROUP BY ALL),
            x AS (SELECT b.*, {S.token_count("b.text")} AS word_count, len(regexp_extract_all(b.text, '{LINK}')) AS link_count, coalesce(s.n, 0) AS duplicate_short_lines FROM b LEFT JOIN s USING (file, source_url, text)),
            y AS (SELECT *, array_to_string(list_filter([CASE WHEN word_count < 35 THEN 'zu_wenig_text:' || word_count END, CASE WHEN link_count >= 12 AND word_count / greatest(link_count, 1) < 7 THEN 'zu_viele_links_fuer_zu_wenig_prosa' END,
                CASE WHEN duplicate_short_lines >= 6 AND word_count < 220 THEN 'vermutlich_navigation_footer_fragmente' END,
                CASE WHEN {S.any_of(title, LOW_VALUE_TITLES)} AND NOT {S.any_of(title, ACTIONABLE)} AND word_count < 220 THEN 'generische_oeffnungszeiten_promo_uebersicht' END], lambda v: v IS NOT NULL), '|') AS reasons FROM x)
            SELECT file, word_count, link_count, duplicate_short_lines, reasons, reasons = '' AS keep FROM y""",
        "text_counts": f"SELECT file, {S.word_count('text')} AS words, {S.token_count('text')} AS tokens, {S.table_lines('text')} AS tables FROM {bodies}",
        "language_markers": f"SELECT file, g AS german, e AS english, {S.LANGUAGE} AS language FROM (SELECT file, {g} AS g, {e} AS e FROM {bodies})",
        "quality_score": f"WITH {S.assessed()} SELECT * FROM a",
        "quality_report": f"WITH {S.assessed()} SELECT document_kind, count(*) AS pages, count_if(kept)::BIGINT AS kept, count_if(NOT kept)::BIGINT AS rejected, sum(words)::BIGINT AS words FROM a GROUP BY ROLLUP (document_kind)",
        "quality_reasons": rf"WITH {S.assessed()} SELECT regexp_replace(r, ':\d+$', '') AS reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS r FROM a WHERE reasons <> '') GROUP BY 1",
        "quality_against_filed": f"WITH {S.assessed()}, q AS (SELECT file, bool_or(keep) AS filed FROM quality_assessment GROUP BY 1) SELECT kept, filed, count(*) AS n FROM a JOIN q USING (file) GROUP BY ALL",
        "version_dedup": f"WITH f AS (SELECT DISTINCT file FROM cleaned_body WHERE file IS NOT NULL), m AS (SELECT {S.version()} AS s, max(file) AS latest FROM f GROUP BY 1) SELECT file, file < latest AS duplicate FROM f JOIN m ON s = {S.version()}",
        "page_faculties": f"""SELECT source_url, CASE {codes("starts_with(lower(source_url), 'https://{c}.') OR contains(lower(source_url), '/{c}/')")} ELSE '' END AS page,
            CASE {codes("contains(lower(source_url), '/{c}/')")} WHEN starts_with({S.host("lower(source_url)")}, 'karriere.') THEN 'Karriere' WHEN starts_with({S.host("lower(source_url)")}, 'bibliothek.') THEN 'Bibliothek'
                 WHEN starts_with({S.host("lower(source_url)")}, 'international.') THEN 'International' ELSE '' END AS chunk FROM (SELECT DISTINCT source_url FROM hsh_vectors WHERE source_url IS NOT NULL)""",
    }


SQL = _sql()
