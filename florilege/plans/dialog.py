"""Registered queries of turns, evaluation and streams, and relational additions over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.functions import answers
from florilege.operators import evaluation, retrieval
from florilege.plans import sql as S
from florilege.plans.search import _LATEST, _chunks, _queries
from florilege.plans.web import table
from florilege.streaming import jobs

# --- turns: the events of a user stand for the turns of a conversation ------------------------------------------------


def memory_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "user_id", "event_type")
    return answers.memory(rows, "user_id", "event_id", "event_type").select("event_id", "memory", F.coalesce("previous", F.lit("")).alias("previous"))


def consecutive_repeats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "user_id", "event_type")
    last = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("last", last).where(~F.col("event_type").eqNullSafe(F.col("last"))).select("event_id", "user_id", "event_type")


def paragraph_collapse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cleaned_body", "file", "text").distinct()
    twice = F.concat("text", F.lit("\n\n"), F.regexp_extract("text", r"(?s)([^\n]+)\s*$", 1))
    return rows.select("file", F.length(answers.collapse_paragraphs(twice)).alias("length"), F.length(answers.clean_answer(F.concat(F.lit("Antwort.\n\nQuellen:\n- a\n\nQuellen:\n"), "text"))).alias("answer"))


def request_rate_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-3_599_999_999, 0)
    return rows.select("event_id", F.count(F.lit(1)).over(w).alias("requests"))


def request_admission(spark: SparkSession, d: str) -> DataFrame:
    return jobs.admission(table(spark, d, "events", "user_id", "ts"), "user_id", "ts", 2, 3600.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("wait"), 3).alias("waited"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "event_id", "props")
    whole = answers.json_object(F.concat(F.lit("Antwort: "), "props"))
    return rows.select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json(whole), "$.k", "long"), F.lit(-1)).alias("k"))


# --- evaluation -------------------------------------------------------------------------------------------------------


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _chunks(spark, d, "source_url", "chunk_index", "sparse_indices", "sparse_values")
    policy = F.element_at(F.array(*[F.lit(p) for p in ("exact_gold_source", "accepted_sources", "official_any")]), F.col("chunk_index") % 3 + 1)
    queries = _queries(rows)
    cases = queries.select(F.col("query_id").alias("case_id"), "source_url", policy.alias("source_policy"), F.array(F.concat("source_url", F.lit("/"))).alias("accepted_urls"))
    found = retrieval.sparse_dot(rows, queries, "id", "query_id", "sparse_indices", "sparse_values", 7).where("id <> query_id")
    hits = retrieval.ranked(found.drop("rank"), "query_id", "id", 6).join(rows.select("id", "source_url"), "id")
    return cases, hits.select(F.col("query_id").alias("case_id"), "rank", "source_url")


def source_policy(spark: SparkSession, d: str) -> DataFrame:
    cases, hits = _cases(spark, d)
    return evaluation.source_check(cases, hits, S.SITE.domain)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    cases, hits = _cases(spark, d)
    checked = evaluation.source_check(cases, hits, S.SITE.domain).join(cases.select("case_id", F.col("source_policy").alias("run_id")), "case_id")
    return evaluation.run_summary(checked)


# --- streams ----------------------------------------------------------------------------------------------------------


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    return jobs.run(jobs.upsert_decisions(jobs.stream(spark, f"{d}/url_decisions.parquet")), "complete")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    events = jobs.stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_type", "ts")
    return jobs.run(jobs.distinct_events(events, "ts", "400 days", "user_id", "event_type").select("user_id", "event_type"), "append")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    events = jobs.stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run(jobs.window_counts(events, "ts", "1 day", None, "event_type"), "complete")


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.window_counts(events, "ts", "2 days", "1 day", "event_type")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.session_window("ts", "6 hours")
    return events.groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


# --- additions: relational coverage over the star schema --------------------------------------------------------------


def join_matrix(spark: SparkSession, d: str) -> DataFrame:
    c, o, n = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "nation")
    has = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey", "c_nationkey", F.lit("with").alias("orders"))
    none = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_nationkey", F.lit("without").alias("orders"))
    both = has.unionByName(none).join(n, F.col("c_nationkey") == n["n_nationkey"], "full_outer")
    return both.groupBy("n_name", "orders").agg(F.count("c_custkey").alias("customers"))


def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    return rows.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def window_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return rows.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-1, 1)), 2).alias("around"), F.coalesce(F.lag("o_orderkey").over(w), F.lit(0)).alias("before"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    pages_ = table(spark, d, "hsh_vectors", F.col("source_url").alias("u")).distinct()
    filed = table(spark, d, "cleaned_body", F.col("source_url").alias("u")).distinct()
    seen = table(spark, d, "url_decisions", F.col("normalized_url").alias("u")).distinct()
    parts = {"union": pages_.union(filed).distinct(), "intersect": pages_.intersect(seen), "except": seen.exceptAll(pages_)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("operation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = (
    memory_window, consecutive_repeats, paragraph_collapse, request_rate_window, request_admission, event_properties, source_policy, run_summary, stream_upsert, stream_dedup, stream_windows, sliding_windows, session_windows,
    join_matrix, cube_rollup, window_frames, set_operations, revenue_by_nation,
)


def _sql() -> dict[str, str]:
    loose = lambda c: f"lower((CASE WHEN regexp_extract({c}, '{S.PARTS}', 1) <> '' THEN regexp_extract({c}, '{S.PARTS}', 1) || '://' ELSE '' END) || regexp_extract({c}, '{S.PARTS}', 2) || regexp_replace(regexp_replace({S.path(c)}, ';[^/]*$', ''), '/+$', '') || (CASE WHEN regexp_extract({c}, '{S.PARTS}', 4) <> '' THEN '?' || regexp_extract({c}, '{S.PARTS}', 4) ELSE '' END))"
    flat = "SELECT id, unnest(sparse_indices) AS i, unnest(sparse_values)::DOUBLE AS v FROM {}"
    checked = f"""WITH {_LATEST}, s AS (SELECT a.id AS query_id, b.id, round(sum(a.v * b.v), 6) AS score FROM ({flat.format("q")}) a JOIN ({flat.format("c")}) b USING (i) GROUP BY ALL HAVING round(sum(a.v * b.v), 6) > 0),
        t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 7 AND id <> query_id),
        r AS (SELECT * FROM (SELECT query_id AS case_id, t.id, c.source_url, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, t.id) AS rank FROM t JOIN c ON c.id = t.id) WHERE rank <= 6),
        k AS (SELECT id AS case_id, source_url, ['exact_gold_source', 'accepted_sources', 'official_any'][chunk_index % 3 + 1] AS policy FROM q),
        x AS (SELECT k.case_id, k.policy, min(rank) FILTER ({loose("r.source_url")} = {loose("k.source_url")}) AS gold_rank, min(rank) FILTER ({S.host("r.source_url")} = '{S.SITE.domain}' OR ends_with({S.host("r.source_url")}, '.{S.SITE.domain}')) AS host_rank FROM k LEFT JOIN r USING (case_id) GROUP BY ALL),
        y AS (SELECT case_id, policy, gold_rank, CASE WHEN policy = 'official_any' THEN host_rank ELSE gold_rank END AS matched_rank FROM x),
        z AS (SELECT *, matched_rank IS NOT NULL AS satisfied, (CASE WHEN matched_rank IS NULL THEN 0 WHEN matched_rank <= 1 THEN 5 WHEN matched_rank <= 3 THEN 4 WHEN matched_rank <= 6 THEN 3 ELSE 2 END)::INT AS score FROM y)"""
    from florilege.plans.web import SQL as WEB

    return {
        "memory_window": "SELECT event_id, array_to_string(list(event_type) OVER w, '|') AS memory, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
        "consecutive_repeats": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events) WHERE event_type IS DISTINCT FROM l",
        "request_rate_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS requests FROM events",
        "event_properties": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events",
        "source_policy": f"{checked} SELECT case_id, gold_rank, matched_rank, satisfied, score FROM z",
        "run_summary": f"{checked} SELECT policy AS run_id, count(*) AS cases, round_even(avg(score), 2) AS mean_score, round(avg(matched_rank), 4) AS mean_rank, count_if(satisfied)::BIGINT AS satisfied, count_if(matched_rank <= 1)::BIGINT AS hit_at_1, count_if(matched_rank <= 3)::BIGINT AS hit_at_3 FROM z GROUP BY 1",
        "stream_upsert": WEB["decision_store_upsert"],
        "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
        "stream_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "sliding_windows": "SELECT date_trunc('day', ts) - to_days(k::INT) AS window_start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL",
        "session_windows": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
            b AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a), c AS (SELECT user_id, g, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
        "join_matrix": "WITH x AS (SELECT c_custkey, c_nationkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'with' ELSE 'without' END AS orders FROM customer) SELECT n_name, orders, count(c_custkey) AS customers FROM x FULL JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
        "cube_rollup": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
        "window_frames": "SELECT o_orderkey, row_number() OVER w AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS around, coalesce(lag(o_orderkey) OVER w, 0) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
        "set_operations": """WITH p AS (SELECT DISTINCT source_url AS u FROM hsh_vectors), f AS (SELECT DISTINCT source_url AS u FROM cleaned_body), s AS (SELECT DISTINCT normalized_url AS u FROM url_decisions)
            SELECT 'union' AS operation, count(*) AS n FROM (SELECT * FROM p UNION SELECT * FROM f) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM s) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM p)""",
        "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    }


SQL = _sql()
