"""Guided retrieval: variants of a question searched at once, fused, boosted, rescued, capped and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.config import RetrievalConfig
from florilege.operators import retrieval
from florilege.storage import cut


def search(chunks: DataFrame, asked: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, id, source_url, score, boost, variants, rank) of every question.

    ``chunks`` has id, source_url, text, search_text and faculties; ``asked`` is assessed and has variants. All variants
    of all questions are rows of one search. Ranks within a variant feed the fusion, boosts of the question's intents
    are added, definition questions get chunks rescued from their first URLs, and URLs are capped.
    """
    variants = asked.select("query_id", F.posexplode("variants").alias("variant", "query")).select("query_id", F.concat_ws("/", F.col("query_id").cast("string"), F.col("variant").cast("string")).alias("vid"), "query")
    index = retrieval.postings(chunks.select("id", "text"), "id", "text", config, only=retrieval.terms(variants, "vid", "query"))
    best = retrieval.bm25(index, variants, "id", "vid", "query", config.candidates)
    runs = best.join(variants.select("vid", "query_id"), "vid").join(chunks.select("id", "source_url"), "id")
    runs = retrieval.capped(runs.select("vid", "query_id", "id", "source_url", "rank"), "vid", "source_url", config.per_url, config.k * config.buffer)
    fused = runs.groupBy("query_id", "id", "source_url").agg(F.sum(F.lit(1.0) / (F.lit(config.rrf) + F.col("rank"))).alias("score"), F.countDistinct("vid").alias("variants"))
    facts = asked.select("query_id", "query", "intents", "retrieval_terms", "detected_faculties")
    text = chunks.select("id", "search_text", "faculties")

    def boosted(hits: DataFrame) -> DataFrame:
        rows = retrieval.with_boost(hits.join(facts, "query_id").join(text, "id"))
        return rows.select("query_id", "id", "source_url", F.round(F.col("score") + F.col("boost"), 6).alias("score"), "boost", "variants")

    # A few rows a question, read by the rescue and by the merge.
    first = cut(retrieval.ranked(boosted(fused), "query_id", "id", config.k * config.buffer))
    more = retrieval.rescued(first, chunks.select("id", "source_url", "search_text"), facts.select("query_id", "intents", "retrieval_terms"))
    extra = boosted(more.join(chunks.select("id", "source_url"), "id").withColumn("variants", F.lit(0).cast("long")))
    merged = retrieval.ranked(first.drop("rank").unionByName(extra), "query_id", "id", config.k * config.buffer)
    return retrieval.capped(merged, "query_id", "source_url", config.per_url, config.k)


def follow_up(hits: DataFrame, chunks: DataFrame, plans: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, id, rank): hits, then what a follow-up plan adds: neighbours, or the section, of the target hit.

    ``plans`` has query_id and requested_action (neighbor_chunks, full_section, or anything else for none); the target
    is the first hit. Hits keep their order, additions follow by place; at most ``k`` + 2.
    """
    target = hits.where("rank = 1").select("query_id", "id").join(plans, "query_id")
    near = retrieval.neighbours(target.where("requested_action IN ('neighbor_chunks', 'full_section')"), chunks, reach=2, same_section=True)
    action = plans.select("query_id", "requested_action")
    near = near.join(action, "query_id").where((F.col("requested_action") == "full_section") | (F.abs("distance") <= 2))
    extra = near.join(hits.select("query_id", F.col("id").alias("near_id")), ["query_id", "near_id"], "left_anti").groupBy("query_id", F.col("near_id").alias("id")).agg(F.min("distance").alias("place"))
    rows = hits.select("query_id", "id", F.lit(0).alias("s"), F.col("rank").alias("o")).unionByName(extra.select("query_id", "id", F.lit(1).alias("s"), F.col("place").cast("long").alias("o")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("s", "o", "id")).cast("long")).where(F.col("rank") <= k + 2).select("query_id", "id", "rank")


def planned_action(question: DataFrame) -> DataFrame:
    """``question`` (query, detected_faculties, present_faculties) with requested_action and reason of the follow-up."""
    c = F.col
    low = F.lower("query")
    missing = F.array_except("detected_faculties", "present_faculties")
    exam = low.rlike("pruefungsanmeldung|prüfung anmelden|campusmanagement")
    compare = (F.size("detected_faculties") >= 2) | low.rlike("unterschied|vergleich")
    rules = F.when(c("query").rlike(r"\b[A-Z]{1,4}\d{1,3}\b"), F.struct(F.lit("full_section").alias("a"), F.lit("definition_missing").alias("r")))
    rules = rules.when(low.rlike("heute|aktuell|jetzt"), F.struct(F.lit("").alias("a"), F.lit("date_currentness_unclear").alias("r")))
    rules = rules.when((F.size("detected_faculties") == 1) & exam & (F.size(missing) > 0), F.struct(F.lit("new_search").alias("a"), F.lit("procedure_incomplete").alias("r")))
    rules = rules.when(compare & (F.size(missing) > 0), F.struct(F.lit("new_search").alias("a"), F.lit("comparison_incomplete").alias("r")))
    return question.withColumn("_p", rules).withColumns({"requested_action": F.coalesce("_p.a", F.lit("")), "reason": F.coalesce("_p.r", F.lit(""))}).drop("_p")
