"""Evaluation of retrieval and answers: source policies, scores, diagnostics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import urls as U

# Fields of the evidence rubric, and verdicts.
RUBRIC = ("source_retrieval", "evidence_sufficiency", "answer_grounding", "citation_support", "refusal_quality")
VERDICTS = ("fully_grounded", "mostly_grounded", "partially_grounded", "unsupported", "contradicted", "wrong_source", "retrieval_failed")


def score_of_rank(rank: Column) -> Column:
    """5 for the first place, 4 up to the third, 3 up to the sixth, 2 beyond, 0 if absent."""
    return F.when(rank.isNull(), 0).when(rank <= 1, 5).when(rank <= 3, 4).when(rank <= 6, 3).otherwise(2).cast("int")


def source_check(cases: DataFrame, results: DataFrame, official: str) -> DataFrame:
    """(case_id, gold_rank, matched_rank, satisfied, score) of every case.

    ``cases`` has case_id, source_url, source_policy and accepted_urls; ``results`` case_id, rank and source_url. The
    policy official_any accepts any page of the official domain, exact_gold_source and accepted_sources the URLs
    listed, compared in their loose form. A case without any target is satisfied.
    """
    urls = F.array_distinct(F.filter(F.concat(F.array(F.coalesce("source_url", F.lit(""))), F.coalesce("accepted_urls", F.array().cast("array<string>"))), lambda u: u != ""))
    cases = cases.withColumn("_urls", urls)
    targets = cases.select("case_id", F.explode("_urls").alias("u")).select("case_id", U.loose(F.col("u")).alias("u")).distinct()
    hits = results.select("case_id", "rank", U.loose(F.col("source_url")).alias("u"), U.host(F.col("source_url")).alias("h"))
    listed = hits.join(targets, ["case_id", "u"]).groupBy("case_id").agg(F.min("rank").alias("listed_rank"))
    gold = hits.join(cases.select("case_id", U.loose(F.col("source_url")).alias("u")), ["case_id", "u"]).groupBy("case_id").agg(F.min("rank").alias("gold_rank"))
    inside = (F.col("h") == official) | F.col("h").endswith("." + official)
    by_host = hits.where(inside).groupBy("case_id").agg(F.min("rank").alias("host_rank"))
    rows = cases.join(listed, "case_id", "left").join(gold, "case_id", "left").join(by_host, "case_id", "left")
    any_host = F.col("source_policy") == "official_any"
    free = (F.size("_urls") == 0) & ~any_host
    rows = rows.withColumn("matched_rank", F.when(any_host, F.col("host_rank")).otherwise(F.col("listed_rank")))
    return rows.select("case_id", "gold_rank", "matched_rank", (free | F.col("matched_rank").isNotNull()).alias("satisfied"), F.when(free, 5).otherwise(score_of_rank(F.col("matched_rank"))).cast("int").alias("score"))


def clean_score(value: Column) -> Column:
    """A score of 0 to 5 out of untrusted text; 0 if it is none."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(value.try_cast("int"), F.lit(0))))


def overall(*scores: Column) -> Column:
    """Sum of five scores as a share of 25 in percent, to one decimal, halves to even."""
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return F.bround(total / (5 * len(scores)) * 100, 1)


def finalize(judged: DataFrame) -> DataFrame:
    """Judge's scores made consistent with the source check (columns of RUBRIC, verdict, satisfied, score).

    The retrieval score is the check's; an unmet policy caps sufficiency and citation at 2 and turns a grounded
    verdict into wrong_source; an unknown verdict becomes partially_grounded, or retrieval_failed if unmet.
    """
    c = F.col
    out = judged.withColumns({f: clean_score(c(f)) for f in RUBRIC})
    cap = lambda f: F.when(c("satisfied"), c(f)).otherwise(F.least(c(f), F.lit(2)))
    out = out.withColumns({"source_retrieval": c("score"), "evidence_sufficiency": cap("evidence_sufficiency"), "citation_support": cap("citation_support")})
    v = F.lower(F.coalesce(c("verdict"), F.lit("")))
    known = F.when(v.isin(*VERDICTS), v).otherwise(F.when(c("satisfied"), "partially_grounded").otherwise("retrieval_failed"))
    out = out.withColumn("verdict", F.when(~c("satisfied") & known.isin("fully_grounded", "mostly_grounded"), "wrong_source").otherwise(known))
    return out.withColumn("overall_score", overall(*[c(f) for f in RUBRIC]))


def diagnostics(rows: DataFrame) -> DataFrame:
    """``rows`` with failure_types (sorted, joined by ``|``), stage_gap and human_review.

    Needs stage_1, stage_2, missing_required, missing_optional, forbidden, satisfied, retrieved, verdict, unsupported,
    evidence_sufficiency, answer_grounding, citation_support, clarification_expected, dialog_behavior, refused,
    expected_behavior and fairness_risk.
    """
    c = F.col
    rows = rows.withColumn("stage_gap", F.bround(c("stage_2") - c("stage_1"), 1))
    gap = c("stage_gap")
    rules = [
        (c("missing_required"), "missing_required_fact"), (c("missing_optional") & (c("stage_1") < 90), "missing_optional_fact"), (c("forbidden") | c("unsupported"), "hallucination"),
        ((~c("satisfied") & c("retrieved")) | (c("verdict") == "wrong_source"), "wrong_source_retrieved"), ((~c("satisfied") & ~c("retrieved")) | (c("verdict") == "retrieval_failed"), "retrieval_failed"),
        (c("satisfied") & (c("evidence_sufficiency") >= 3) & (c("answer_grounding") <= 2), "answer_ignored_evidence"), ((c("citation_support") <= 2) & c("retrieved"), "citation_problem"),
        (c("clarification_expected") & (c("dialog_behavior") <= 2), "should_have_clarified"), (c("refused") & (c("expected_behavior") == "direct_answer"), "wrong_refusal"),
        (F.abs(gap) >= 30, "stage_disagreement"), (gap >= 30, "reference_too_strict"),
    ]
    rows = rows.withColumn("_f", F.array_sort(F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))))
    risk = F.lower("fairness_risk")
    review = F.array_contains("_f", "stage_disagreement") | F.array_contains("_f", "reference_too_strict") | F.array_contains("_f", "source_conflict") | risk.isin("hoch", "high") | ((risk == "mittel") & (F.size("_f") > 0))
    return rows.withColumns({"failure_types": F.array_join("_f", "|"), "human_review": review}).drop("_f")


def run_summary(results: DataFrame) -> DataFrame:
    """(run_id, cases, mean_score, mean_rank, satisfied, hit_at_1, hit_at_3) of each run of checked cases."""
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("cases"), F.bround(F.avg("score"), 2).alias("mean_score"), F.round(F.avg("matched_rank"), 4).alias("mean_rank"), F.count_if("satisfied").alias("satisfied"),
        F.count_if(F.col("matched_rank") <= 1).alias("hit_at_1"), F.count_if(F.col("matched_rank") <= 3).alias("hit_at_3"),
    )


def remaining(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases without a result yet, in the order of their ids."""
    return cases.join(done.select("case_id"), "case_id", "left_anti").withColumn("position", F.row_number().over(Window.orderBy("case_id")))
