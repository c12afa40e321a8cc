"""Glossary of a corpus: definitions, look-up, and terms that resemble a question's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.functions.ids import joined_id

# Forms of terms and pairs, and markers of definitions.
TERM = r"[A-ZÄÖÜ][A-Z0-9.\[\]-]{0,12}"
BOLD_PAIR = rf"\*\*({TERM})\*\*\s*\(([^)\n]{{2,140}})\)"
PLAIN_PAIR = r"(?:^|[^*\p{L}\p{N}_])([A-ZÄÖÜ][A-Z0-9.\[\]-]{1,12})\s*\(([^)\n]{2,140})\)"
TERM_LIKE = r"\b[A-Za-z][A-Za-z0-9-]{2,15}\b"
HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*$"
PROTECTED = ("BPO", "ECTS", "K60", "K90", "PO", "SWS")
IGNORED = (
    "was", "wie", "wer", "wen", "wo", "wann", "warum", "bedeutet", "ist", "eine", "einer", "eines", "einem", "einen", "der", "die", "das", "den", "dem", "des", "und", "fuer",
)
MARKERS = (
    "abkuerzung", "bedeutet", "credit entspricht", "credits dienen", "ects-leistungspunkt", "ein credit entspricht", "ein ects-leistungspunkt entspricht", "european credit transfer system", "legende",
    "pruefungsleistung", "pruefungsleistungen", "pruefungsform", "pruefungsformen", "semesterwochenstunden", "steht fuer", "workload",
)
KEYWORDS = (("SWS", ("semesterwochenstunden",)), ("BPO", ("besonderer teil der pruefungsordnung",)))


def term_like(term: Column) -> Column:
    """Whether a word may be a term: protected, with a digit, or with capitals beyond the first letter."""
    upper, lower = F.regexp_count(term, F.lit(r"\p{Lu}")), F.regexp_count(term, F.lit(r"\p{Ll}"))
    capital = (upper >= 2) | ((upper >= 1) & (lower >= 1) & ~term.rlike(r"^\p{Lu}"))
    return (F.length(term) >= 3) & ~T.fold(term).isin(*IGNORED) & (F.upper(term).isin(*PROTECTED) | term.rlike(r"\d") | capital)


def osa_at_most_one(a: Column, b: Column) -> Column:
    """Whether two words differ by one edit or one swap of neighbours, or not at all."""
    n = F.length(a)
    at = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    swap = F.exists(at, lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (a == b) | (F.levenshtein(a, b) <= 1) | ((n == F.length(b)) & (n >= 2) & swap)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, heading, snippet): lines with the heading above them and up to four lines from them on."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "raw"))
    rows = rows.withColumns({"line": T.clean_inline(F.col("raw")), "_h": F.nullif(T.clean_inline(F.regexp_extract("raw", HEADING, 1)), F.lit(""))})
    order = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("heading", F.coalesce(F.last("_h", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    ahead = F.collect_list("line").over(order.rowsBetween(0, 3))  # four lines
    # Lines up to the first blank one after some text.
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("end"))
    step = lambda acc, x: F.struct(F.when(acc["end"] | (x == ""), acc["s"]).when(acc["s"] == "", x).otherwise(F.concat(acc["s"], F.lit(" "), x)).alias("s"), (acc["end"] | ((x == "") & (acc["s"] != ""))).alias("end"))
    return rows.withColumn("snippet", F.trim(F.substring(F.aggregate(ahead, start, step, lambda acc: acc["s"]), 1, 700))).select(key, "line_no", "raw", "line", "heading", "snippet")


def entries(df: DataFrame, key: str = "id", text: str = "text", keep: tuple[str, ...] = ("source_url", "title", "faculty")) -> DataFrame:
    """(entry_id, key, term, meaning, snippet, heading, keep..): definitions found in the lines of a text.

    Pairs come from bold or plain abbreviations with brackets and from keywords that define a term. Repeats of a
    term, meaning and URL count once: the least key and line.
    """
    found = lines(df, key, text)
    low = T.fold(F.col("line"))
    pair = lambda p: F.transform(F.arrays_zip(F.regexp_extract_all("raw", F.lit(p), 1).alias("t"), F.regexp_extract_all("raw", F.lit(p), 2).alias("m")), lambda x: F.struct(x["t"].alias("term"), T.clean_inline(x["m"]).alias("meaning")))
    fixed = [F.when(T.contains_any(low, needles), F.struct(F.lit(t).alias("term"), F.col("line").alias("meaning"))) for t, needles in KEYWORDS]
    credit = F.when(F.contains(low, F.lit("workload")) & T.contains_any(low, ("ects", "credit")), F.struct(F.lit("ECTS").alias("term"), F.col("line").alias("meaning")))
    pairs = F.concat(pair(BOLD_PAIR), pair(PLAIN_PAIR), F.array_compact(F.array(credit, *fixed)))
    rows = found.select(key, "line_no", "heading", "snippet", F.explode(F.array_distinct(pairs)).alias("p")).where(F.col("p.term").rlike(rf"^{TERM}$") & (F.col("p.meaning") != ""))
    rows = rows.join(df.select(key, *keep).dropDuplicates([key]), key)
    first = F.row_number().over(Window.partitionBy("p.term", "p.meaning", *keep[:1]).orderBy(key, "line_no"))
    rows = rows.withColumn("n", first).where("n = 1").select(key, F.col("p.term").alias("term"), F.col("p.meaning").alias("meaning"), "snippet", "heading", *keep)
    return rows.withColumn("entry_id", joined_id("glossary", F.col("term"), F.col(keep[0]), F.col("heading"), F.substring("snippet", 1, 120)))


def entry_score(text: Column, terms: Column, phrases: Column) -> Column:
    """Score of a folded text for folded terms and phrases: 2.8 a term, 2.2 a phrase or 0.45 a shared token of at least two, 0.3 a marker."""
    term_part = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.when((t != "") & F.contains(text, t), 2.8).otherwise(0.0))

    def phrase(p: Column) -> Column:
        tokens = F.filter(F.split(p, "[^a-z0-9]+"), lambda x: F.length(x) >= 2)
        shared = F.size(F.filter(tokens, lambda x: F.contains(text, x)))
        return F.when(p == "", 0.0).when(F.contains(text, p), 2.2).when(shared >= 2, 0.45 * shared).otherwise(0.0)

    phrase_part = F.aggregate(phrases, F.lit(0.0), lambda acc, p: acc + phrase(p))
    return F.when(text == "", 0.0).otherwise(F.round(term_part + phrase_part + 0.3 * T.hits(text, MARKERS), 6))


def lookup(glossary: DataFrame, questions: DataFrame, k: int = 5, base: float = 6.0) -> DataFrame:
    """(query_id, entry_id, term, score, rank): entries whose term is one of the question's, best first.

    ``questions`` has query_id, intents, retrieval_terms and phrases; only definition questions look anything up.
    """
    asked = questions.where(F.array_contains("intents", "definition")).select("query_id", F.transform("retrieval_terms", lambda x: T.fold(x)).alias("terms"), F.transform("phrases", lambda x: T.fold(x)).alias("phrases"))
    by_term = asked.select("query_id", "terms", "phrases", F.explode(F.array_distinct("terms")).alias("_t"))
    text = T.fold(F.concat_ws(" ", "term", "meaning", "snippet", "heading"))
    rows = glossary.withColumn("_t", T.fold(F.col("term"))).withColumn("_x", text).join(by_term, "_t")
    scored = rows.select("query_id", "entry_id", "term", F.round(entry_score(F.col("_x"), F.col("terms"), F.col("phrases")) + base, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def corpus_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, mentions, first_key): term-like words of a corpus with the rows that mention them."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TERM_LIKE), 0))).alias("term"))
    return rows.where(term_like(F.col("term"))).groupBy("term").agg(F.countDistinct(key).alias("mentions"), F.min(key).alias("first_key"))


def similar_terms(asked: DataFrame, known: DataFrame, k: int = 5) -> DataFrame:
    """(asked, term, mentions, rank): known terms one edit or swap away from the terms asked, never the same.

    Candidates come from equi-joins on deletion neighbourhoods: two words are at most one edit apart only if they
    share a form with at most one letter deleted, so no term is compared with all others.
    """
    forms = lambda w: F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
    a = asked.select("asked").where("asked <> ''").distinct().withColumn("fa", T.fold(F.col("asked"))).withColumn("form", F.explode(forms(F.col("fa"))))
    b = known.withColumn("fb", T.fold(F.col("term"))).where("fb <> ''").withColumn("form", F.explode(forms(F.col("fb"))))
    near = a.join(b, "form").where("fa <> fb").where(osa_at_most_one(F.col("fa"), F.col("fb"))).select("asked", "term", "mentions").distinct()
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("mentions"), F.abs(F.length("term") - F.length("asked")), "term"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def context_terms(hits: DataFrame, query: str = "query_id", first: int = 5) -> DataFrame:
    """(query, term, weight): term-like words of the first hits, 2 for title and heading, 1 for the first 500 letters."""
    words = lambda c, w: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TERM_LIKE), 0), lambda t: F.struct(t.alias("t"), F.lit(w).alias("w")))
    rows = hits.where(F.col("rank") <= first).select(query, F.explode(F.concat(words(F.col("title"), 2), words(F.col("section_heading"), 2), words(F.substring("text", 1, 500), 1))).alias("x"))
    return rows.where(term_like(F.col("x.t"))).groupBy(query, F.col("x.t").alias("term")).agg(F.sum("x.w").alias("weight"))


def corrections(terms: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, asked, matched): the context term nearest to a question's term: fewest edits, then heaviest, then nearest in length."""
    pairs = terms.join(context, "query_id").where(F.abs(F.length("asked") - F.length("term")) <= 1)
    fa, fb = T.fold(F.col("asked")), T.fold(F.col("term"))
    near = pairs.where((fa != fb) & osa_at_most_one(fa, fb))
    best = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("weight"), F.abs(F.length("asked") - F.length("term")), "term"))
    return near.withColumn("n", best).where("n = 1").select("query_id", "asked", F.col("term").alias("matched"))
