"""Curation of crawled pages: the gate after the crawl, cleaning, classification, scoring and version dedup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.config import SiteConfig
from florilege.functions import text as T
from florilege.functions import urls as U

# Markers of the gate and of the classification rules.
LOW_VALUE_TITLES = ("anfahrt", "campusleben", "galerie", "lageplan", "oeffnungszeiten", "rueckblick", "standort")
ACTIONABLE = ("antrag", "bewerbung", "faq", "formular", "kontakt", "ordnung", "pruef", "rueckmeldung", "sprech")
KINDS = (
    ("module_handbook", ("modulhandbuch", "modulbeschreibung")),
    ("regulation", ("satzung", "ordnung", "verkuendungsblatt", "verordnung")),
    ("form", ("formulare", "formular", "antrag")),
    ("faq", ("faq", "häufig gestellte fragen")),
    ("contact_service", ("sprechzeiten", "ansprechperson", "beratung", "kontakt")),
    ("brochure", ("broschüre", "broschuere", "flyer")),
)
TOPICS = (
    ("bewerbung", "bewerbung"), ("beurlaub", "beurlaubung"), ("campuscard", "campuscard"), ("faq", "faq"), ("immatrik", "immatrikulation"), ("international", "internationales"), ("kontakt", "kontakt"),
    ("modulhandbuch", "modulhandbuch"), ("ordnung", "ordnungen"), ("praxis", "praxis"), ("pruef", "pruefungen"), ("rueckmeldung", "rueckmeldung"), ("semester", "semester"), ("studiengang", "studiengaenge"),
)
API_PATHS = ("/apidoc", "/api-doc", "/api_docs", "/javadoc", "/swagger", "/openapi")
API_TITLES = ("apidoc", "api doc", "api-doc", "javadoc", "swagger", "openapi")
ROMAN = (("f1", "Fakultät I"), ("f2", "Fakultät II"), ("f3", "Fakultät III"), ("f4", "Fakultät IV"), ("f5", "Fakultät V"))
NOT_FOUND = r"(?im)^\s*404\s*$|\b404\s*[-:]?\s*(?:not\s+found|seite\s+nicht\s+gefunden|fehler|error)\b|\b(?:seite|page)\s+(?:nicht\s+gefunden|not\s+found)\b"
DENIED = r"(?i)\b(?:zugriff\s+verweigert|access\s+denied|403\s+forbidden)\b"
LOAD_ERROR = r"(?i)\b(?:fehler\s+beim\s+laden|error\s+loading)\b"
UNAVAILABLE = r"(?i)\b(?:nicht\s+verf(?:ü|ue)gbar|not\s+available)\b"
LINK = r"\[[^\]]+\]\((?:https?://[^)]+|/[^)]+)\)|https?://\S+"
SPARSE_WORDS = 160


# --- gate after the crawl -------------------------------------------------------------------------------------------


def repeated_short_lines(body: Column, least: int = 3) -> Column:
    """Lines of 3 to 60 characters, without marks in front, that stand ``least`` times or more; each occurrence counts."""
    cleaned = F.transform(T.lines(body), lambda x: F.lower(F.trim(F.regexp_replace(x, r"^[#*\-\d.\s]+", ""))))
    short = F.array_sort(F.filter(cleaned, lambda x: F.length(x).between(3, 60)))
    # Lengths of the runs in the sorted lines, by one pass.
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("run"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        gain = F.when(run == least, least).when(run > least, 1).otherwise(0)
        return F.struct((acc["total"] + gain).alias("total"), run.alias("run"), x.alias("last"))

    return F.aggregate(short, start, step, lambda acc: acc["total"]).cast("long")


def crawl_gate(df: DataFrame, url: str = "source_url", title: str = "title", body: str = "body", high_value: Column | None = None) -> DataFrame:
    """``df`` with word_count, link_count, duplicate_short_lines, reasons (joined by ``|``) and keep.

    Null url, title and body count as empty. ``high_value`` pages need fewer words.
    """
    high = F.lit(False) if high_value is None else high_value
    c = F.col
    df = df.withColumns({"word_count": T.token_count(F.coalesce(c(body), F.lit(""))), "link_count": F.regexp_count(F.coalesce(c(body), F.lit("")), F.lit(LINK)).cast("long"), "duplicate_short_lines": repeated_short_lines(F.coalesce(c(body), F.lit("")))})
    name = F.lower(F.concat_ws(" ", F.coalesce(c(url), F.lit("")), F.coalesce(c(title), F.lit(""))))
    df = df.withColumn("_title", name)
    reasons = F.array_compact(F.array(
        F.when(c("word_count") < F.when(high, 18).otherwise(35), F.concat(F.lit("zu_wenig_text:"), c("word_count").cast("string"))),
        F.when((c("link_count") >= 12) & (c("word_count") / F.greatest(c("link_count"), F.lit(1)) < 7), "zu_viele_links_fuer_zu_wenig_prosa"),
        F.when((c("duplicate_short_lines") >= 6) & (c("word_count") < 220), "vermutlich_navigation_footer_fragmente"),
        F.when(T.contains_any(c("_title"), LOW_VALUE_TITLES) & ~T.contains_any(c("_title"), ACTIONABLE) & (c("word_count") < 220), "generische_oeffnungszeiten_promo_uebersicht"),
    ))
    df = df.withColumn("_reasons", reasons)
    return df.withColumns({"reasons": F.array_join("_reasons", "|"), "keep": F.size("_reasons") == 0}).drop("_title", "_reasons")


# --- cleaning -------------------------------------------------------------------------------------------------------


@cache
def _noise() -> list[re.Pattern]:
    # Whole lines that are noise.
    return [re.compile(p, re.I) for p in (r"\s*\*\*==> picture .* omitted <==\*\*\s*$", r"\s*scrollen für mehr infos!?\s*$", r"\s*\[\s*teilen\s*\]\(.*\)\s*$", r"\s*[_*]\s*[_*]\s*$")]


IMAGE = re.compile(r"\s*!\[[^\]]*\]\(([^)]+)\)\s*$")
ANY_LINK = re.compile(r"(?P<md>(?P<bang>!?)\[(?P<label>[^\]]*)\]\(\s*(?P<href><[^>\n]+>|[^)\s]+)(?:\s+\"[^\"]*\")?\s*\))|<(?P<auto>https?://[^<>\s]+)>|(?P<raw>(?<![(\[<])https?://[^\s<>\"]+)")
OPENERS = {")": "(", "]": "[", "}": "{"}


def _trailing(href: str) -> int:
    """Where the punctuation at the end of a bare URL begins; a bracket closed but not opened counts as such."""
    n = len(href)
    while n and (href[n - 1] in ".,;:!?" or (href[n - 1] in OPENERS and href.count(href[n - 1], 0, n) > href.count(OPENERS[href[n - 1]], 0, n))):
        n -= 1
    return n


def link_targets(text: str, base: str) -> list[str]:
    """Absolute HTTP targets of all links and images of a text."""
    out = []
    for m in ANY_LINK.finditer(text):
        href = m["href"].strip("<>").strip() if m["md"] else m["auto"] or m["raw"][: _trailing(m["raw"])]
        if href and (absolute := _absolute(base, href)):
            out.append(absolute)
    return out


def _absolute(base: str, href: str) -> str | None:
    if href.startswith(("#", "mailto:", "tel:", "javascript:")):
        return None
    try:
        out = href if href.startswith(("http://", "https://")) else urljoin(base, href)
    except ValueError:
        return None
    return out if out.startswith(("http://", "https://")) else None


def clean_text(text: str, base: str, known: dict[str, tuple[bool, str]], asset: str) -> tuple[str, int, int, int]:
    """(text, blocked links removed, links rewritten, noise lines removed) of a body.

    ``known`` says of every absolute target whether it is allowed and its normal form.
    """
    blocked = rewritten = noise = 0
    lines = []

    def replaced(m: re.Match) -> str:
        nonlocal blocked, rewritten
        raw, tail = m["raw"], ""
        if raw:
            n = _trailing(raw)
            raw, tail = raw[:n], raw[n:]
        href = (m["href"] or m["auto"] or raw or "").strip()
        angled = href.startswith("<") and href.endswith(">")
        href = href[1:-1].strip() if angled else href
        absolute = _absolute(base, href)
        if absolute is None:
            return m.group()
        allowed, target = known.get(absolute, (True, absolute))
        if not allowed:
            blocked += 1
            return (("" if m["bang"] else m["label"].strip()) if m["md"] else "") + tail
        rewritten += target != href
        if m["md"]:
            shown = f"<{target}>" if angled or re.search(r"[\s()]", target) else target
            return f"{m['bang']}[{m['label']}]({shown})"
        return (f"<{target}>" if m["auto"] else target) + tail

    for line in text.splitlines():
        if any(p.match(line) for p in _noise()):
            noise += 1
            continue
        image = IMAGE.match(line)
        if image:
            absolute = _absolute(base, image.group(1).strip("<> "))
            allowed, target = known.get(absolute, (True, absolute or "")) if absolute else (True, "")
            if not allowed or asset in target:
                blocked += 1
                noise += 1
                continue
        lines.append(re.sub(r"\s{2,}", " ", ANY_LINK.sub(replaced, line)).rstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(), blocked, rewritten, noise


def clean_bodies(df: DataFrame, key: str, url: str, body: str, site: SiteConfig = SiteConfig()) -> DataFrame:
    """(key, text, blocked_links_removed, normalized_links_rewritten, removed_noise_lines) of every row with a key.

    The decision on a link depends only on its target: distinct targets are judged once in the JVM and handed back
    to each body as an array, so the bodies cross a join once. A null body has a null text. Keys should be unique;
    of repeated rows with one key the greatest body counts.
    """

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for k, u, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for x in set(link_targets(t or "", u or "")):
                    keys.append(k)
                    found.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "target"])

    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.struct(F.col(body).alias("body"), F.col(url).alias("url"))).alias("x")).select("key", "x.url", "x.body")
    links = rows.where(F.contains("body", F.lit("](")) | F.contains("body", F.lit("://"))).mapInArrow(targets, "key string, target string")
    judged = U.with_decision(U.with_normalized(links.select("target").distinct(), "target", "normal", site), "normal", site).select("target", "normal", F.col("decision").startswith("allow").alias("allowed"))
    per = links.join(judged, "target").groupBy("key").agg(F.collect_list(F.struct("target", "normal", "allowed")).alias("known"))  # at most as many as a body has links

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, u, t, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append((k, None, 0, 0, 0) if t is None else (k, *clean_text(t, u or "", {x["target"]: (x["allowed"], x["normal"]) for x in known or ()}, site.asset_marker)))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "text", "b", "n", "r"])

    cleaned = rows.join(per, "key", "left").select("key", "url", "body", "known").mapInArrow(clean, "key string, text string, b long, n long, r long")
    return cleaned.select(F.col("key").alias(key), "text", F.col("b").alias("blocked_links_removed"), F.col("n").alias("normalized_links_rewritten"), F.col("r").alias("removed_noise_lines"))


# --- classification and score ---------------------------------------------------------------------------------------


def document_kind(text: Column) -> Column:
    out = F.lit("service_page")
    for name, needles in reversed(KINDS):
        out = F.when(T.contains_any(text, needles), name).otherwise(out)
    return out


def topic_tags(text: Column, most: int = 6) -> Column:
    """Topics of a text in lower case, in the order of the list."""
    return F.slice(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), tag) for k, tag in TOPICS])), 1, most)


def page_faculty(url: Column, stated: Column) -> Column:
    """Faculty by the host or path of a page, else the one stated."""
    low, out = F.lower(url), F.coalesce(stated, F.lit(""))
    for code, name in reversed(ROMAN):
        out = F.when(low.startswith(f"https://{code}.") | F.contains(low, F.lit(f"/{code}/")), name).otherwise(out)
    return F.coalesce(out, F.lit(""))


def chunk_faculty(url: Column) -> Column:
    """Faculty by the path of a chunk, or the central unit by its host, else empty."""
    low = F.lower(url)
    out = F.when(U.host(low).startswith("karriere."), "Karriere").when(U.host(low).startswith("bibliothek."), "Bibliothek").when(U.host(low).startswith("international."), "International").otherwise("")
    for code, name in reversed(ROMAN):
        out = F.when(F.contains(low, F.lit(f"/{code}/")), name).otherwise(out)
    return F.coalesce(out, F.lit(""))


def source_family(url: Column, title: Column, faculty: Column) -> Column:
    name, path = U.host(url), F.lower(U.part(url, 3))
    stated = F.replace(T.fold(F.trim(faculty), sharp_s=False), F.lit(" "), F.lit("_"))
    by_unit = F.when(F.contains(path, F.lit("akademische-angelegenheiten")), "akademische_angelegenheiten")
    by_unit = by_unit.when(F.contains(path, F.lit("international")) | name.startswith("international."), "internationales").when(F.contains(path, F.lit("bibliothek")) | name.startswith("bibliothek."), "bibliothek")
    by_unit = by_unit.when(F.contains(path, F.lit("servicezentrum-beratung")), "servicezentrum_beratung").when(name != "", F.replace(name, F.lit("."), F.lit("_"))).otherwise("zentral")
    for code, _ in reversed(ROMAN):
        by_unit = F.when(name.startswith(code + ".") | F.contains(path, F.lit(f"/{code}/")), f"faculty_{code[1]}").otherwise(by_unit)
    return F.when(api_source(url, title), "technical_api_docs").when(stated != "", stated).otherwise(by_unit)


def api_source(url: Column, title: Column) -> Column:
    return T.contains_any(F.lower(title), API_TITLES) | T.contains_any(F.lower(U.part(url, 3)), API_PATHS)


def catalogue_source(url: Column, site: SiteConfig = SiteConfig()) -> Column:
    return U.host(url).isin(*site.catalogue_hosts) | F.contains(F.lower(U.part(url, 3)), F.lit("vufind-record"))


def error_pattern(sample: Column, words: Column) -> Column:
    """Name of the error page pattern of a sample, or null; the last one only on pages of few words."""
    found = F.when(sample.rlike(NOT_FOUND), "404_not_found").when(sample.rlike(DENIED), "access_denied").when(sample.rlike(LOAD_ERROR), "load_error")
    return found.when(sample.rlike(UNAVAILABLE) & (words <= SPARSE_WORDS), "not_available")


def assess(df: DataFrame, url: str, title: str, body: str, content_type: str, faculty: str, duplicate: str, keep_english: bool = False, site: SiteConfig = SiteConfig()) -> DataFrame:
    """``df`` with words, tables, language, document_kind, source_family, document_group, topic_tags, reasons, score, keep and kept.

    Nulls count as empty. ``keep`` is the decision of the score, ``kept`` the final one, in which English pages go.
    The helper columns are named ``_q_*`` and dropped.
    """
    c = F.col
    df = df.withColumns({"_q_url": F.coalesce(c(url), F.lit("")), "_q_title": F.coalesce(c(title), F.lit("")), "_q_body": F.coalesce(c(body), F.lit(""))})
    german, english = T.marker_counts(c("_q_body"), F.concat_ws(" ", "_q_title", "_q_url"))
    df = df.withColumns({"words": T.word_count(c("_q_body")), "tables": T.table_lines(c("_q_body")), "_q_de": german, "_q_en": english, "_q_low": F.lower("_q_body")})
    head = lambda n: F.lower(F.concat_ws(" ", "_q_url", "_q_title", F.substring("_q_body", 1, n)))
    df = df.withColumns({
        "language": T.marker_language(c("_q_de"), c("_q_en")), "_q_2": head(2000), "_q_4": head(4000), "_q_e": F.concat(c("_q_title"), F.lit("\n"), F.substring("_q_body", 1, 2500)),
        "_q_gaps": T.occurrences(c("_q_body"), "intentionally omitted"), "_q_api": api_source(c("_q_url"), c("_q_title")), "_q_cat": (c("_q_url") != "") & catalogue_source(c("_q_url"), site),
    })
    df = df.withColumns({"document_kind": document_kind(c("_q_2")), "_q_tags": topic_tags(c("_q_4")), "source_family": source_family(c("_q_url"), c("_q_title"), F.coalesce(c(faculty), F.lit(""))), "_q_error": error_pattern(c("_q_e"), c("words"))})
    least = F.when(c(content_type) == "pdf", 50).otherwise(30)
    rules = [
        (c("_q_url") == "", F.lit("fehlende_quell_url"), 50),
        (~c("_q_body").rlike(r"\S"), F.lit("leerer_body"), 80),
        (c("_q_cat"), F.lit("bibliothekskatalog_ohne_rag_mehrwert"), 90),
        (c("_q_api"), F.lit("technische_api_dokumentation_ohne_rag_mehrwert"), 90),
        (c("words") < least, F.concat(F.lit("zu_wenig_text:"), c("words").cast("string")), 40),
        (c("_q_error").isNotNull(), F.concat(F.lit("fehlerseitenmuster:"), c("_q_error")), 60),
        (c("_q_gaps") >= 8, F.concat(F.lit("viele_bildplatzhalter:"), c("_q_gaps").cast("string")), 10),
        (T.contains_any(c("_q_low"), site.backend_markers), F.lit("enthaelt_preview_backend_links"), 20),
        (T.contains_any(c("_q_low"), ("scrollen für mehr infos", "scrollen fuer mehr infos")), F.lit("enthaelt_landingpage_boilerplate"), 10),
        (c("language") == "en", F.lit("englischsprachiger_inhalt"), 35),
        (c("language") == "mixed", F.lit("sprachlich_gemischt"), 10),
        (F.coalesce(c(duplicate), F.lit(False)), F.lit("duplikat_aeltere_version"), 25),
    ]
    score = F.lit(100)
    for rule, _, loss in rules:
        score = score - F.when(rule, loss).otherwise(0)
    df = df.withColumns({"_q_score": score, "_q_reasons": F.array_compact(F.array(*[F.when(rule, reason) for rule, reason, _ in rules]))})
    hard = c("_q_error").isNotNull() | c("_q_cat") | c("_q_api")
    df = df.withColumns({
        "document_group": F.concat_ws("_", "source_family", "document_kind", F.coalesce(F.get("_q_tags", F.lit(0)), F.lit("allgemein"))), "topic_tags": F.array_join("_q_tags", "|"), "reasons": F.array_join("_q_reasons", "|"),
        "score": F.greatest("_q_score", F.lit(0)).cast("int"), "keep": (c("_q_score") >= 45) & ~hard,
    })
    df = df.withColumn("kept", c("keep") & (F.lit(keep_english) | (c("language") != "en")))
    return df.drop(*[x for x in df.columns if x.startswith("_q_")])


# --- versions, report, titles, links --------------------------------------------------------------------------------


def older_versions(df: DataFrame, file: str = "file", out: str = "duplicate") -> DataFrame:
    """``df`` with a flag: a file is an older version if another one with the same slug has a greater name.

    The slug is what follows the first underscore of the name without its suffix. A null name is no version.
    """
    stem = F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    slug = F.when(F.contains(stem, F.lit("_")), F.regexp_replace(stem, r"^[^_]*_", "")).otherwise(stem)
    latest = df.where(F.col(file).isNotNull()).groupBy(slug.alias("_slug")).agg(F.max(file).alias("_latest"))
    return df.withColumn("_slug", slug).join(latest, "_slug", "left").withColumn(out, F.coalesce(F.col(file) < F.col("_latest"), F.lit(False))).drop("_slug", "_latest")


def quality_report(df: DataFrame) -> DataFrame:
    """(document_kind, pages, kept, rejected, words): counts by kind, and of all in a row without kind."""
    return df.rollup("document_kind").agg(F.count(F.lit(1)).alias("pages"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"), F.sum("words").alias("words"))


def reason_counts(df: DataFrame, most: int | None = None) -> DataFrame:
    """(reason, n): how often each reason was given, numbers after a colon left out; the most frequent if asked."""
    one = F.transform(F.filter(F.split("reasons", r"\|"), lambda x: x != ""), lambda x: F.regexp_replace(x, r":\d+$", ""))
    out = df.select(F.explode(one).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "reason").limit(most) if most else out


def title_of(title: Column, text: Column, url: Column) -> Column:
    """Stated title, else the first heading of the first level, else the URL."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1)), F.lit("")), url)


def body_links(df: DataFrame, key: str = "file", body: str = "text") -> DataFrame:
    """(key, link): distinct HTTP links of a body, in Markdown or bare, without trailing punctuation."""
    marked = F.regexp_extract_all(F.col(body), F.lit(r"\]\((https?://[^)\s]+)\)"), 1)
    bare = F.regexp_extract_all(F.col(body), F.lit(r"(https?://[^\s<>\"()\[\]]+)"), 1)
    links = F.transform(F.concat(marked, bare), lambda x: F.regexp_replace(x, r"[.,;:!?]+$", ""))
    return df.where(F.col(body).isNotNull()).select(key, F.explode(F.array_distinct(links)).alias("link")).where("link <> ''").distinct()


def host_histogram(df: DataFrame, url: str, most: int = 8) -> DataFrame:
    """(host, n): the hosts with most rows; ties by name."""
    out = df.select(U.host(F.col(url)).alias("host")).where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "host").limit(most)


def decision_statistics(df: DataFrame, samples: int = 5) -> DataFrame:
    """(decision, reason, n, examples): counts, and for blocks the least ``samples`` distinct URLs joined by blanks.

    Examples are ranked by window, so a reason of many URLs is never gathered.
    """
    counts = df.groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("decision", "reason").orderBy("normalized_url")
    some = df.where("decision = 'block'").select("decision", "reason", "normalized_url").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= samples)
    listed = some.groupBy("decision", "reason").agg(F.array_join(F.array_sort(F.collect_list("normalized_url")), " ").alias("examples"))
    return counts.join(listed, ["decision", "reason"], "left").select("decision", "reason", "n", F.coalesce("examples", F.lit("")).alias("examples"))
