"""Pieces of DuckDB SQL from which the checks of the registered queries are put together."""

from __future__ import annotations

from collections.abc import Iterable

from florilege.config import SiteConfig
from florilege.functions import text as T
from florilege.operators import pages as P

SITE = SiteConfig()
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(c: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(n)})" for n in needles) + ")"


def among(c: str, values: Iterable[str]) -> str:
    return f"{c} IN (" + ", ".join(map(lit, values)) + ")"


def hits(c: str, needles: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {lit(n)})::INT" for n in needles) + ")"


def weighted(c: str, weights: dict[str, int]) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({c}, {lit(k)}) THEN {w} ELSE 0 END)" for k, w in weights.items()) + ")"


def occurrences(c: str, needle: str) -> str:
    return f"((length({c}) - length(replace({c}, {lit(needle)}, ''))) // {len(needle)})"


def fold(c: str, sharp_s: bool = True) -> str:
    out = f"lower({c})"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), *([("ß", "ss")] if sharp_s else [])):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def host(c: str) -> str:
    return rf"lower(regexp_extract(regexp_replace(regexp_extract({c}, '{PARTS}', 2), '^.*@', ''), '^(\[[^\]]*\]|[^:]*)', 1))"


def path(c: str) -> str:
    return f"regexp_extract({c}, '{PARTS}', 3)"


def normalized(urls: str) -> str:
    """CTEs ending in ``n`` (url, normalized_url) for a query ``urls`` that gives a column url."""
    files = "|".join(x.replace(".", r"\.") for x in SITE.index_files)
    canonical = "CASE h " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in SITE.canonical_hosts.items()) + " ELSE h END"
    enc = lambda x: f"replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+')"
    return rf"""
        u0 AS ({urls}),
        u1 AS (SELECT url, regexp_replace(regexp_replace(url, '[\t\r\n]', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS c FROM u0),
        u2 AS (SELECT url, lower(regexp_extract(c, '{PARTS}', 1)) AS s, regexp_replace(regexp_extract(c, '{PARTS}', 2), '^.*@', '') AS a, regexp_replace(regexp_extract(c, '{PARTS}', 3), ';[^/]*$', '') AS p, regexp_extract(c, '{PARTS}', 4) AS q FROM u1),
        u3 AS (SELECT *, lower(regexp_extract(a, '^(\[[^\]]*\]|[^:]*)', 1)) AS h, regexp_extract(a, '^(?:\[[^\]]*\]|[^:]*):(.*)$', 1) AS po, regexp_replace(CASE WHEN p = '' THEN '/' ELSE p END, '/{{2,}}', '/', 'g') AS p1 FROM u2),
        u4 AS (SELECT *, {canonical} AS h1, (po = '' OR coalesce(TRY_CAST(po AS INT), 99999) BETWEEN 0 AND 65535) AND contains(a, '[') = contains(a, ']') AS ok, regexp_replace(p1, '(?i)(^|/)(?:{files})/?$', '\1') AS p2 FROM u3),
        u5 AS (SELECT *, CASE WHEN coalesce(TRY_CAST(po AS INT), 0) = 0 OR (s = 'http' AND po = '80') OR (s = 'https' AND po = '443') THEN h1 ELSE h1 || ':' || po END AS h2,
                      CASE WHEN p2 IN ('', '/') THEN '/' ELSE regexp_replace(p2, '/+$', '') END AS p3,
                      list_transform(list_filter(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: lower(url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' '))) NOT IN ({", ".join(map(lit, SITE.noisy_params))})),
                                     lambda x: {enc("regexp_extract(x, '^([^=]*)', 1)")} || '=' || {enc("regexp_extract(x, '^[^=]*=(.*)$', 1)")}) AS ql FROM u4),
        n AS (SELECT url, CASE WHEN NOT ok THEN url ELSE (CASE WHEN s <> '' THEN s || ':' ELSE '' END) || (CASE WHEN h2 <> '' THEN '//' || h2 ELSE '' END) || (CASE WHEN h2 <> '' AND NOT starts_with(p3, '/') THEN '/' ELSE '' END) || p3
                     || (CASE WHEN len(ql) > 0 THEN '?' || array_to_string(ql, '&') ELSE '' END) END AS normalized_url FROM u5)"""


def decided(source: str, column: str = "normalized_url") -> str:
    """CTEs ending in ``d`` with decision, reason and priority_score beside the columns of ``source``."""
    score = f"{weighted('(dh || dp)', SITE.keyword_weights)} + CASE WHEN de = '.pdf' THEN (CASE WHEN {any_of('(dh || dp)', SITE.pdf_preferred)} THEN 3 ELSE 0 END) - (CASE WHEN {any_of('(dh || dp)', SITE.pdf_deferred)} THEN 3 ELSE 0 END) ELSE 0 END"
    labels = "(" + " OR ".join(f"list_contains(string_split(dh, '.'), {lit(x)})" for x in SITE.host_labels) + ")"
    rules = [
        (f"{column} IS NULL OR contains(dh, '[') <> contains(dh, ']')", "blockiert_ungueltige_url"), ("ds NOT IN ('http', 'https')", "blockiert_nicht_http"), (among("dh", SITE.catalogue_hosts), "blockiert_bibliothekskatalog"),
        (among("dh", SITE.blocked_hosts), "blockiert_backend_domain"), (f"{labels} OR {any_of('dh', SITE.host_fragments)}", "blockiert_preview_dev_backend_host"),
        (f"NOT (dh = {lit(SITE.domain)} OR ends_with(dh, {lit('.' + SITE.domain)}))", "blockiert_externe_domain"), (among("dh", SITE.app_hosts), "blockiert_nicht_oeffentliche_app"),
        (any_of(column, SITE.broken_markers), "blockiert_vermutlich_kaputte_url"), (f"dp = {lit(SITE.english_prefix)} OR starts_with(dp, {lit(SITE.english_prefix + '/')})", "blockiert_englischen_en_bereich"),
        (any_of("dp", SITE.auth_markers), "blockiert_auth_pfad"), (f"contains(dp, {lit(SITE.asset_marker)})", "blockiert_processed_asset"), (any_of("dp", SITE.path_markers), "blockiert_low_value_pfad"),
        (among("de", SITE.media), "blockiert_medien_datei"), (among("de", SITE.technical), "blockiert_technisches_asset"), ("de = '.pdf'", "pdf"), (among("de", SITE.office), "blockiert_office_dokument_ohne_ingest_support"),
        (f"{among('de', SITE.html_like)} AND {any_of('dp', SITE.low_value_paths)}", "html_pfad"), (among("de", SITE.html_like), "html_seite"),
    ]
    case = "CASE " + " ".join(f"WHEN {c} THEN {lit(r)}" for c, r in rules) + " ELSE 'datei' END"
    level = f"CASE WHEN sc >= {SITE.high_value} AND ru <> 'html_pfad' THEN 'high_value' ELSE 'low_value' END"
    return rf"""
        d0 AS (SELECT *, lower(regexp_extract({column}, '{PARTS}', 1)) AS ds, lower(regexp_extract({column}, '{PARTS}', 2)) AS dh, CASE WHEN regexp_extract({column}, '{PARTS}', 3) = '' THEN '/' ELSE lower(regexp_extract({column}, '{PARTS}', 3)) END AS dp FROM {source}),
        d1 AS (SELECT *, regexp_extract(regexp_replace(dp, '/+$', ''), '[^/](\.[^./]+)$', 1) AS de FROM d0), d2 AS (SELECT *, {score} AS sc, {case} AS ru FROM d1), d3 AS (SELECT *, {level} AS lv FROM d2),
        d AS (SELECT *, CASE WHEN starts_with(ru, 'blockiert') THEN 'block' ELSE 'allow_' || lv END AS decision, CASE WHEN starts_with(ru, 'blockiert') THEN ru ELSE 'erlaubt_' || lv || '_' || ru END AS reason,
                     (CASE WHEN starts_with(ru, 'blockiert') THEN 0 ELSE sc END)::INT AS priority_score FROM d3)"""


SPACE = r"\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{001c}-\x{001f}\x{0085}\x{000b}"
LINES = r"string_split_regex({}, '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]')"


def word_count(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{SPACE}]+'))"


def token_count(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_-]*[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_-]*'))"


def table_lines(c: str) -> str:
    return rf"len(list_filter({LINES.format(c)}, lambda x: regexp_matches(x, '\|[\s\-:]+\|')))"


def marker_counts(text: str, hints: str) -> tuple[str, str]:
    sample = f"(' ' || lower({text}) || ' ' || lower({hints}) || ' ')"
    return tuple("(" + " + ".join(occurrences(sample, m) for m in ms) + ")" for ms in (T.GERMAN, T.ENGLISH))


LANGUAGE = "CASE WHEN g = 0 AND e = 0 THEN 'unknown' WHEN g >= e * 2 AND g >= 2 THEN 'de' WHEN e >= g * 2 AND e >= 2 THEN 'en' ELSE 'mixed' END"


def document_kind(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(c, needles)} THEN {lit(k)}" for k, needles in P.KINDS) + " ELSE 'service_page' END"


def topic_tags(c: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({c}, {lit(k)}) THEN {lit(t)} END" for k, t in P.TOPICS) + "], lambda x: x IS NOT NULL)[1:6]"


def source_family(url: str) -> str:
    h, p = host(url), f"lower({path(url)})"
    codes = " ".join(f"WHEN starts_with({h}, '{c}.') OR contains({p}, '/{c}/') THEN 'faculty_{c[1]}'" for c, _ in P.ROMAN)
    return f"""CASE WHEN {any_of(p, P.API_PATHS)} THEN 'technical_api_docs' {codes} WHEN contains({p}, 'akademische-angelegenheiten') THEN 'akademische_angelegenheiten' WHEN contains({p}, 'international') OR starts_with({h}, 'international.') THEN 'internationales'
        WHEN contains({p}, 'bibliothek') OR starts_with({h}, 'bibliothek.') THEN 'bibliothek' WHEN contains({p}, 'servicezentrum-beratung') THEN 'servicezentrum_beratung' WHEN {h} <> '' THEN replace({h}, '.', '_') ELSE 'zentral' END"""


def version(file: str = "file") -> str:
    stem = rf"regexp_replace(regexp_replace({file}, '^.*/', ''), '(.)\.[^.]*$', '\1')"
    return f"CASE WHEN contains({stem}, '_') THEN regexp_replace({stem}, '^[^_]*_', '') ELSE {stem} END"


def assessed() -> str:
    """CTEs ending in ``a``: quality of the distinct rows of cleaned_body, without title and stated faculty."""
    g, e = marker_counts("text", "' ' || source_url")
    rules = [
        ("source_url = ''", "'fehlende_quell_url'", 50), (r"NOT regexp_matches(text, '\S')", "'leerer_body'", 80), (f"{among(host('source_url'), SITE.catalogue_hosts)} OR contains(lower({path('source_url')}), 'vufind-record')", "'bibliothekskatalog_ohne_rag_mehrwert'", 90),
        (any_of(f"lower({path('source_url')})", P.API_PATHS), "'technische_api_dokumentation_ohne_rag_mehrwert'", 90), ("words < least", "'zu_wenig_text:' || words", 40), ("err IS NOT NULL", "'fehlerseitenmuster:' || err", 60), ("gaps >= 8", "'viele_bildplatzhalter:' || gaps", 10),
        (any_of("lower(text)", SITE.backend_markers), "'enthaelt_preview_backend_links'", 20), (any_of("lower(text)", ("scrollen für mehr infos", "scrollen fuer mehr infos")), "'enthaelt_landingpage_boilerplate'", 10), ("language = 'en'", "'englischsprachiger_inhalt'", 35),
        ("language = 'mixed'", "'sprachlich_gemischt'", 10), ("duplicate", "'duplikat_aeltere_version'", 25),
    ]
    score = "100" + "".join(f" - CASE WHEN {r} THEN {n} ELSE 0 END" for r, _, n in rules)
    reasons = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r} THEN {x} END" for r, x, _ in rules) + "], lambda x: x IS NOT NULL), '|')"
    return rf"""
        c0 AS (SELECT DISTINCT file, source_url, text FROM cleaned_body WHERE file IS NOT NULL), lv AS (SELECT {version()} AS sl, max(file) AS latest FROM c0 GROUP BY 1),
        c1 AS (SELECT c0.*, file < latest AS duplicate, lower(source_url || '  ' || text[1:2000]) AS h2, lower(source_url || '  ' || text[1:4000]) AS h4, chr(10) || text[1:2500] AS he FROM c0 JOIN lv ON sl = {version()}),
        c2 AS (SELECT *, {word_count("text")} AS words, {table_lines("text")} AS tables, {g} AS g, {e} AS e, {occurrences("text", "intentionally omitted")} AS gaps, CASE WHEN ends_with(lower(source_url), '.pdf') THEN 50 ELSE 30 END AS least FROM c1),
        c3 AS (SELECT *, {LANGUAGE} AS language, CASE WHEN regexp_matches(he, '{P.NOT_FOUND}') THEN '404_not_found' WHEN regexp_matches(he, '{P.DENIED}') THEN 'access_denied' WHEN regexp_matches(he, '{P.LOAD_ERROR}') THEN 'load_error'
                      WHEN regexp_matches(he, '{P.UNAVAILABLE}') AND words <= {P.SPARSE_WORDS} THEN 'not_available' END AS err, {document_kind("h2")} AS document_kind, {topic_tags("h4")} AS tags, {source_family("source_url")} AS source_family FROM c2),
        c4 AS (SELECT *, {score} AS sc, {reasons} AS reasons FROM c3),
        a AS (SELECT file, words, tables, language, document_kind, source_family, source_family || '_' || document_kind || '_' || coalesce(tags[1], 'allgemein') AS document_group, array_to_string(tags, '|') AS topic_tags, reasons, greatest(sc, 0)::INT AS score,
                     (sc >= 45 AND err IS NULL AND NOT contains(reasons, 'ohne_rag_mehrwert')) AS keep, (sc >= 45 AND err IS NULL AND NOT contains(reasons, 'ohne_rag_mehrwert') AND language <> 'en') AS kept FROM c4)"""
