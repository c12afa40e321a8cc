"""URLs as column expressions: parts, normal form, and the decision whether a page is worth keeping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.config import SiteConfig
from florilege.functions.text import contains_any, fold, weighted

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def part(url: Column, n: int) -> Column:
    """Part of a URL: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(_clean(url), PARTS, n)


def host(url: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.lower(F.regexp_extract(F.regexp_replace(part(url, 2), r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_query(query: Column, noisy: tuple[str, ...]) -> Column:
    """Query without noisy parameters, decoded and encoded again; a malformed escape stays as it is."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*noisy))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")


def _chain(start: dict[str, Column], *steps: Callable[[Callable[[str], Column]], dict[str, Column]]) -> Column:
    """Struct of fields computed step by step: each step may use the fields of those before.

    The steps are bound as lambda variables, so an expression is never written out twice, however often it is used,
    and a filter on the result stays as small as the result.
    """
    def bound(step: Callable, names: list[str]) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            new = step(lambda n: s[n])
            return F.struct(*[s[n].alias(n) for n in names if n not in new], *[c.alias(n) for n, c in new.items()])

        return one

    x, names = F.array(F.struct(*[c.alias(n) for n, c in start.items()])), list(start)
    for step in steps:
        x = F.transform(x, bound(step, names))
        names = list(dict.fromkeys([*names, *step(F.col)]))
    return F.get(x, F.lit(0))


def with_normalized(df: DataFrame, url: str, out: str = "normalized_url", site: SiteConfig = SiteConfig()) -> DataFrame:
    """``df`` with the normal form of a URL: scheme and host in lower case, no user, default port, fragment or noise.

    Null stays null; a URL that can't be parsed (bad port, unbalanced brackets) stays as it is.
    """
    return df.withColumn(out, normalized(F.col(url), site))


def normalized(url: Column, site: SiteConfig = SiteConfig()) -> Column:
    """Normal form of a URL as a column expression."""
    files = "|".join(n.replace(".", r"\.") for n in site.index_files)

    def canonical(name: Column) -> Column:
        out = name
        for a, b in site.canonical_hosts.items():
            out = F.when(name == a, b).otherwise(out)
        return out

    def plain(c: Callable[[str], Column]) -> Column:
        n = c("port").try_cast("int")
        return (F.coalesce(n, F.lit(0)) == 0) | ((c("scheme") == "http") & (n == 80)) | ((c("scheme") == "https") & (n == 443))

    def whole(c: Callable[[str], Column]) -> Column:
        lead = F.concat(F.when(c("scheme") != "", F.concat(c("scheme"), F.lit(":"))).otherwise(""), F.when(c("name") != "", F.concat(F.lit("//"), c("name"))).otherwise(""))
        return F.concat(lead, c("path"), F.when(c("query") != "", F.concat(F.lit("?"), c("query"))).otherwise(""))

    fields = _chain(
        {"url": url},
        lambda c: {"c": _clean(c("url"))},
        lambda c: {"scheme": F.lower(F.regexp_extract(c("c"), PARTS, 1)), "at": F.regexp_replace(F.regexp_extract(c("c"), PARTS, 2), r"^.*@", ""), "path": F.regexp_replace(F.regexp_extract(c("c"), PARTS, 3), r";[^/]*$", ""), "query": normal_query(F.regexp_extract(c("c"), PARTS, 4), site.noisy_params)},
        lambda c: {"host": F.lower(F.regexp_extract(c("at"), r"^(\[[^\]]*\]|[^:]*)", 1)), "port": F.regexp_extract(c("at"), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1), "path": F.regexp_replace(F.when(c("path") == "", "/").otherwise(c("path")), r"/{2,}", "/")},
        lambda c: {"ok": ((c("port") == "") | (c("port").rlike(r"^\d{1,5}$") & (F.coalesce(c("port").try_cast("int"), F.lit(99999)) <= 65535))) & (F.contains(c("at"), F.lit("[")) == F.contains(c("at"), F.lit("]"))), "path": F.regexp_replace(c("path"), rf"(?i)(^|/)(?:{files})/?$", "$1"), "name": canonical(c("host"))},
        lambda c: {"name": F.when(plain(c), c("name")).otherwise(F.concat(c("name"), F.lit(":"), c("port").try_cast("int").cast("string"))), "path": F.when(c("path").isin("", "/"), "/").otherwise(F.regexp_replace(c("path"), "/+$", ""))},
        lambda c: {"path": F.when((c("name") != "") & ~c("path").startswith("/"), F.concat(F.lit("/"), c("path"))).otherwise(c("path"))},
        lambda c: {"whole": F.when(c("url").isNull(), None).when(c("ok"), whole(c)).otherwise(c("url"))},
    )
    return fields["whole"]


def suffix(path: Column) -> Column:
    """Suffix of the last segment with its dot, empty if there is none; a leading dot is no suffix."""
    return F.regexp_extract(F.lower(F.regexp_replace(path, "/+$", "")), r"[^/](\.[^./]+)$", 1)


def same_domain(name: Column, site: SiteConfig = SiteConfig()) -> Column:
    return ((name == site.domain) | name.endswith("." + site.domain)) & ~name.isin(*site.blocked_hosts)


def marked_host(name: Column, site: SiteConfig = SiteConfig()) -> Column:
    """Hosts of previews, tests and back ends."""
    return F.arrays_overlap(F.split(name, r"\."), F.array(*[F.lit(x) for x in site.host_labels])) | contains_any(name, site.host_fragments)


def priority(name: Column, path: Column, ending: Column, site: SiteConfig = SiteConfig()) -> Column:
    """Weighted keywords of host and path; PDF files gain or lose three by their kind."""
    text = F.concat(name, path)
    score = weighted(text, site.keyword_weights)
    pdf = F.when(contains_any(text, site.pdf_preferred), 3).otherwise(0) - F.when(contains_any(text, site.pdf_deferred), 3).otherwise(0)
    return (score + F.when(ending == ".pdf", pdf).otherwise(0)).cast("int")


def with_decision(df: DataFrame, normalized_url: str = "normalized_url", site: SiteConfig = SiteConfig()) -> DataFrame:
    """``df`` with ``decision``, ``reason`` and ``priority_score`` of a normal URL; the first rule that holds decides.

    A null or unparsable URL is blocked as invalid.
    """
    df = df.withColumn("_d", decided(F.col(normalized_url), site))
    return df.withColumns({n: F.col(f"_d.{n}") for n in ("decision", "reason", "priority_score")}).drop("_d")


def decided(url: Column, site: SiteConfig = SiteConfig()) -> Column:
    """Struct (decision, reason, priority_score) of a normal URL."""

    def rule(c: Callable[[str], Column]) -> Column:
        host_, path, end = c("host"), c("path"), c("end")
        rules = [
                (c("bad"), "blockiert_ungueltige_url"),
                (~c("scheme").isin("http", "https"), "blockiert_nicht_http"),
                (host_.isin(*site.catalogue_hosts), "blockiert_bibliothekskatalog"),
                (host_.isin(*site.blocked_hosts), "blockiert_backend_domain"),
                (marked_host(host_, site), "blockiert_preview_dev_backend_host"),
                (~same_domain(host_, site), "blockiert_externe_domain"),
                (host_.isin(*site.app_hosts), "blockiert_nicht_oeffentliche_app"),
                (contains_any(c("url"), site.broken_markers), "blockiert_vermutlich_kaputte_url"),
                ((path == site.english_prefix) | path.startswith(site.english_prefix + "/"), "blockiert_englischen_en_bereich"),
                (contains_any(path, site.auth_markers), "blockiert_auth_pfad"),
                (F.contains(path, F.lit(site.asset_marker)), "blockiert_processed_asset"),
                (contains_any(path, site.path_markers), "blockiert_low_value_pfad"),
                (end.isin(*site.media), "blockiert_medien_datei"),
                (end.isin(*site.technical), "blockiert_technisches_asset"),
                (end == ".pdf", "pdf"),
                (end.isin(*site.office), "blockiert_office_dokument_ohne_ingest_support"),
                (end.isin(*site.html_like) & contains_any(path, site.low_value_paths), "html_pfad"),
                (end.isin(*site.html_like), "html_seite"),
        ]
        return reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit("datei"))

    fields = _chain(
        {"url": url},
        lambda c: {"scheme": F.lower(part(c("url"), 1)), "host": F.lower(part(c("url"), 2)), "path": F.lower(part(c("url"), 3))},
        lambda c: {"path": F.when(c("path") == "", "/").otherwise(c("path")), "bad": c("url").isNull() | (F.contains(c("host"), F.lit("[")) != F.contains(c("host"), F.lit("]"))) | c("host").rlike(r":(?!\d{1,5}$)[^\]]*$")},
        lambda c: {"end": suffix(c("path"))},
        lambda c: {"score": priority(c("host"), c("path"), c("end"), site), "rule": rule(c)},
        lambda c: {"blocked": c("rule").startswith("blockiert"), "level": F.when((c("score") >= site.high_value) & (c("rule") != "html_pfad"), "high_value").otherwise("low_value")},
        lambda c: {
            "decision": F.when(c("blocked"), "block").otherwise(F.concat(F.lit("allow_"), c("level"))), "reason": F.when(c("blocked"), c("rule")).otherwise(F.concat(F.lit("erlaubt_"), c("level"), F.lit("_"), c("rule"))),
            "priority_score": F.when(c("blocked"), 0).otherwise(c("score")).cast("int"),
        },
    )
    return fields


def slug(url: Column) -> Column:
    """File name of a page: its path folded, anything else than letters and digits as one hyphen; ``index`` if empty."""
    out = F.regexp_replace(F.regexp_replace(fold(part(url, 3)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(out == "", "index").otherwise(out)


def loose(url: Column) -> Column:
    """Form in which the evaluation compares URLs: no fragment, parameters or trailing slash, lower case, query kept."""
    path = F.regexp_replace(F.regexp_replace(part(url, 3), r";[^/]*$", ""), "/+$", "")
    query = part(url, 4)
    out = F.concat(F.when(part(url, 1) != "", F.concat(part(url, 1), F.lit("://"))).otherwise(""), part(url, 2), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.lower(out)
