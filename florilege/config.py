"""Settings of one site and of retrieval. Defaults fit the test site; every list is a parameter."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SiteConfig:
    """What is known of the site whose pages are filtered and scored."""

    domain: str = "hs-nordfurt.example"
    catalogue_hosts: tuple[str, ...] = ("katalog.bib.hs-nordfurt.example",)
    blocked_hosts: tuple[str, ...] = ("katalog.bib.hs-nordfurt.example", "archiv.bib.hs-nordfurt.example", "backend-live.hs-nordfurt.example")
    app_hosts: tuple[str, ...] = ("intranet.hs-nordfurt.example", "moodle.hs-nordfurt.example")
    canonical_hosts: dict[str, str] = field(default_factory=lambda: {"hs-nordfurt.example": "www.hs-nordfurt.example"})
    english_prefix: str = "/en"
    asset_marker: str = "/fileadmin/_processed_/"
    backend_markers: tuple[str, ...] = ("backend-live", "f5-preview")
    institution: str = "Hochschule Nordfurt"

    # Markers and weights of the URL rules.
    host_labels: tuple[str, ...] = ("backend", "preview", "staging", "test", "wp")
    host_fragments: tuple[str, ...] = ("backend", "-preview", ".preview", "-staging", ".staging", "-test", ".test", "-dev", ".dev")
    auth_markers: tuple[str, ...] = ("/login", "/logout", "/shibboleth", "/saml", "/oauth")
    broken_markers: tuple[str, ...] = ("*", "|", "<", ">", "{", "}", '"')
    index_files: tuple[str, ...] = ("index.html", "index.htm", "index.php", "default.aspx", "default.asp")
    noisy_params: tuple[str, ...] = (
        "chash", "fbclid", "gclid", "mc_cid", "mc_eid", "pk_campaign", "pk_kwd", "pk_medium", "pk_source", "print", "ref", "refsrc", "share", "source", "tracking",
        "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_source", "utm_term",
    )
    path_markers: tuple[str, ...] = (
        "/aktuelles/", "/news/", "/news-", "/news_", "/neuigkeiten/", "/veranstaltungen/", "/veranstaltung/", "/events/", "/event/", "/galerie/", "/gallery/", "/blog/", "/blogs/",
        "/tag/", "/tags/", "/category/", "/kategorie/", "/author/", "/apidoc", "/api-doc", "/api_docs", "/javadoc", "/swagger", "/openapi", "/feed", "/rss",
    )
    low_value_paths: tuple[str, ...] = ("/standort-oeffnungszeiten", "/oeffnungszeiten", "/anfahrt", "/lageplan", "/impressum", "/datenschutz")
    keyword_weights: dict[str, int] = field(default_factory=lambda: {
        "antrag": 5, "bewerbung": 6, "campuscard": 4, "faq": 3, "immatrik": 6, "international": 4, "kontakt": 3, "modulhandbuch": 6, "ordnung": 7, "pruef": 6, "rueckmeldung": 6,
        "satzung": 7, "semestertermine": 6, "studium": 4, "studiengang": 4, "verkuendungsblatt": 7, "zulassung": 6,
        "broschuere": -4, "broschueren": -4, "flyer": -4, "galerie": -5, "gallery": -5, "news": -4, "oeffnungszeiten": -3, "poster": -5, "plakat": -5, "stundenplan": -3,
        "veranstaltung": -5, "veranstaltungen": -5,
    })
    pdf_preferred: tuple[str, ...] = ("antrag", "faq", "modulhandbuch", "ordnung", "satzung", "verkuendungsblatt")
    pdf_deferred: tuple[str, ...] = ("broschuere", "broschueren", "flyer", "poster", "stundenplan")
    media: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".bmp", ".tiff", ".ico", ".mp3", ".wav", ".ogg", ".m4a", ".aac", ".flac", ".mp4", ".webm", ".mov", ".avi", ".mkv", ".wmv")
    technical: tuple[str, ...] = (".css", ".js", ".json", ".xml", ".zip", ".rar", ".7z", ".tar", ".gz", ".xz")
    office: tuple[str, ...] = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".odt", ".ods", ".odp")
    html_like: tuple[str, ...] = ("", ".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".jspx")
    high_value: int = 4


@dataclass(frozen=True)
class RetrievalConfig:
    """Limits and weights of ranked retrieval."""

    k: int = 8
    candidates: int = 100
    buffer: int = 4
    per_url: int = 2
    augment: int = 3
    rrf: int = 60
    k1: float = 1.2
    b: float = 0.75


def data_dir(variable: str, default: str) -> str:
    """A folder that an environment variable may set."""
    return os.path.expanduser(os.environ.get(variable) or default)
