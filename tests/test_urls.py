from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from florilege.config import SiteConfig
from florilege.functions import ids, urls

NORMAL = {
    "HTTPS://WWW.HS-Nordfurt.example:443/a//b/index.html?utm_source=x&q=1#top": "https://www.hs-nordfurt.example/a/b?q=1",
    "http://hs-nordfurt.example": "http://www.hs-nordfurt.example/",
    "https://user:pw@f1.hs-nordfurt.example:8080/x/": "https://f1.hs-nordfurt.example:8080/x",
    "https://a.example/p;v=1?b=&a=ä ö": "https://a.example/p?b=&a=%C3%A4+%C3%B6",
    "https://a.example:99999/x": "https://a.example:99999/x",
    "https://a.example/INDEX.PHP": "https://a.example/",
    "mailto:x@y.example": "mailto:x@y.example",
    "": "/",
}
DECISIONS = {
    "https://www.hs-nordfurt.example/studium/pruefungsordnung.pdf": ("allow_high_value", "erlaubt_high_value_pdf"),
    "https://www.hs-nordfurt.example/x.pdf": ("allow_low_value", "erlaubt_low_value_pdf"),
    "https://www.hs-nordfurt.example/en/x": ("block", "blockiert_englischen_en_bereich"),
    "https://www.hs-nordfurt.example/bild.PNG": ("block", "blockiert_medien_datei"),
    "https://www.hs-nordfurt.example/style.css": ("block", "blockiert_technisches_asset"),
    "https://www.hs-nordfurt.example/a.docx": ("block", "blockiert_office_dokument_ohne_ingest_support"),
    "https://www.hs-nordfurt.example/news/antrag": ("block", "blockiert_low_value_pfad"),
    "https://www.hs-nordfurt.example/login": ("block", "blockiert_auth_pfad"),
    "https://www.hs-nordfurt.example/impressum": ("allow_low_value", "erlaubt_low_value_html_pfad"),
    "https://www.hs-nordfurt.example/bewerbung": ("allow_high_value", "erlaubt_high_value_html_seite"),
    "https://www.hs-nordfurt.example/a.xyz": ("allow_low_value", "erlaubt_low_value_datei"),
    "https://test.hs-nordfurt.example/": ("block", "blockiert_preview_dev_backend_host"),
    "https://moodle.hs-nordfurt.example/": ("block", "blockiert_nicht_oeffentliche_app"),
    "https://katalog.bib.hs-nordfurt.example/": ("block", "blockiert_bibliothekskatalog"),
    "https://other.example/": ("block", "blockiert_externe_domain"),
    "https://www.hs-nordfurt.example/a|b": ("block", "blockiert_vermutlich_kaputte_url"),
    "ftp://www.hs-nordfurt.example/": ("block", "blockiert_nicht_http"),
}


def test_normal_form(spark):
    rows = urls.with_normalized(spark.createDataFrame([(u,) for u in [*NORMAL, None]], "url string"), "url").collect()
    assert {r["url"]: r["normalized_url"] for r in rows} == {**NORMAL, None: None}


def test_normal_form_is_stable(spark):
    once = urls.with_normalized(spark.createDataFrame([(u,) for u in NORMAL.values()], "url string"), "url")
    assert once.where("url <> normalized_url").count() == 0


def test_query_against_the_library(spark):
    queries = ["a=1&b=2", "a&b=", "x=%C3%A4+y&print=1", "~=*&q=a-b_c.d", "k=1&&k=2"]
    found = spark.createDataFrame([(q,) for q in queries], "q string").select(urls.normal_query(F.col("q"), SiteConfig().noisy_params)).collect()
    want = [urlencode([(k, v) for k, v in parse_qsl(q, keep_blank_values=True) if k.lower() not in SiteConfig().noisy_params]) for q in queries]
    assert [r[0] for r in found] == want


def test_decisions(spark):
    rows = urls.with_decision(spark.createDataFrame([(u,) for u in [*DECISIONS, None]], "normalized_url string")).collect()
    found = {r["normalized_url"]: (r["decision"], r["reason"]) for r in rows}
    assert found.pop(None) == ("block", "blockiert_ungueltige_url")
    assert found == DECISIONS
    assert all(r["priority_score"] == 0 for r in rows if r["decision"] == "block")


def test_a_filter_on_the_decision_stays_small(spark):
    df = urls.with_decision(urls.with_normalized(spark.createDataFrame([(u,) for u in DECISIONS], "url string"), "url"))
    assert df.where("decision = 'block'").where("priority_score = 0").count() == sum(d == "block" for d, _ in DECISIONS.values())


@pytest.mark.parametrize("url", ["https://A.example:80/x", "http://[::1]:8/x", "//h/x", "x/y", ""])
def test_host_against_the_library(spark, url):
    row = spark.createDataFrame([(url,)], "u string").select(urls.host(F.col("u"))).first()
    assert row[0].strip("[]") == (urlsplit(url).hostname or "")


def test_ids(spark):
    import uuid

    names = ["https://a.example/x#0", "ä#12", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("id")).collect()
    assert all(r["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in rows)
