"""Sources: Markdown folders, front matter, chunk tables, evaluation cases, HTML pages and site maps."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns a chunk table must have, and those that are empty where it lacks them.
REQUIRED = ("id", "vector", "text", "sparse_indices", "sparse_values")
OPTIONAL = ("section_heading", "language", "quality_score", "document_kind", "source_family", "document_group", "topic_tags")
#: Schema of evaluation cases.
CASES = (
    "id string, question string, reference_answer string, case_type string, case_difficulty string, fairness_risk string, expected_behavior string, source_url string, source_policy string, "
    "accepted_source_urls array<string>, clarification struct<expected: boolean, selected_option: string, clarification_text: string>, required_facts array<string>, optional_facts array<string>, "
    "forbidden_claims array<string>, answer_variants array<struct<id: string, title: string, source_url: string, source_policy: string, accepted_source_urls: array<string>, required_facts: array<string>, "
    "optional_facts: array<string>, forbidden_claims: array<string>>>, evaluation_notes string, tags array<string>"
)
BEHAVIORS = ("direct_answer", "clarify", "refuse_or_missing_detail")
POLICIES = ("exact_gold_source", "accepted_sources", "official_any")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the Markdown files of a folder."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def _meta(block: Column, quotes: str) -> Column:
    """Map of ``key: value`` lines; the last of a repeated key counts."""
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), rf"^[{quotes}]+|[{quotes}]+$", "").alias("v")))
    last = F.filter(F.arrays_zip(pairs.alias("p"), F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1))).alias("i")), lambda x: ~F.exists(F.slice(pairs, x["i"] + 1, F.size(pairs)), lambda y: y["k"] == x["p"]["k"]))
    return F.map_from_entries(F.transform(F.filter(last, lambda x: x["p"].isNotNull()), lambda x: x["p"]))


def front_matter(df: DataFrame, content: str = "content", form: str = "strict") -> DataFrame:
    """``df`` with ``meta`` and ``body``.

    strict: the content begins with ``---``; lenient: it need not, and rows without body go; block: a block between
    lines of ``---`` at the very start, of whose values both kinds of quotes are removed. Without front matter the
    map is empty and the body is the whole. Null contents have an empty map and a null body.
    """
    c = F.col(content)
    parts = F.split(c, "---", 3)
    if form == "block":
        block = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---\n", 1)
        found, body, quotes = c.rlike(r"(?s)\A---\n.*?\n---\n"), F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", ""), "\"'"
    else:
        found = F.size(parts) >= 3
        if form == "strict":
            found = found & c.startswith("---")
        block, body, quotes = F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(2))), '"'
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    out = df.withColumns({"meta": F.when(F.coalesce(found, F.lit(False)), _meta(block, quotes)).otherwise(none), "body": F.when(found, strip(body)).otherwise(strip(c))})
    return out.where("body <> ''") if form == "lenient" else out


def chunk_table(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunk table at the first of the paths that exists; missing optional columns are empty, required ones must be there."""
    path = next((p for p in paths if _exists(spark, p)), None)
    if path is None:
        raise FileNotFoundError(", ".join(paths))
    df = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("") for c in OPTIONAL})


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file, coerced: unknown behaviours and policies become the defaults, missing lists empty."""
    df = spark.read.schema(CASES).json(path, multiLine=True).where("id IS NOT NULL AND question IS NOT NULL")
    lists = ("accepted_source_urls", "required_facts", "optional_facts", "forbidden_claims", "tags")
    df = df.withColumns({c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "") for c in lists})
    pick = lambda c, allowed: F.when(F.lower(c).isin(*allowed), F.lower(c)).otherwise(allowed[0])
    return df.withColumns({"expected_behavior": pick(F.col("expected_behavior"), BEHAVIORS), "source_policy": pick(F.col("source_policy"), POLICIES), "negative_case": F.exists("tags", lambda t: F.lower(t).isin("negative", "negativ"))})


def sitemap_locations(xml: Column) -> Column:
    """Locations listed in a site map, whatever its name spaces; the XML must be well formed, null gives null."""
    return F.xpath(xml, F.lit('//*[local-name()="loc"]/text()'))


class _Main(HTMLParser):
    """Text of the main part of a page as Markdown-like lines."""

    SKIP = frozenset("nav header footer aside form iframe script style noscript".split())
    MAIN = frozenset("main article".split())
    BREAKS = frozenset("p div section li tr br h1 h2 h3 h4 h5 h6 ul ol table".split())

    def __init__(self, only_main: bool) -> None:
        super().__init__()
        self.only_main, self.skip, self.main, self.out, self.title, self.in_title = only_main, 0, 0, [], "", False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in self.SKIP
        self.main += tag in self.MAIN
        self.in_title = tag == "title"
        if tag in self.BREAKS:
            self.out.append("\n" + ("#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else ""))

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in self.SKIP and self.skip > 0
        self.main -= tag in self.MAIN and self.main > 0
        self.in_title = False
        if tag in self.BREAKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip and (self.main or not self.only_main):
            self.out.append(data)


def main_text(html: str) -> tuple[str, str]:
    """(title, text) of an HTML page: its main element, or all of it without navigation, forms and scripts."""
    parser = _Main(only_main="<main" in html.lower() or "<article" in html.lower())
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return " ".join(parser.title.split()), "\n".join(x for x in lines if x and x.strip("#- "))


def html_pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, text) of HTML pages; null pages are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [main_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p[0] for p in pages], pa.string()), pa.array([p[1] for p in pages], pa.string())], names=[key, "title", "text"])

    rows = df.where(F.col(html).isNotNull()).select(key, html)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, title string, text string")
