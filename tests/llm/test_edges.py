"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from florilege.llm import language, leakage, maincontent, mixing, neardup, residue, sitelines, spam, split, textstats

LONG = "Ein langer Satz über die Ordnung und den Antrag. " * 4000
CHUNKS = [
    ("a", "https://h.example/1", "S", 0, "2025-01-01", "Kurz."), ("a", "https://h.example/1", "S", 0, "2025-01-01", "Kurz."), ("b", "https://h.example/1", None, 1, None, LONG), ("c", None, None, None, None, None),
    (None, None, None, None, None, "ohne Kennung"), ("d", "kaputt", "", -1, "kaputt", ""), ("e", "https://h.example/2", "S", 2, "2025-01-02", "x" * 3000), ("f", "https://h.example/2", "S", 2, "", "\n\n \n"),
]
SCHEMA = "id string, source_url string, section_heading string, chunk_index int, crawl_date string, text string"
#: Names that the operators use within themselves.
CLASH = ("n", "key", "host", "page", "c", "g", "tokens", "rank", "line_no", "unit", "keys", "f0", "salt", "x", "_page", "language", "words", "rid", "bucket", "h")


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(CHUNKS, SCHEMA)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH})


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, "def f(x):\n    return x\n" * 9, "python", "A-b"), (1, "def f(x):\n    return x\n" * 9, "python", "A-b"), (2, None, None, None), (None, "x", "x", "x"), (3, "", "", ""), (4, LONG, "Text", "a_B"), (5, "  \n", "text", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("tokens", "h", "bucket", "rid", "w", "n", "size", "kind")})


def both(spark, df):
    """The table and the same without rows."""
    return df, spark.createDataFrame([], df.schema)


def test_split(spark, chunks):
    full, empty = both(spark, chunks)
    assert {r["id"] for r in split.split_oversized(full, ["id"]).collect()} == {"b", "e"}
    rows = split.pieces(full).collect()
    assert {r["id"] for r in rows} == {"a", "b", "c", "d", "e", "f", None} and sum(r["id"] == "a" for r in rows) == 1
    assert all(r["text"] is None or len(r["text"]) <= 1000 for r in rows)
    assert split.pieces(empty).count() == split.split_oversized(empty, ["id"]).count() == 0


def test_language(spark, chunks):
    bodies = chunks.select(F.col("id").alias("file"), "source_url", "text", "key", "n")
    labels = spark.createDataFrame([("a", None), ("b", "en"), ("b", "en"), (None, "de"), ("z", "fr"), ("e", "")], "file string, language string").withColumn("text", F.lit(1))
    found = {tuple(r) for r in language.wrong_labels(labels, bodies).collect()}
    assert found == {("b", "de")}
    assert language.wrong_labels(labels.limit(0), bodies.limit(0)).count() == 0
    model = language.fit(labels.limit(0), bodies.limit(0))
    rows = language.text_segments(chunks, model).collect()
    assert {r["id"] for r in rows} == {"a", "b", "e", "f", None}
    pages = {r["file"]: r["language"] for r in language.page_languages(bodies, model).collect()}
    assert pages["b"] == "de" and pages["e"] == "und" and pages["f"] == "und"


def test_residue(spark, chunks):
    more = chunks.unionByName(spark.createDataFrame([("r", None, None, None, None, "Guten Tag {{name}}")] * 2, SCHEMA), allowMissingColumns=True)
    full, empty = both(spark, more)
    notes = spark.createDataFrame([("https://h.example/1", None), (None, ["zu_wenig_text:3"]), ("https://h.example/1", ["x", None])], "source_url string, reasons array<string>").withColumn("page", F.lit(1))
    assert [tuple(r) for r in residue.marked(full, notes).collect()] == [("r", "field", 1, True)]
    kept = residue.without_residue(full, notes)
    assert kept.where("id = 'r'").count() == 0 and kept.count() == len(CHUNKS)
    assert residue.residue(empty, ["id"], notes.limit(0)).count() == residue.marked(empty, notes).count() == 0


def test_near_duplicates(spark, chunks):
    text = " ".join(f"wort{k}" for k in range(60))
    rows = [(i, None, None, None, None, t) for i, t in (("p", text), ("q", text), ("q", text), ("r", text + " ende"), (None, text))]
    full, empty = both(spark, chunks.unionByName(spark.createDataFrame(rows, SCHEMA), allowMissingColumns=True))
    assert {tuple(r) for r in neardup.near_pairs(full).collect()} == {("p", "q"), ("p", "r"), ("q", "r")}
    groups = {r["id"]: (r["group_id"], r["links"]) for r in neardup.near_groups(full).collect()}
    assert groups == {"p": ("p", 2), "q": ("p", 2), "r": ("p", 1), "b": ("b", 0)}
    assert neardup.near_pairs(empty).count() == neardup.near_groups(empty).count() == 0


def test_site_lines(spark, chunks):
    full, empty = both(spark, chunks)
    assert sitelines.repeated_lines(full).count() == 0
    assert sitelines.without_repeated_lines(full).count() == full.select("id", "source_url", "text").distinct().count()
    assert sitelines.repeated_lines(empty).count() == sitelines.without_repeated_lines(empty).count() == 0


def test_main_content(spark, chunks):
    full, empty = both(spark, chunks)
    assert maincontent.furniture(full, ["id"]).count() == 0
    rows = {r["id"]: r["text"] for r in maincontent.main_content(full).collect()}
    assert rows["a"] == "Kurz." and rows["c"] is None and rows["f"] == "" and len(rows["b"]) == len(LONG.strip())
    assert maincontent.furniture(empty, ["id"]).count() == maincontent.main_content(empty).count() == 0


def test_statistics(spark, chunks):
    bodies = chunks.select(F.col("id").alias("file"), "source_url", "text", "key")
    full, empty = both(spark, bodies)
    notes = spark.createDataFrame([], "source_url string, reasons array<string>")
    rows = {r["file"]: r for r in textstats.statistics(full, notes).collect()}
    assert rows["b"]["kind"] == "prose" and rows["f"]["kind"] == "empty" and rows["f"]["words"] == 0 and "c" not in rows
    assert textstats.not_prose(empty, notes).count() == 0 and None not in {r["file"] for r in textstats.not_prose(full, notes).collect()}


def test_leakage(spark, documents):
    items = spark.createDataFrame([(7, "def f(x): return x " * 5), (7, "def f(x): return x " * 5), (8, None), (None, "x y z"), (9, ""), (10, "kurz")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    full, empty = both(spark, documents)
    assert {tuple(r) for r in leakage.leaked(full, items).collect()} == {(1, 7)}
    for docs, asked in ((empty, items), (full, items.limit(0)), (empty, items.limit(0))):
        assert leakage.leaked(docs, asked).count() == leakage.leak_report(docs, asked).count() == 0


def test_mixing(spark, documents):
    targets = spark.createDataFrame([("a_b", 0.5, 2), ("leer", 0.5, None), (None, 0.1, 1), ("c", None, 1)], "source string, target_share double, max_repeats int")
    full, empty = both(spark, documents)
    sizes = mixing.token_counts(full).cache()
    assert {(r["doc_id"], r["source"]) for r in sizes.collect()} == {(1, "a_b"), (4, "a_b")}
    rows = {r["source"]: r for r in mixing.shares(sizes, targets).collect()}
    assert set(rows) == {"a_b", "leer"} and rows["leer"]["taken"] == 0 and rows["a_b"]["repeats"] == 2 and rows["a_b"]["actual_share"] == 1.0
    assert mixing.mixed(mixing.token_counts(empty), targets).count() == 0
    assert mixing.mixed(sizes, targets.limit(0)).count() == mixing.shares(sizes, targets.limit(0)).count() == 0


def test_spam(spark, documents):
    stuffed = spark.createDataFrame([(9, "lampe kaufen, lampe online, " * 40, None, None)] * 2, "doc_id long, text string, lang string, source string")
    full, empty = both(spark, documents.unionByName(stuffed, allowMissingColumns=True))
    assert [(r["doc_id"], r["kind"]) for r in spam.spam(full).collect()] == [(9, "keywords")]
    assert spam.spam(empty).count() == 0
