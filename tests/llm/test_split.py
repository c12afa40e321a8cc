"""Chunks without an id."""

from florilege.llm import split


def test_chunks_without_an_id_stay_apart(spark):
    rows = [(None, "https://h.example/1", "S", 0, None, "Eins."), (None, "https://h.example/1", "S", 1, "2025-01-01", "Zwei."), (None, None, None, None, None, "Drei."), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:2] + [("a", None, None, 0, None, "Vier.")], "id string, source_url string, section_heading string, chunk_index int, crawl_date string, text string")
    assert sorted((r["id"] or "", r["text"] or "") for r in split.pieces(df).collect()) == [("", ""), ("", "Drei."), ("", "Eins."), ("", "Zwei."), ("a", "Vier.")]
