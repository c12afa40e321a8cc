import duckdb
import pytest

import __spark_entry__ as entry

#: Whole registered queries that are quick on the smallest tables.
NAMES = ("url_normalize", "url_decision_stats", "decision_store_upsert", "crawl_gate", "quality_score", "bm25_topk", "hybrid_topk", "band_context", "similar_terms", "source_policy", "stream_upsert", "cube_rollup")


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, small):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("hsh_vectors", "cleaned_body", "quality_assessment", "url_decisions", "documents", "benchmark", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    got = entry.queries()[name](spark, small)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    clean = lambda v: round(v, 5) if isinstance(v, float) else str(v)
    assert sorted(got.columns) == sorted(names)
    assert sorted([clean(r[c]) for c in sorted(names)].__repr__() for r in got.collect()) == sorted([clean(v) for _, v in sorted(zip(names, r, strict=True))].__repr__() for r in want.fetchall())
