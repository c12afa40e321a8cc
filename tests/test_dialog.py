from datetime import datetime as D
from datetime import timedelta

from pyspark.sql import functions as F

from florilege.functions import answers
from florilege.operators import evaluation
from florilege.sources import readers, sinks
from florilege.streaming import jobs


def test_answers(spark):
    texts = {
        "A\n\nQuellen:\n- x\n\nHinweis: y\n\nQuellen:\n- x": "A\n\nQuellen:\n- x",
        "A\n\nHinweis: y\n\nQuellen:\n- x": "A\n\nHinweis: y\n\nQuellen:\n- x",
        "Eins\n\nEINS \n\nZwei\n\nEins": "Eins\n\nZwei\n\nEins",
        "": "",
    }
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", answers.clean_answer(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == {**texts, None: ""}
    row = spark.createDataFrame([("<think>a</think>b<think>c",)], "t string").select(answers.without_thoughts(F.col("t"))).first()
    assert row[0] == "b"


def test_routing_and_memory(spark):
    asked = [("Der Link geht nicht", True), ("Welche Quelle?", True), ("Welche Quelle?", False), (None, True)]
    rows = spark.createDataFrame(asked, "q string, last boolean").select(answers.route(F.col("q"), F.col("last"))).collect()
    assert [r[0] for r in rows] == ["followup_link", "followup_source", None, None]
    turns = spark.createDataFrame([("a", k, str(k)) for k in range(7)], "c string, n long, v string")
    last = answers.memory(turns, "c", "n", "v").orderBy("n").collect()[-1]
    assert (last["memory"], last["previous"]) == ("2|3|4|5|6", "5")


def test_json_objects(spark):
    texts = ['{"a": 1}', 'Text ```json\n{"a": 1}\n``` Ende', 'vor {"a": {"b": 2}} nach', "[1, 2]", "{kaputt", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(answers.json_object(F.col("t"))).collect()
    assert [r[0] for r in rows] == ['{"a": 1}', '{"a": 1}', '{"a": {"b": 2}}', None, None, None]


def test_source_policies(spark):
    cases = [("a", "https://x.example/p", "exact_gold_source", []), ("b", "https://x.example/q", "accepted_sources", ["https://x.example/P/"]), ("c", "", "official_any", []), ("d", None, "exact_gold_source", None), ("e", "https://x.example/z", "exact_gold_source", [])]
    df = spark.createDataFrame(cases, "case_id string, source_url string, source_policy string, accepted_urls array<string>")
    hits = [(c, r, u) for c in "abcde" for r, u in ((1, "https://y.example/"), (2, "https://X.example/p/"))]
    out = {r["case_id"]: r for r in evaluation.source_check(df, spark.createDataFrame(hits, "case_id string, rank long, source_url string"), "x.example").collect()}
    assert [(out[c]["matched_rank"], out[c]["satisfied"], out[c]["score"]) for c in "abcde"] == [(2, True, 4), (2, True, 4), (2, True, 4), (None, True, 5), (None, False, 0)]
    assert out["b"]["gold_rank"] is None and out["a"]["gold_rank"] == 2


def test_judgements(spark):
    rows = [("0", "5", "5", "5", "5", "fully_grounded", True, 4), ("5", "5", "4", "5", "x", "fully_grounded", False, 0), (None, "9", "-3", "", "2", "egal", True, 5)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in evaluation.RUBRIC) + ", verdict string, satisfied boolean, score int")
    out = evaluation.finalize(df).collect()
    assert (out[0]["overall_score"], out[0]["verdict"], out[0]["source_retrieval"]) == (96.0, "fully_grounded", 4)
    assert (out[1]["evidence_sufficiency"], out[1]["citation_support"], out[1]["verdict"]) == (2, 2, "wrong_source")
    assert (out[2]["evidence_sufficiency"], out[2]["answer_grounding"], out[2]["verdict"]) == (5, 0, "partially_grounded")
    base = dict(stage_1=50.0, stage_2=90.0, missing_required=False, missing_optional=True, forbidden=False, satisfied=True, retrieved=True, verdict="fully_grounded", unsupported=False, evidence_sufficiency=4, answer_grounding=2, citation_support=2, clarification_expected=True, dialog_behavior=1, refused=True, expected_behavior="direct_answer", fairness_risk="low")
    d = evaluation.diagnostics(spark.createDataFrame([base])).first()
    assert d["stage_gap"] == 40.0 and d["human_review"]
    assert d["failure_types"] == "answer_ignored_evidence|citation_problem|missing_optional_fact|reference_too_strict|should_have_clarified|stage_disagreement|wrong_refusal"


def test_summary_and_resume(spark):
    rows = [("r", "a", 5, 1, True), ("r", "b", 0, None, False), ("r", "c", 4, 3, True)]
    out = evaluation.run_summary(spark.createDataFrame(rows, "run_id string, case_id string, score int, matched_rank long, satisfied boolean")).first()
    assert (out["cases"], out["mean_score"], out["mean_rank"], out["satisfied"], out["hit_at_1"], out["hit_at_3"]) == (3, 3.0, 2.0, 2, 1, 2)
    left = evaluation.remaining(spark.createDataFrame([(c,) for c in "cab"], "case_id string"), spark.createDataFrame([("b",)], "case_id string"))
    assert [(r["case_id"], r["position"]) for r in left.orderBy("position").collect()] == [("a", 1), ("c", 2)]


def test_admission(spark):
    t = D(2025, 1, 1)
    rows = [("k", t)] * 3 + [("j", t + timedelta(seconds=s)) for s in (0, 1, 2, 61, 62)] + [(None, t)]
    out = jobs.admission(spark.createDataFrame(rows, "key string, ts timestamp"), "key", "ts", 2, 60.0).collect()
    assert sorted(r["wait"] for r in out if r["key"] == "k") == [0.0, 0.0, 60.0]
    assert [r["wait"] for r in sorted((r for r in out if r["key"] == "j"), key=lambda r: r["ts"])] == [0.0, 0.0, 58.0, 0.0, 58.0]


def test_streams_equal_batches(spark, tmp_path):
    t = D(2025, 1, 1)
    rows = [(k % 3, f"e{k % 2}", t + timedelta(minutes=k)) for k in range(40)]
    df = spark.createDataFrame(rows, "user_id long, kind string, ts timestamp")
    for k in range(3):
        df.where(f"user_id = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    events = jobs.stream(spark, str(tmp_path / "events.parquet"), 1)
    once = jobs.run(jobs.distinct_events(events, "ts", "1 day", "user_id", "kind").select("user_id", "kind"), "append")
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in df.select("user_id", "kind").distinct().collect()}
    assert once.count() == 6
    counted = jobs.run(jobs.window_counts(events, "ts", "10 minutes", None, "kind"), "complete")
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in jobs.window_counts(df, "ts", "10 minutes", None, "kind").collect()}
    limited = jobs.run(jobs.admission_stream(events, "user_id", "ts", 2, 600.0), "append")
    batch = jobs.admission(df, "user_id", "ts", 2, 600.0)
    assert sorted(r["wait"] for r in limited.collect()) == sorted(r["wait"] for r in batch.collect())


def test_front_matter(spark):
    texts = ['---\nsource_url: "https://a.example/x"\ntitle: "A: b"\n---\n\nKörper\n', "kein Kopf", "x---a: b---\nkurz", "---\na: 'q'\n---\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    strict = readers.front_matter(df).collect()
    assert strict[0]["meta"] == {"source_url": "https://a.example/x", "title": "A: b"} and strict[0]["body"] == "Körper"
    assert strict[1]["meta"] == {} and strict[2]["meta"] == {} and strict[4]["body"] is None
    lenient = readers.front_matter(df, form="lenient").collect()
    assert [r["body"] for r in lenient] == ["Körper", "kein Kopf", "kurz"] and lenient[2]["meta"] == {"a": "b"}
    block = readers.front_matter(df, form="block").collect()
    assert block[3]["meta"] == {"a": "q"} and block[2]["meta"] == {}


def test_files_there_and_back(spark, tmp_path):
    folder = tmp_path / "md"
    folder.mkdir()
    (folder / "2025-01-01_a.md").write_text('---\ntitle: "T"\n---\n\n# A\nText', encoding="utf-8")
    rows = readers.front_matter(readers.markdown_files(spark, str(folder)))
    row = rows.select("file", "meta", "body", sinks.markdown(F.col("meta"), F.col("body")).alias("out")).first()
    assert (row["file"], row["meta"], row["body"]) == ("2025-01-01_a.md", {"title": "T"}, "# A\nText")
    assert row["out"] == '---\ntitle: "T"\n---\n\n# A\nText'
    chunks_ = spark.createDataFrame([("i", [0.5], "t", [1], [2.0], "f", "g", "u")], "id string, vector array<float>, text string, sparse_indices array<int>, sparse_values array<float>, source_family string, document_group string, source_url string")
    sinks.write_chunks(chunks_, str(tmp_path / "c.parquet"))
    back = readers.chunk_table(spark, str(tmp_path / "missing.parquet"), str(tmp_path / "c.parquet")).first()
    assert back["id"] == "i" and back["language"] == "" and back["source_family"] == "f"
    cases = tmp_path / "cases.json"
    cases.write_text('[{"id": "q01", "question": "Was?", "source_policy": "EGAL", "tags": ["Negative", " "]}, {"question": "ohne id"}]', encoding="utf-8")
    case = readers.eval_cases(spark, str(cases)).collect()
    assert len(case) == 1 and case[0]["source_policy"] == "exact_gold_source" and case[0]["negative_case"] and case[0]["tags"] == ["Negative"]
    sinks.write_run(spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n long"), str(tmp_path / "runs"))
    sinks.write_run(spark.createDataFrame([("r2", 3)], "run_id string, n long"), str(tmp_path / "runs"))
    assert {(r["run_id"], r["n"]) for r in spark.read.json(str(tmp_path / "runs")).collect()} == {("r1", 1), ("r2", 3)}


def test_pages_and_site_maps(spark):
    html = "<html><head><title> T </title><style>x</style></head><body><nav>Menü</nav><main><h1>Kopf</h1><p>Ein <b>Wort</b></p><ul><li>a</li></ul><script>s()</script></main><footer>f</footer></body></html>"
    row = readers.html_pages(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html").collect()
    assert [(r["title"], r["text"]) for r in row] == [("T", "# Kopf\nEin Wort\n- a")]
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/1</loc></url><url><loc>https://a.example/2</loc></url></urlset>'
    assert spark.createDataFrame([(xml,)], "x string").select(readers.sitemap_locations(F.col("x"))).first()[0] == ["https://a.example/1", "https://a.example/2"]
