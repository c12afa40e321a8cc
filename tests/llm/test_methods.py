"""The methods against brute force, exact round trips and held-out labels."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from florilege.llm import language, leakage, maincontent, mixing, neardup, queries, residue, sitelines, spam, split, textstats
from florilege.llm.common import WORD


# --- 1 ----------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#!?;é́👩‍🔬", max_size=400), st.integers(12, 60), st.integers(0, 10))
def test_pieces_give_the_text_again(text, limit, overlap):
    out = split.spans(text, limit, overlap)
    assert "".join(text[a + s : b] for a, b, s in out) == text
    assert all(b - a <= limit and 0 <= s <= overlap for a, b, s in out)
    assert all(out[k][0] + out[k][2] == out[k - 1][1] for k in range(1, len(out)))


def test_pieces_are_balanced_and_cut_at_sentences():
    text = "Das ist ein Satz mit einigen Wörtern darin. " * 60
    out = split.spans(text)
    assert len(out) == -(-(len(text) - 200) // 800)
    assert all(text[b - 2 : b] == ". " for _, b, _ in out)
    sizes = [b - a - s for a, b, s in out]
    assert max(sizes) - min(sizes) < 300


def test_indexes_run_on_within_a_page(spark, small):
    rows = queries.p1_pieces(spark, small).toPandas()
    assert (rows.text.str.len() <= 1000).all()
    for _, page in rows.groupby("source_url"):
        assert sorted(page.chunk_index) == list(range(len(page)))


# --- 2 ----------------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="abc", min_size=1, max_size=40), st.text(alphabet="abcd", max_size=30))
def test_cross_parsing_against_a_plain_one(known, text):
    n, at = 0, 0
    while at < len(text):
        size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in known), 0)
        n, at = n + 1, at + max(1, size)
    assert language.phrases(language.automaton(known), text) == n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc ", min_size=1, max_size=40), min_size=1, max_size=3), st.lists(st.text(alphabet="abcd é", max_size=60), min_size=1, max_size=8))
def test_parsing_all_at_once_equals_one_by_one(known, texts):
    model = language.Model({str(k): x for k, x in enumerate(known)})
    want = [[language.phrases(language.automaton(f" {x} "), t) for x in known] for t in texts]
    assert model.phrases(texts).tolist() == want


def test_languages_of_held_out_sentences():
    model = language.Model(language.SEEDS)
    told = {
        "de": "Die Anmeldung zur Prüfung ist nur bis zum Ende der Frist möglich, und wer sie versäumt, muss ein Semester warten.", "en": "Students who miss the deadline must wait until the next term before they can register for the exam.",
        "fr": "Les étudiants qui ne respectent pas le délai doivent attendre le semestre suivant pour passer leur examen.", "es": "Los estudiantes que no cumplen el plazo deben esperar hasta el semestre siguiente para hacer el examen.",
        "it": "Gli studenti che non rispettano la scadenza devono aspettare il semestre successivo per sostenere l'esame.", "nl": "Studenten die de termijn missen moeten wachten tot het volgende semester voordat zij het examen mogen afleggen.",
        "pl": "Studenci, którzy nie dotrzymają terminu, muszą poczekać do następnego semestru, aby zdać egzamin.", "tr": "Süreyi kaçıran öğrenciler sınava girmek için bir sonraki dönemi beklemek zorundadır ve bu çok uzun olabilir.",
    }
    assert {k: language.page_language(t, model)[0] for k, t in told.items()} == {k: k for k in told}
    both = told["de"] + "\n\n" + told["fr"]
    assert language.page_language(both, model)[0] == "mixed"
    parts = language.segments(both, model)
    assert [p[2] for p in parts] == ["de", "fr"] and parts[0][0] == 0 and parts[-1][1] == len(both) and parts[0][1] == parts[1][0]
    assert language.page_language("961.06 60.95 | 12 | 7 !!", model)[0] == "und"


def test_labels_that_agree_with_the_text_are_no_cases(spark, small):
    labels, bodies = pd.read_parquet(f"{small}/quality_assessment.parquet"), pd.read_parquet(f"{small}/cleaned_body.parquet")
    found = queries.p2_pages(spark, small).toPandas().set_index("file")
    clear = labels[labels.language.isin(["de", "en"])].drop_duplicates("file")
    agree = [found.loc[f, "language"] == x for f, x in zip(clear.file, clear.language, strict=True) if f in found.index and found.loc[f, "words"] >= 30]
    assert np.mean(agree) > 0.85 and len(bodies)


# --- 3 ----------------------------------------------------------------------------------------------------------------

RESIDUE = (
    "Guten Tag {{ name }}, Ihr Termin am {% block datum %} findet in &lt;raum&gt; statt.", "Stand: ###FRIST###", "[hier datum einfügen]", "Telefon «telefon»", "# __TITEL__", "Dear <bitte Namen eintragen>, ...", "%vorname%", "[ORT_PLATZHALTER]",
    "[Name ergänzen]", "Lorem ipsum dolor sit amet consectetur.", "Dolor sit amet consectetur adipiscing elit sed eiusmod tempor.", "Unterschrift: ______", "<!-- anrede -->", "@@name@@", "%%titel%%", "${raum}", "{$ort}", "[[frist]]", "[enter your name]",
)
CONTENT = (
    "Die Vorlagensprache ersetzt Ausdrücke wie `{{ name }}` durch Werte; wie das geschieht, zeigt Kapitel drei.", "Er meldet, dass ein Server eine Seite nicht gefunden hat, und wird besprochen.", "Das Modul behandelt JavaScript, Ereignisse und Felder.",
    "Der Zugriff auf Räume wird verweigert, wenn der Ausweis nicht freigeschaltet ist; Auskunft gibt die Leitung.", "Typografie: Blindtext hilft beim Entwurf, wenn Text noch fehlt.", "#### Überschrift", "Rabatt von 5 % bis 10 % gilt weiter",
)


def test_slots_and_filler_without_any_notes(spark):
    rows = [(f"r{k}", "https://a.example/1", t) for k, t in enumerate(RESIDUE)] + [(f"c{k}", "https://a.example/2", t) for k, t in enumerate(CONTENT)] + [("m", None, "Ein Satz.\n" + RESIDUE[0] + "\nNoch einer.")]
    found = residue.residue(spark.createDataFrame(rows, "id string, source_url string, text string"), ["id"], spark.createDataFrame([], "source_url string, reasons array<string>"))
    assert {r["id"] for r in found.select("id").distinct().collect()} == {f"r{k}" for k in range(len(RESIDUE))} | {"m"}
    assert all(residue.SIGNS.search(t) or t.endswith(residue.ENDS) for t in RESIDUE if residue._SLOT.search(t) or residue._BLANK.search(t))


#: Phrases of no list in the operator: notices of an invented tongue, and content with the same openings all over.
NOTICES = ("Torka velun {} mis drabo.", "Plim {} nokt varesta tul", "Grenno fal: {} zist obar")


def site(rng: random.Random, pages: int) -> tuple[list[tuple], list[tuple]]:
    """(chunks, notes) of a site: every seventh page has only a notice, half of these are noted, and a few others wrongly."""
    nouns = [a + b for a in ("Raum", "Kurs", "Labor", "Netz", "Plan", "Bau") for b in ("stelle", "gruppe", "woche", "frist")]
    rows, notes = [], []
    for k in range(pages):
        url = f"https://a.example/{k}"
        if k % 7 == 0:
            body = NOTICES[k // 7 % 3].format(rng.choice(nouns))
        else:
            body = "\n\n".join(" ".join(f"{rng.choice(('Fragen zu der', 'Heute prüft die', 'Wer die'))} {rng.choice(nouns)} {rng.choice(('beantwortet', 'ersetzt', 'sammelt'))} die {rng.choice(nouns)}." for _ in range(3)) for _ in range(rng.randint(2, 5)))
        rows.append((str(k), url, f"# {rng.choice(nouns)}\n{body}"))
        if (k % 7 == 0 and k % 2) or rng.random() < 0.03:
            notes.append((url, ["zu_wenig_text:5"]))
    return rows, notes


def test_notices_are_learned_from_their_templates(spark):
    rows, notes = site(random.Random(4), 420)
    df, reasons = spark.createDataFrame(rows, "id string, source_url string, text string"), spark.createDataFrame(notes, "source_url string, reasons array<string>")
    found = {r["id"]: r["kind"] for r in residue.residue(df, ["id"], reasons).collect()}
    assert found == {str(k): "notice" for k in range(0, 420, 7)}
    assert residue.residue(df, ["id"], reasons.limit(0)).count() == 0


def test_filler_words_are_learned(spark):
    rng = random.Random(1)
    words = "orin valut semper dakor mivan telis".split()
    rows = [(str(k), "https://a.example/x", " ".join(rng.choices([*words, "lorem"], k=9))) for k in range(40)] + [("c", "https://a.example/y", "Die Leitung prüft semper den Plan der Woche."), ("d", "https://a.example/z", "valut telis orin dakor mivan")]
    found = residue.residue(spark.createDataFrame(rows, "id string, source_url string, text string"), ["id"], spark.createDataFrame([], "source_url string, reasons array<string>")).collect()
    assert {(r["id"], r["kind"]) for r in found} == {(str(k), "filler") for k in range(40)} | {("d", "filler")}


# --- 4 ----------------------------------------------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 150), st.integers(0, 2**32), st.integers(0, 130))
def test_gray_index_against_all_pairs(n, seed, most):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 2**63, (n, neardup.LONGS), dtype=np.uint64)
    fp[n // 2 :] = fp[: n - n // 2] ^ (np.uint64(1) << rng.integers(0, 63, (n - n // 2, neardup.LONGS), dtype=np.uint64))
    a, b = neardup.GrayIndex(fp).pairs(most)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(got) == len(a)
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if np.bitwise_count(fp[i] ^ fp[j]).sum() <= most}


def test_neighbours_in_gray_order_differ_in_one_bit():
    fp = np.zeros((16, neardup.LONGS), np.uint64)
    fp[:, 0] = np.arange(16, dtype=np.uint64) << np.uint64(60)
    order = np.lexsort(neardup.gray_rank(fp).T[::-1])
    assert all(np.bitwise_count(fp[order[k], 0] ^ fp[order[k + 1], 0]) == 1 for k in range(15))


def _similar(rows: list[tuple[str, str]]) -> set[tuple[str, str]]:
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        if len(w) >= 40:
            sets[i] = frozenset(zip(w, w[1:], w[2:], strict=False))
    inverted = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            inverted[x].add(i)
    pairs = set()
    for i, s in sets.items():
        count = defaultdict(int)
        for x in s:
            for j in inverted[x]:
                count[j] += 1
        pairs |= {(i, j) for j, n in count.items() if i < j and 2 * n >= len(s) + len(sets[j]) - n}
    return pairs


def test_near_pairs_against_brute_force(spark, small):
    path = small.replace("sf0.001", "sf0.01")
    rows = pd.read_parquet(f"{path}/hsh_vectors.parquet", columns=["id", "text"]).drop_duplicates("id")
    want = _similar(list(rows.itertuples(index=False)))
    got = {tuple(r) for r in queries.p4_found(spark, path).collect()}
    assert not got - want and len(got & want) >= 0.97 * len(want)


def test_large_groups_are_salted_without_loss(spark, monkeypatch):
    base = [f"wort{k}" for k in range(80)]
    rows = [(f"i{n}", " ".join(base[:20] + [f"eigen{n}"] + base[20:])) for n in range(40)]
    monkeypatch.setattr(neardup, "GROUP", 8)
    got = {tuple(r) for r in neardup.near_pairs(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert len(got) == 40 * 39 // 2


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (103, 102), (101, 102), (7, 7)]
    out = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[k] for k in range(61)} == {0} and {out[k] for k in (100, 101, 102, 103)} == {100}


# --- 5, 6 -------------------------------------------------------------------------------------------------------------


def test_repeated_lines_are_counted_by_page(spark):
    rows = [(str(k), f"https://H.example/{k}", f"Teilen Sie  diese Seite {k}!\nEigener Satz Nummer {chr(97 + k)}{chr(98 + k)}.") for k in range(6)]
    rows += [("x", "https://h.example/0", "Nur auf einer Seite\nNur auf einer Seite"), ("y", "https://other.example/0", "Teilen Sie diese Seite 1")] * 2
    df = spark.createDataFrame(rows, "id string, source_url string, text string")
    assert [tuple(r) for r in sitelines.repeated_lines(df).collect()] == [("h.example", "teilen sie diese seite 0", 6, 7)]
    cleaned = {r["id"]: r["text"] for r in sitelines.without_repeated_lines(df).collect()}
    assert cleaned["0"] == "Eigener Satz Nummer ab." and cleaned["y"] == "Teilen Sie diese Seite 1" and cleaned["x"].count("\n") == 1


def pages_of(rng: random.Random, n: int, head: list[str], foot: list[str], host: str = "h.example") -> list[tuple]:
    nouns = [a + b for a in ("Raum", "Kurs", "Labor", "Netz", "Plan", "Bau") for b in ("stelle", "gruppe", "woche", "frist")]
    rows = []
    for k in range(n):
        some = lambda: rng.choice(nouns)
        body = [f"# {some()}", f"Die {some()} prüft den {some()} und die {some()} nach {k} Tagen.", f"- {some()} und {some()} (Raum {k})", f"| {some()} | {k} |", "|---|---|", "## Termine", f"Am {k}. findet die {some()} in {some()} statt."]
        fill = lambda x: x.replace("*", some())
        rows.append((str(k), f"https://{host}/{k}", "\n".join([fill(x) for x in head if rng.random() < 0.8] + body + [fill(x) for x in foot if rng.random() < 0.8])))
    return rows


def test_template_lines_recur_and_headings_and_rows_stay(spark):
    long = "Menü " + " | ".join(f"Bereich {chr(97 + k)}{chr(97 + k)}" for k in range(60))
    head, foot = [long, "Zum Inhalt"], ["Wir speichern kleine Dateien, um Besuche zu zählen.", "Vuro kelt: * und *", "Alle Rechte bei der Stelle"]
    rows = pages_of(random.Random(2), 60, head, foot) + [("z", "https://einzeln.test/1", "Zum Inhalt\nEin Satz.")]
    df = spark.createDataFrame(rows, "id string, source_url string, text string")
    want = {(i, n) for i, _, t in rows if i != "z" for n, x in enumerate(t.split("\n")) if x in (long, "Zum Inhalt", foot[0], foot[2]) or x.startswith("Vuro kelt")}
    assert len(long) > 528
    assert {(r["id"], r["line_no"]) for r in maincontent.furniture(df, ["id"]).collect()} == want
    kept = maincontent.main_content(df).where("id = '3'").first()["text"]
    assert kept.startswith("# ") and "## Termine" in kept and "|---|---|" in kept and "Vuro" not in kept


def test_running_titles_count_up(spark):
    rows = [(str(k), "https://h.example/buch", f"Modul Plan\nUmfang der Arbeit im Modul: {5 * (k % 2 + 1)} Punkte\nText {chr(97 + k)} über die Ordnung.\nVerzeichnis aller Module, Seite {k + 40} von 900") for k in range(12)]
    df = spark.createDataFrame(rows, "id string, source_url string, text string")
    assert {(r["id"], r["line_no"]) for r in maincontent.furniture(df, ["id"]).collect()} == {(str(k), 3) for k in range(12)}


def test_a_section_goes_only_as_a_whole(spark):
    rows = [(str(k), f"https://h.example/{k}", f"# Seite\nText {chr(97 + k)}{chr(98 + k)} steht hier.\n# Navigation\n[Start](/a)\n[Ende](/b)") for k in range(8)]
    df = spark.createDataFrame(rows, "id string, source_url string, text string")
    assert {(r["id"], r["line_no"]) for r in maincontent.furniture(df, ["id"]).collect()} == {(str(k), n) for k in range(8) for n in (2, 3, 4)}


# --- 7 ----------------------------------------------------------------------------------------------------------------

PAGES = {
    "prose": "# Kopf\nDie Ordnung regelt die Prüfung und den Ablauf. Wer sie ablegen möchte, wendet sich an die Leitung.\n- Das Ergebnis wird in dem Protokoll festgehalten und genannt",
    "list": "# Kopf\n" + "\n".join(f"{'  ' * (k % 2)}- Raumplan und Kursplan (Raum {k})" for k in range(12)),
    "table": "# Kopf\n" + "\n".join(f"Raum{'abcdefghij'[k]}\t{k},5\tWS 2{k}\t–" for k in range(10)),
    "junk": "# Kopf\n" + "\n".join("869.54 265.45 192.84 361.93 655.50 6.01" for _ in range(8)) + "\n;°~°;:^>~~/-.<:*,>",
    "empty": "Stand: {{ datum }}",
}


@pytest.mark.parametrize("kind", PAGES)
def test_kinds(kind):
    out = dict(zip([n for n, _ in textstats.STATS], textstats.page_statistics(PAGES[kind], [], [0] if kind == "empty" else None), strict=True))
    assert out["kind"] == kind
    assert out["words"] == len(PAGES[kind].split())
    assert out["tables"] == (kind == "table")


def test_unmarked_lists_and_prose_without_stops():
    plain = "\n".join(f"Raumplan mit Kursplan, {k} Plätze" for k in range(9))
    assert textstats.page_statistics(plain)[-1] == "list"
    prose = "das protokoll umfasst neun stunden und ersetzt den plan das ergebnis wird in der anlage festgehalten und der bericht gehört zu dem raum " * 4
    assert textstats.page_statistics(prose)[-1] == "prose"


@pytest.mark.parametrize("kind", ("prose", "list", "table", "junk"))
def test_kinds_without_word_lists(kind, monkeypatch):
    monkeypatch.setattr(textstats, "SENTENCE_MARKS", frozenset())
    monkeypatch.setattr(textstats, "COMMON", frozenset())
    assert textstats.page_statistics(PAGES[kind].replace("genannt", "genannt."))[-1] == kind


def test_layout_decides():
    entries = ("Raumplan mit Kursplan", "Lageplan und Anfahrt", "Öffnung am Montag", "Telefon der Leitung", "Antrag auf Zulassung", "Bericht zur Woche")
    assert textstats.page_statistics("\n".join(f"- {x}" for x in entries))[-1] == "list"
    ragged = "\n".join(("Plan", "Raumplan mit Kursplan und Lageplan der Anfahrt samt Gebäudeverzeichnis", "Am", "Öffnungszeiten der Bibliotheksverwaltung am zweiten Standort Nordfurt", "Zu", "Prüfungsordnungsänderungssatzung für Weiterbildungsstudiengänge insgesamt"))
    rows = [(x, textstats.line_features(x)) for x in ragged.split("\n")]
    assert textstats.regularity(rows) > 0.8 > textstats.regularity(rows[:2] + rows[1:2] + rows[2:4])  # every second line is alike
    assert textstats.period([(f"{' ' * k}{m} x", textstats.line_features(f"{' ' * k}{m} x")) for k, m in enumerate("-ab-cd")]) < textstats.PERIOD
    loose = "Raum a      Plan\nText ohne Zellen\nSatz   und   noch   mehr"
    assert textstats.page_statistics(loose)[-1] != "table"


# --- 8, 9, 10 ---------------------------------------------------------------------------------------------------------


def test_leaks_against_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = set(con.execute(entry.oracle_sql()["p8_found"]).fetchall())
    assert {tuple(r) for r in queries.p8_found(spark, small).collect()} == want
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    blocks = leakage.leaked(spark.read.parquet(f"{small}/documents.parquet"), items, block_chars=200_000)
    assert {tuple(r) for r in blocks.collect()} == want


def test_every_run_lies_in_one_passage():
    for n in range(0, 120):
        starts = list(leakage._starts(n))
        assert all(any(s <= at and at + leakage.RUN <= s + leakage.WIDTH for s in starts) for at in range(n - leakage.RUN + 1))


def test_common_words_in_order():
    a, b = np.array([[1, 2, 3, 4], [1, 1, -2, -2]]), np.array([[2, 4, 9, -1], [5, 6, -1, -1]])
    assert leakage._common(a, b).tolist() == [2, 0]


def test_shares_and_nesting(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "gross" if k % 3 else "klein", int(rng.integers(1, 90))) for k in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long").cache()
    targets = spark.createDataFrame([("gross", 0.5, 1), ("Klein", 0.5, 3)], "source string, target_share double, max_repeats int")
    out = {r["source"]: r for r in mixing.shares(sizes, targets).collect()}
    assert all(abs(r["actual_share"] - 0.5) < 0.005 and r["taken"] <= r["budget"] and r["repeats"] <= r["max_repeats"] for r in out.values())
    chosen = [{r["doc_id"]: r["repeats"] for r in mixing.mixed(sizes, targets, total=t).collect()} for t in (20_000, 60_000, 90_000)]
    for less, more in zip(chosen, chosen[1:], strict=False):
        assert all(more.get(d, 0) >= n for d, n in less.items())


def test_spam_kinds(spark):
    prose = "The library is open to all students and the office will answer their questions about the course. " * 6
    code = "".join(f".a{k}-b {{\n  margin: {k}px;\n  order: 3;\n}}\n" for k in range(40))
    rows = {
        "links": "\n".join(f"https://a{k}.example/x-{k}" for k in range(30)), "tags": " ".join(f"#LampeKaufen{k}" for k in range(40)), "keywords": "Lampe kaufen; Lampe online; Lampe Test; billige Lampe; " * 15, "prose": prose, "code": code,
        "reading": "\n".join(f"[Plan](https://a.example/{k}): " + prose for k in range(3)), "words": "\n".join(f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)),
    }
    df = spark.createDataFrame([(n, k, t, "text") for n, (k, t) in enumerate(rows.items())], "doc_id long, name string, text string, lang string")
    found = {r["name"]: r["kind"] for r in spam.spam(df).join(df, "doc_id").collect()}
    assert found == {"links": "links", "tags": "tags", "keywords": "keywords"}


def test_ranks_and_slopes(spark):
    text = " ".join(w for k, w in enumerate(("alpha", "beta", "gamma", "delta"), 1) for _ in range(24 // k))
    row = spam.curves(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")).first()
    n = np.array([24, 12, 8, 6])
    want = np.polyfit(np.log(np.arange(1, 5)), np.log(n), 1)[0]
    assert row["slope"] == pytest.approx(want) and row["residual"] == pytest.approx(0, abs=1e-6) and row["distinct"] == 4
    assert re.fullmatch(r"\w+", "x")


# --- registered queries -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["p1_found", "p5_found"])
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW hsh_vectors AS SELECT * FROM '{small}/hsh_vectors.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in entry.queries()[name](spark, small).collect()) == sorted(want.fetchall())


def test_all_queries_are_named_by_problem():
    names = list(queries.queries())
    assert all(re.match(r"p\d+_", n) for n in names)
    assert {n for n in names if n.endswith("_found")} == {f"p{k}_found" for k in range(1, 11) if k != 9}
