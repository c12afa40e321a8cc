"""Texts that stay where they are while their lines are learned, and lines that are read many at once."""

from test_codes import odd_texts

from florilege.llm import codes, maincontent, residue, textstats


def test_features_of_many_lines_at_once():
    known = textstats.Lines()
    for texts in odd_texts(400):
        lines = ["# # a", "## ", "- ", *"\n".join(texts).split("\n")]
        known.read(lines)
        assert [known[x] and known[x][:2] for x in lines] == [(len(x.split()), textstats.line_features(x)) if x.strip() else None for x in lines]
    assert len(known) <= textstats.REMEMBERED


def test_what_is_remembered_of_lines_doesnt_change_them(monkeypatch):
    monkeypatch.setattr(textstats, "REMEMBERED", 20)
    known = textstats.Lines()
    for k in range(5):
        lines = [f"{'x' * 300 * (k % 2)}Wort{k + j} steht hier, {j}." for j in range(30)]
        known.read(lines)
        assert [known[x][1] for x in lines] == [textstats.line_features(x) for x in lines]


def pages(spark):
    rows = [(str(k), f"https://h.example/{k}", f"# Seite\nText {chr(97 + k)}{chr(98 + k)} steht hier.\n# Navigation\n[Start](/a)\n[Ende](/b)") for k in range(8)]
    rows += [(f"b{k}", "https://i.example/buch", f"Modul Plan\nText {chr(97 + k)} über die Ordnung.\nVerzeichnis aller Module, Seite {k + 40} von 900") for k in range(12)]
    return spark.createDataFrame([*rows, *rows[:3]], "id string, source_url string, text string")


def test_no_text_is_shuffled_for_furniture(spark, monkeypatch):
    plans, cut = [], maincontent.cut
    monkeypatch.setattr(maincontent, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or cut(df))
    df = pages(spark).coalesce(4)
    maincontent.with_furniture(df, ["id"]).count()
    assert any("text" in columns for columns, _ in plans)
    assert not [columns for columns, plan in plans if "text" in columns and "Exchange" in plan]


def test_more_recurring_hashes_than_are_broadcast_are_joined(spark, monkeypatch):
    found = lambda: sorted((r["id"], sorted(r["gone"])) for r in maincontent.with_furniture(pages(spark), ["id"]).collect())
    want = found()
    assert [x for x in want if x[0] in ("1", "b1")] == [("1", [2, 3, 4]), ("1", [2, 3, 4]), ("b1", [2])]
    joined = maincontent._joined
    seen = []
    monkeypatch.setattr(maincontent, "_joined", lambda *x: seen.append(1) or joined(*x))
    monkeypatch.setattr(maincontent, "BLOCK", 1)
    assert found() == want and seen


def test_lines_of_records_read_from_one_array():
    for texts in odd_texts(400):
        whole = "\n".join(texts)
        lines = whole.split("\n")
        low, keys, words = codes.lines_keys_and_words(whole)
        assert low == [maincontent.DIGITS.sub("0", x) for x in whole.lower().split("\n")]
        assert keys == [maincontent.line_key(x) for x in lines] and words == [" ".join(textstats.LETTERS.findall(x.lower())) for x in lines]


def test_texts_that_are_not_asked_for_slots_have_none():
    slots = ["{{ name }}", "${x}", "{% x %}", "[[ x ]]", "@@ x @@", "### x ###", "%% x %%", "%name%", "__name__", "&lt; x &gt;", "<!-- x -->", "«name»", "<Bitte Namen eintragen>", "[your name]", "[NAME_PLATZHALTER]", "Name: ____", "Name: ....", "Name: ……"]
    assert all(residue.syntax_of(x) and residue.may_have_slots(f"Text\n{x}\nText") for x in slots)
    for texts in odd_texts(400):
        for text in texts:
            assert residue.may_have_slots(text) or not any(map(residue.syntax_of, text.split("\n")))
    assert not residue.may_have_slots("Ein Text.\n# Kopf")
