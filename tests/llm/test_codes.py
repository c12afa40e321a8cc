"""Texts read as arrays of code points, compared with ``str`` and ``re`` on odd characters."""

import random
import time

from florilege.llm import codes, language, maincontent, residue, textstats

PIECES = [*"abcÄéIİıΣσς19٣²Ⅷ𝐀𐐀😀_-–.!?;:\"'”»)](@/ \n\t\r\xa0|#\0", *[" "] * 8, "https://x.y", "www.z ", "](a)", "a@b.cd", ".) ", "\n\n"]


def odd_texts(n: int) -> list[list[str]]:
    rng = random.Random(5)
    return [["".join(rng.choices(PIECES, k=rng.randrange(40))) for _ in range(rng.randrange(1, 5))] for _ in range(n)]


def test_sentences_of_many_texts_at_once():
    for texts in odd_texts(400):
        p = language.split(texts)
        words = [codes.string(p.data[f : f + s]) for f, s in zip(p.first, p.size, strict=True)]
        found = list(zip(p.text.tolist(), p.start.tolist(), p.line.tolist(), words, p.n.tolist(), strict=True))
        assert found == [(k, at, line, w, n) for k, x in enumerate(texts) for at, _, line, w, n in language.sentences(x)]


def test_line_keys_of_many_lines_at_once():
    for texts in odd_texts(400):
        lines = "\n".join(texts).split("\n")
        assert codes.line_keys("\n".join(texts)) == [maincontent.line_key(x) for x in lines]
        assert codes.line_keys("\n".join(texts), digits=False) == [maincontent.OTHER.sub(" ", x.lower()).strip() for x in lines]


def test_pages_judged_together_are_judged_alike_and_cheaply():
    model = language.Model(language.SEEDS)
    seeds = list(language.SEEDS.values())
    texts = ["", "12 | 7", *("\n".join(f"{seeds[(k + j) % 3][40 * j : 40 * j + 300]}. Das ist\n# Titel" for j in range(12)) for k in range(200))]
    alone = [language.page_language(t, model, [1]) for t in texts]
    assert language._pages(texts, [[1]] * len(texts), model) == [(x, round(c, 4), len(t.split())) for (x, c, *_), t in zip(alone, texts, strict=True)]

    def least(f) -> float:
        took = []
        for _ in range(5):
            at = time.process_time()
            f()
            took.append(time.process_time() - at)
        return min(took)

    assert least(lambda: language.split(texts)) < 0.75 * least(lambda: [language.sentences(t) for t in texts])


def test_words_pieces_and_symbols_of_many_lines_at_once():
    for texts in odd_texts(400):
        lines = "\n".join(texts).split("\n")
        words, pieces, symbols = codes.line_parts("\n".join(texts))
        assert words == [" ".join(textstats.LETTERS.findall(x.lower())) for x in lines]
        assert pieces == [len(x.split()) for x in lines] and symbols == [sum(map(len, textstats.SYMBOL.findall(x))) for x in lines]


def test_features_of_a_line_are_the_same_if_its_words_are_known():
    for texts in odd_texts(400):
        for line in "\n".join(texts).split("\n"):
            (words,), _, (symbols,) = codes.line_parts(line)
            assert textstats.line_features(line, words, symbols) == textstats.line_features(line)


def test_records_of_lines_read_at_once():
    for texts in odd_texts(400):
        for text, _, low, keys, _ in residue._lowered(texts, [[]] * len(texts)):
            assert [residue._record_keys(*x) for x in zip(low, keys, strict=True)] == [residue.template_keys(x) for x in text.split("\n")]
