"""Kinds of pages whose rows are uneven and whose entries are parted or long."""

import pytest

from florilege.llm import textstats

NAMES = ("Nordbau", "Südbau", "Werkhof", "Altbau", "Mensa", "Labor", "Turm", "Halle")
PAGES = {
    "uneven": ("table", "\n".join(f"{n:<12}{'Seminarraum' if k % 2 else '':<16}{'Beamer und Tafel' if k % 3 else '':<20}{'offen' if k % 4 < 3 else ''}".rstrip() for k, n in enumerate(NAMES))),
    "parted": ("list", "\n\n".join(f"Raumplan {n} mit Kursplan" for n in NAMES)),
    "long": ("list", "\n".join(f"Raumplan {n} mit Kursplan, Lageplan, Anfahrt, Ausstattung, Öffnungszeiten, Ansprechpartner, Telefon, Belegung" for n in NAMES)),
}


@pytest.mark.parametrize("name", PAGES)
def test_uneven_rows_and_parted_or_long_entries(name):
    kind, text = PAGES[name]
    assert textstats.page_statistics(text)[-1] == kind
