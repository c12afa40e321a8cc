"""Rule-based analysis of questions, as columns: codes, faculties, intents, retrieval terms and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import text as T

# Patterns and words of the analysis.
CODE = r"\b[A-Z]{1,5}-?\d{1,4}[A-Z]?\b"
ABBREVIATION = r"\b[A-Z]{2,8}\b"
KNOWN = ("ATPO", "BPO", "ECTS", "MPO", "PO", "SWS")
FACULTY_CODE = r"(?i)^(?:f|fak|fakultaet|fakultät|faculty)\s*(?:[1-5]|i{1,3}|iv|v)$"
FACULTY = r"(?i)\b(?:fak(?:ultat|ultaet|ultät)?|faculty)\s*([1-5]|i{1,3}|iv|v)\b|\bf\s*([1-5])\b"
DEFINITION = ("was ist", "was bedeutet", "definition", "steht fuer", "steht für", "abkuerzung", "abkürzung")
EXAM_FORMS = ("pruefungsform", "prüfungsform")
WORKFLOW = (
    "hochladen", "unterlagen", "online-antrag", "online antrag", "online-antraege", "online-anträge", "formular", "antrag", "bewerben", "bewerbung", "pruefungsanmeldung", "prüfungsanmeldung", "pruefung anmelden",
    "prüfung anmelden", "campusmanagement", "portal",
)
EXAM = ("pruefungsanmeldung", "prüfungsanmeldung", "pruefung anmelden", "prüfung anmelden", "campusmanagement")
CONTACT = ("wen kontaktiere", "wen frage", "kontakt", "ansprech", "zustaendig", "zuständig", "telefon", "email", "e-mail", "beratung")
STUDY = (
    "abschluss", "zulassungsfrei", "zulassungsbeschraenkt", "zulassungsbeschränkt", "vorpraktikum", "regelstudienzeit", "studienbeginn", "sommersemester", "wintersemester", "wann kann man beginnen", "wie lange dauert",
    "wie lange",
)
DEFINITION_PHRASES = ("was bedeutet", "was ist", "wofuer steht", "wofür steht", "steht fuer", "steht für", "definition von", "definition")
DEFINITION_FILL = ("das", "dem", "den", "der", "des", "die", "ein", "eine", "einem", "einen", "einer", "ist", "von", "was")
PERSON_FILL = ("wer", "ist", "sind", "war", "bitte", "eigentlich")
PERSON_TITLE = r"(?i)^(?:herr|frau|prof(?:essor)?|prof\.|dr|dr\.|dozent(?:in)?)$"
GENERIC = (
    "online-antrag", "online antrag", "online-anträge", "online-antraege", "antrag", "formular", "online", "portal", "hochladen", "unterlagen", "einreichen", "wen kontaktiere", "kontakt",
)
SPECIFIC = (
    "bewerbung", "bewerbungsportal", "beurlaubung", "pruefungsanmeldung", "prüfungsanmeldung", "rueckmeldung", "rückmeldung", "semesterbeitrag", "namensaenderung", "namensänderung", "anschrift", "adresse", "unfall",
    "erstsemester", "icms", "campusmanagement", "langzeitstudien", "studienberatung", "pruefungsverwaltung", "prüfungsverwaltung",
)
TIME = ("heute", "aktuell", "jetzt")
REFUSALS = ("keine information", "keine informationen", "nicht gefunden", "kann ich nicht beantworten", "liegen mir nicht vor", "nicht enthalten", "keine angabe")
ROMAN = {"1": "I", "2": "II", "3": "III", "4": "IV", "5": "V", "i": "I", "ii": "II", "iii": "III", "iv": "IV", "v": "V"}


def dedupe(items: Column) -> Column:
    """Items squeezed, without empty ones, and without those that differ from an earlier one only in case."""
    clean = F.filter(F.transform(items, T.squeeze), lambda x: x != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def codes(query: Column) -> Column:
    """Codes such as module numbers in the query in upper case, faculty codes left out."""
    return F.filter(F.regexp_extract_all(F.upper(query), F.lit(CODE), 0), lambda x: ~x.rlike(FACULTY_CODE))


def abbreviations(query: Column) -> Column:
    found = F.regexp_extract_all(F.upper(query), F.lit(ABBREVIATION), 0)
    return F.array_distinct(F.filter(found, lambda x: x.isin(*KNOWN)))


def faculties(query: Column) -> Column:
    """Faculties mentioned, by digit or Roman number, in order."""
    roman = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    both = F.arrays_zip(F.regexp_extract_all(query, F.lit(FACULTY), 1).alias("a"), F.regexp_extract_all(query, F.lit(FACULTY), 2).alias("b"))
    return F.array_distinct(F.transform(both, lambda x: F.concat(F.lit("Fakultät "), F.element_at(roman, F.lower(F.when(x["a"] != "", x["a"]).otherwise(x["b"]))))))


def definition_target(query: Column) -> Column:
    """What a definition question asks for: its words without the phrases and fillers."""
    low = F.lower(query)
    for p in DEFINITION_PHRASES:
        low = F.replace(low, F.lit(p), F.lit(" "))
    words = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}_-]", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*DEFINITION_FILL)), " ")


def person_terms(query: Column, most: int = 3) -> Column:
    words = F.split(F.trim(F.regexp_replace(query, r"[^\p{L}\p{N}_.-]", " ")), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*PERSON_FILL) & ~w.rlike(PERSON_TITLE)), 1, most)


def assess(df: DataFrame, query: str = "query") -> DataFrame:
    """``df`` with codes, abbreviations, detected_faculties, intents, retrieval_terms, broad and too_short.

    A null question counts as empty and has none of them.
    """
    c = F.col
    df = df.withColumns({"_q": F.coalesce(c(query), F.lit("")), "_l": F.lower(F.coalesce(c(query), F.lit("")))})
    df = df.withColumns({"codes": codes(c("_q")), "abbreviations": abbreviations(c("_q")), "detected_faculties": faculties(c("_q"))})
    known = (F.size("codes") > 0) | (F.size("abbreviations") > 0)
    df = df.withColumns({
        "_def": known | T.contains_any(c("_l"), DEFINITION + EXAM_FORMS), "_work": T.contains_any(c("_l"), WORKFLOW), "_exam": T.contains_any(c("_l"), EXAM), "_contact": T.contains_any(c("_l"), CONTACT),
        "_person": c("_l").rlike(r"^wer (?:ist|war|sind) ") & (F.size(person_terms(c("_q"))) > 0), "_study": T.contains_any(c("_l"), STUDY),
    })
    names = (("_def", "definition"), ("_work", "workflow"), ("_exam", "exam_registration"), ("_contact", "contact"), ("_person", "person_lookup"), ("_study", "study_program_facts"))
    df = df.withColumn("intents", F.array_compact(F.array(*[F.when(c(x), name) for x, name in names])))
    both = F.concat("codes", "abbreviations")
    target = definition_target(c("_q"))
    df = df.withColumns({
        "retrieval_terms": dedupe(F.when(F.size(both) > 0, both).when(c("_def") & (target != ""), F.array(target)).otherwise(F.array().cast("array<string>"))),
        "broad": ~c("_exam") & ~known & (F.size("detected_faculties") == 0) & (c("_work") | c("_contact")) & T.contains_any(c("_l"), GENERIC) & ~T.contains_any(c("_l"), SPECIFIC),
        "too_short": ((F.length("_q") < 18) | (T.word_count(c("_q")) < 4)) & (c("_def") | ~(c("_work") | c("_contact"))),
    })
    return df.drop("_q", "_l", "_def", "_work", "_exam", "_contact", "_person", "_study")


def variants(df: DataFrame, query: str = "query", institution: str = "", most: int = 10) -> DataFrame:
    """``df`` (assessed) with ``variants``: the question and what its intents add, deduplicated, at most ``most``."""
    has = lambda x: F.array_contains("intents", x)
    none = F.array().cast("array<string>")
    add = lambda *xs: F.array(*[F.lit(f"{x} {institution}".strip()) for x in xs])
    per_term = F.flatten(F.transform("retrieval_terms", lambda t: F.array(F.concat(t, F.lit(" Bedeutung")), F.concat(t, F.lit(" steht für")), F.concat(t, F.lit(" Legende")))))
    per_faculty = F.flatten(F.transform("detected_faculties", lambda f: F.array(F.concat_ws(" ", F.lit("Studium"), f), F.concat_ws(" ", F.lit("Kontakt"), f))))
    parts = [
        F.array(F.coalesce(F.col(query), F.lit(""))),
        F.when(has("definition"), per_term).otherwise(none),
        F.when(has("exam_registration"), add("Prüfungsanmeldung Campusmanagement", "Prüfungen und Studium")).when(has("workflow"), add("Online-Anträge und -Bewerbungen", "Bewerbungsportal")).otherwise(none),
        F.when(has("contact"), add("Kontakt Studierendenservice", "Studienberatung Sprechstunden", "Ansprechpersonen")).otherwise(none),
        F.when(has("person_lookup"), F.array(F.array_join(person_terms(F.col(query)), " "), F.concat_ws(" ", F.array_join(person_terms(F.col(query)), " "), F.lit("Kontakt")))).otherwise(none),
        per_faculty,
    ]
    return df.withColumn("variants", F.slice(dedupe(F.concat(*parts)), 1, most))


def effective_faculty(explicit: Column, detected: Column) -> Column:
    """The faculty stated, else the only one detected, else null."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(F.size(detected) == 1, F.get(detected, F.lit(0))))


def time_sensitive(query: Column) -> Column:
    return T.contains_any(F.lower(query), TIME)


def refusal(answer: Column) -> Column:
    return T.contains_any(F.lower(answer), REFUSALS)


def needs_planner(df: DataFrame) -> Column:
    """Whether an assessed question should go through the planner: broad, or short without terms, and no person."""
    return ~F.array_contains("intents", "person_lookup") & (F.col("broad") | (F.col("too_short") & (F.size("retrieval_terms") == 0)) | (F.size("intents") > 1))
