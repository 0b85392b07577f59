"""Normalisation of free text, on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonym groups (longest variant first), prefixes and town parts.
SYNONYMS = [
    ("hemdklunker", "hemdglunker"), ("hemdglunki", "hemdglunker"), ("hendglunki", "hemdglunker"),
    ("fasnacht", "fastnacht"), ("fasching", "fastnacht"), ("karneval", "fastnacht"),
    ("fasnets", "fastnacht"), ("fasent", "fastnacht"), ("fasend", "fastnacht"), ("fasnet", "fastnacht"),
]
DASH_PREFIXES = ["Nordwiler Narrenfahrplan", "Wahlkampfstand Bündnis 90/Die Grünen", "Kommunales Kino", "Kolping Kids", "Fasnet im Ladhof", "Narrenzunft Bergteufel"]
COLON_PREFIXES = ["Vortrag", "Bildervortrag", "Kochworkshop", "FreiTagZeit", "Jungentreff", "Textil-Tag", "SPD-Veranstaltung", "Theaterabend", "Kinderprogramm", "SkF Waldkirch", "Waldkircher Klimagespräch"]
GENERIC_PREFIXES = ["Tag der offenen Tür"]
DASHES = [" - ", " -- ", " – ", " — "]
CITY_PARTS = {
    "nordweil": "kenzingen", "hecklingen": "kenzingen", "bombach": "kenzingen",
    "mundingen": "emmendingen", "kollmarsreute": "emmendingen", "wasser": "emmendingen", "windenreute": "emmendingen", "maleck": "emmendingen",
    "kollnau": "waldkirch", "buchholz": "waldkirch", "suggental": "waldkirch",
    "waltershofen": "freiburg im breisgau", "opfingen": "freiburg im breisgau", "tiengen": "freiburg im breisgau", "munzingen": "freiburg im breisgau", "lehen": "freiburg im breisgau",
    "bleibach": "gutach im breisgau", "oberhausen": "rheinhausen", "niederhausen": "rheinhausen",
}
#: A base letter and the combining mark that makes it an umlaut.
DECOMPOSED = [("ä", "ä"), ("ö", "ö"), ("ü", "ü")]


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column, synonyms: list[tuple[str, str]] | None = None) -> Column:
    """Lower case, umlauts spelt out, blanks collapsed, synonyms, no punctuation but hyphens; null gives ''."""
    low = replaced(F.lower(F.coalesce(text, F.lit(""))), [*DECOMPOSED, ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")])
    low = stripped(F.regexp_replace(low, r"(?U)\s+", " "))
    low = replaced(low, synonyms or [])
    return stripped(F.regexp_replace(low, r"[\"'!?,.:;()\[\]{}]", ""))


def normalize_city(city: Column, parts: dict[str, str] | None = None) -> Column:
    """Normalised town name, town parts mapped to their town."""
    name = normalize_text(city)
    if not parts:
        return name
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), name), name)


def strip_prefixes(title: Column, dash: list[str] = DASH_PREFIXES, colon: list[str] = COLON_PREFIXES, generic: list[str] = GENERIC_PREFIXES) -> Column:
    """The title without its first matching prefix; one prefix at most, case ignored."""
    patterns = [p + d for p in dash for d in DASHES] + [p + ": " for p in colon] + [p + d for p in generic for d in DASHES]
    low = F.lower(title)
    chain = title
    for pattern in reversed(patterns):
        chain = F.when(F.startswith(low, F.lit(pattern.lower())), stripped(F.substring(title, len(pattern) + 1, 1_000_000))).otherwise(chain)
    return chain


def normalize_title(title: Column) -> Column:
    return normalize_text(strip_prefixes(title), SYNONYMS)


def casefolded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
