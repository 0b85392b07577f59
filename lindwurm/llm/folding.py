"""Folding of hand-written text to comparable letters, on the JVM side."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# UTF-8 read as Latin-1, entities, umlauts and look-alike marks.
MOJIBAKE = [("Ã¤", "ä"), ("Ã¶", "ö"), ("Ã¼", "ü"), ("ÃŸ", "ß"), ("Ã\u009f", "ß"), ("Ã„", "Ä"), ("Ã\u0084", "Ä"), ("Ã–", "Ö"), ("Ã\u0096", "Ö"), ("Ãœ", "Ü"), ("Ã\u009c", "Ü"), ("Ã©", "é"), ("â€“", "–"), ("â€ž", "„"), ("â€œ", "“"), ("â€¦", "…"), ("Â ", " "), ("â\u0080\u0093", "–"), ("â\u0080\u009e", "„"), ("â\u0080\u009c", "“"), ("â\u0080\u00a6", "…"), ("&amp;", "&"), ("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&szlig;", "ß"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü")]
ACCENTED, PLAIN = "áàâãåéèêëíìîïóòôõúùûýçñ", "aaaaaeeeeiiiioooouuuycn"


def repaired(text: Column) -> Column:
    """Text with damaged encodings and entities mended."""
    whole = text
    for bad, good in MOJIBAKE:
        whole = F.replace(whole, F.lit(bad), F.lit(good))
    return F.when(F.regexp_like(text, F.lit("[ÃÂâ&]")), whole).otherwise(text)


def folded(text: Column) -> Column:
    """Lower case, decomposed umlauts joined, ä ö ü ß spelt out, accents dropped."""
    low = F.lower(repaired(text))
    joined = low
    for letter, umlaut in (("ä", "ä"), ("ö", "ö"), ("ü", "ü")):
        joined = F.replace(joined, F.lit(letter), F.lit(umlaut))
    low = F.when(low.contains("̈"), joined).otherwise(low)
    low = F.translate(low, ACCENTED, PLAIN)
    for mark, letters in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        low = F.replace(low, F.lit(mark), F.lit(letters))
    return low


_ACCENTS, _PLAIN = re.compile(f"[{ACCENTED}]"), str.maketrans(ACCENTED, PLAIN)


def folded_text(text: str) -> str:
    """What ``folded`` makes of a text, for the workers."""
    if "Ã" in text or "Â" in text or "â" in text or "&" in text:
        for bad, good in MOJIBAKE:
            text = text.replace(bad, good)
    text = text.lower()
    if text.isascii():
        return text
    if "\u0308" in text:
        text = unicodedata.normalize("NFC", text)
    for mark, letters in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = text.replace(mark, letters)
    return text.translate(_PLAIN) if _ACCENTS.search(text) else text


def digits_to_letters(text: Column) -> Column:
    """0 and 1 inside words read as the letters they look like."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=[a-z])0|0(?=[a-z])", "o"), r"(?<=[a-z])1|1(?=[a-z]{2})", "l")


def squeezed(text: Column) -> Column:
    """White space of any kind as single blanks, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\u200b\ufeff]+", " "))


def zip5(text: Column) -> Column:
    """The five digits of a postcode, or an empty string."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    return F.when(F.length(digits) == 5, digits).otherwise("")


def one_row(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the least by the given columns and then by all others, so the choice is the same on every run."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])
