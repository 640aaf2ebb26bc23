"""Language labels as sites write them, brought to two-letter codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl")

# Three-letter codes and names of the seven languages, in English and in the language itself.
NAMES = {
    "en": "eng english",
    "de": "deu ger german deutsch",
    "fr": "fra fre french français francais",
    "es": "spa spanish español espanol castellano",
    "it": "ita italian italiano",
    "pt": "por portuguese português portugues",
    "nl": "nld dut dutch nederlands",
}


def label_code(lang: Column) -> Column:
    """``en_GB``, ``English``, ``eng`` and the like as ``en``; null for blanks, placeholders and unknown labels."""
    head = F.lower(F.regexp_extract(F.trim(lang), r"^([\p{L}]+)(?:[-_][\p{L}0-9]{2,8})*$", 1))
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(head.isin(code, *names.split()), F.lit(code)).otherwise(out)
    return out
