"""Text scalars as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and the underscore in any script; marks are not word characters.
WORD_CLASS = r"[\p{L}\p{N}_]"


def terms(text: Column, min_chars: int = 2) -> Column:
    """Runs of ``min_chars`` or more word characters of the lower-cased text; null texts have none."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(" + WORD_CLASS + "{" + str(min_chars) + ",})"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def strip_ws(text: Column) -> Column:
    """Unicode white space removed at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ws_tokens(text: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(ws_tokens(text))
