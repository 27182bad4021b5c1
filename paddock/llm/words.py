"""Words and shingles as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What isn't a word: anything but letters and digits.
NO_WORD = r"[^\p{L}\p{N}]+"


def normalised(text: Column) -> Column:
    """Lower-cased words of letters and digits, one space between them; a null text is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_WORD, " "))

