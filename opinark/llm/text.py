"""Words and likeness as the training-data operators define them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a longest run of letters and digits, in lower case, after removing apostrophes.
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[^<>]*>")


#: For ASCII text, words in one pass: letters and digits in lower case, no apostrophes, all else a space.
_ASCII_WORDS = {c: (chr(c).lower() if chr(c).isalnum() else None if chr(c) == "'" else " ") for c in range(128)}


def words(text: str) -> list[str]:
    if text.isascii():
        return text.translate(_ASCII_WORDS).split()
    return WORD.findall(text.lower().replace("'", "").replace("’", ""))


def word_count(text: Column) -> Column:
    """Number of words of a text column; null counts none."""
    return F.coalesce(F.regexp_count(F.translate(text, "'’", ""), F.lit(r"[\p{L}\p{N}]+")), F.lit(0))
