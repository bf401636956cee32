"""Words of a text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: the longest run of Unicode letters and digits, digits being numbers of every kind (decimal, letter-like and others such as ² and ¼).
WORD = r"[\p{L}\p{N}]+"
#: A unit of size: a word, or one other character that is not white space.
UNIT = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\p{IsWhite_Space}]"


def words(text: Column) -> Column:
    """The words of a text in lower case, as array<string>; null for a null text, empty for one without words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def size(text: Column) -> Column:
    """Words plus other characters that are not white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(UNIT)), F.lit(0)).cast("bigint")
