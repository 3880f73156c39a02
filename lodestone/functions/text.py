"""Column expressions on text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as an apostrophe, as a word, and as outer white space.
APOSTROPHES = "['’]"
WORD = r"[\p{L}\p{N}]+"
OUTER_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def words(text: Column) -> Column:
    """The words of a text in order: lower case, apostrophes dropped, longest runs of letters and digits. Null for null, empty array for a text without a word."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, APOSTROPHES, "")), F.lit(WORD), 0)


def key_rule(key: Column) -> Column:
    """A key as it is compared: outer white space and letter case ignored; numbers stay numbers."""
    return F.lower(F.regexp_replace(key.cast("string"), OUTER_SPACE, ""))


def bag_of_words(text: Column) -> Column:
    """The words of a text in sorted order, each as often as it stands there, as one string; null where there is none."""
    return F.nullif(F.array_join(F.array_sort(words(text)), " "), F.lit(""))
