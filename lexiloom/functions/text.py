"""Text expressions.

Java and RE2 read ``\\s`` differently, so every class is written out. ``UNICODE_SPACE`` is the set of
characters Python calls white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_GAP = "[ \\t\\r\\n]+"
UNICODE_SPACE = "\\t-\\r\\x1c-\\x1f\\x85\\p{Z}"
NON_SPACE = f"[^{UNICODE_SPACE}]"
TRAILING_SPACE = f"[{UNICODE_SPACE}]+\\z"


def words(text: Column, gap: str = TOKEN_GAP) -> Column:
    """Tokens of a text: split on white space, empty strings dropped."""
    return F.array_remove(F.split(text, gap), "")


def is_blank(text: Column) -> Column:
    """Empty or white space only."""
    return ~text.rlike(NON_SPACE)


def is_heading_or_empty(text: Column) -> Column:
    """Empty text, or a heading line, which begins with a blank and an equals sign."""
    return (text == "") | text.startswith(" =")


def right_trim(text: Column) -> Column:
    """Drop trailing white space of every kind (``rtrim`` would drop blanks only)."""
    return F.regexp_replace(text, TRAILING_SPACE, "")


def md5_number(*parts: Column, digits: int = 8) -> Column:
    """The first hex digits of the md5 of the colon-joined parts, as a bigint.

    Depends on the values only, never on the plan or the partitions, so a lost task recomputes the same
    number and another engine can compute it too.
    """
    joined = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("bigint")


def fixed_pieces(word: Column, width: int) -> Column:
    """Cut a word into pieces of ``width`` characters: the default sub-word rule."""
    return F.regexp_extract_all(word, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
