"""Text expressions shared by profiling and acceptance.  ASCII word classes mean the same in every SQL engine."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9']+"


def words(c: Column, pattern: str = WORD) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs, joined by a blank."""
    return F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


def opening(tokens: Column, n: int = 3) -> Column:
    """The first ``n`` words, or null where there are fewer."""
    return F.when(F.size(tokens) >= n, F.array_join(F.slice(tokens, 1, n), " "))


def sentences(c: Column) -> Column:
    """Split behind end marks, trimmed and lower-cased."""
    return F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.lower(F.trim(s)))


def folded(c: Column) -> Column:
    """Lower case with every run of other characters than letters, digits and underscore as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))


def collapsed(c: Column) -> Column:
    """Key under which generated values count as equal: lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def stripped(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def java_pattern(pattern: str) -> str:
    """A Python regular expression as Java reads it; what Java cannot express is refused.

    Classes like ``\\w`` are Unicode's in Python, so they are asked to be in Java.
    """
    if re.search(r"(?<!\\)\(\?\(", pattern):
        raise ValueError(f"pattern {pattern!r}: conditional groups are not supported")
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', 'U')}>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    return "(?U)" + out
