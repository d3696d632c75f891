"""Text helpers that follow Python's string rules inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """``str.strip()``."""
    return F.trim(col(c), F.lit(WHITESPACE))


def words(c: Column | str) -> Column:
    """``str.split()``: runs of non-white characters (Python also splits at \\x1c to \\x1f)."""
    return F.filter(F.split(col(c), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def preview(c: Column | str, n: int) -> Column:
    """First ``n`` characters (code points)."""
    return F.substring(col(c), 1, n)


def contains_any(c: Column, keywords: list[str]) -> Column:
    """True when any keyword is a substring."""
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | c.contains(keyword)
    return hit


def blank(c: Column | str) -> Column:
    return F.coalesce(trim_ws(c), F.lit("")) == ""
