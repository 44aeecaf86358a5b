"""Whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Cut whitespace, Unicode blanks included, from both ends; null stays null.

    `btrim` with a character list only looks at the ends of the text; a pattern would walk all of it.
    """
    return F.btrim(c, F.lit(WHITESPACE))
