"""Unicode-aware string expressions that keep the whole pipeline on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text
# (tab to carriage return, the four separators, space, NEL, NBSP and the Unicode spaces).
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: The same set inside a regular-expression character class.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Line ends: CRLF counts once; the other marks each end a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """``text`` without white space at both ends; NULL stays NULL."""
    return F.trim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, ends are stripped."""
    return F.trim(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def lines(text: Column) -> Column:
    """The lines of ``text`` as an array, without an empty last line; '' gives an empty array."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
