"""Shared column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = " \t\n\x0b\x0c\r"
#: Java regular expression of one white-space character of the word definition.
BLANK = r"[\x20\x09-\x0D]"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and pass it to ``body``.

    A lambda variable is bound to the value, so an expensive array is not computed again for each
    element of an inner loop, whatever projections the optimizer collapses.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that for pure ASCII and is far faster."""
    return F.when(F.length(s) == F.octet_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def words(s: Column) -> Column:
    """Array of the runs of non-blank characters; null or blank text: empty array."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), BLANK + "+"), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
