"""Cleaning of text cells and safe access to awkward column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters trimmed from a cell, i.e. all Unicode white space plus the four
# ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def quoted(name: str) -> str:
    """A column name as SQL, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name."""
    return F.col(quoted(name))


def _trimmed(name: str, rest: str) -> Column:
    """Spaces trimmed; ``rest`` is for text that then still ends in something unusual.

    Trimming a list of characters costs several times as much as trimming spaces, so it is left to
    the few cells that need it: if the first and last character are printable ASCII, nothing but
    spaces could have been trimmed.
    """
    t = f"trim(string({quoted(name)}))"
    plain = f"{t} >= '!' AND {t} < '\x7f' AND substring({t}, -1, 1) BETWEEN '!' AND '~'"
    return F.expr(f"CASE WHEN {plain} THEN {t} ELSE {rest.format(t=t)} END")


def strip(name: str) -> Column:
    """Trimmed of any white space."""
    return _trimmed(name, f"btrim({{t}}, '{WHITESPACE}')")


def clean(name: str) -> Column:
    """Trimmed text, blank becomes NULL."""
    return _trimmed(name, f"nullif(btrim({{t}}, '{WHITESPACE}'), '')")


def lowered(name: str) -> Column:
    """P10 on data: cleaned text in lower case."""
    return F.lower(clean(name))


def to_tenths(c: Column) -> Column:
    """A value whose one-decimal rendering is the exact number rounded, halves to the even digit.

    ``format_string`` rounds the shortest decimal form half up, which differs when that form ends
    in a 5 at the second place.  There the sign of the exact remainder decides; both subtractions
    are exact because their operands are within a factor of two.
    """
    twentieths = F.round(c * 20)
    looks_tied = (c == twentieths / 20) & (twentieths % 2 != 0)
    remainder = (c * 16 - twentieths) + c * 4
    return (
        F.when(~looks_tied, c)
        .when(remainder < 0, (twentieths - 1) / 20)
        .when(remainder > 0, (twentieths + 1) / 20)
        .otherwise(F.bround(twentieths / 2) / 10)
    )


def percent_text(c: Column) -> Column:
    """One decimal and a percent sign, as the report tables print shares."""
    return F.format_string("%.1f%%", to_tenths(c))
