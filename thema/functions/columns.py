"""Column expressions: tokens, vectors and transform functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TINY


def words(text: Column | str) -> Column:
    """The lower-cased runs of letters and digits of any script, and underscores, of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def elements(line: Column | str) -> Column:
    """Non-empty fields of a line between blanks, tabs and carriage returns."""
    return F.filter(F.split(line, "[ \t\r]"), lambda x: x != "")


def underscored(text: Column | str) -> Column:
    """Blanks and tabs as underscores."""
    return F.regexp_replace(text, "[ \t]", "_")


def token_of(element: Column) -> Column:
    """What stands before an element's first colon."""
    return F.substring_index(element, ":", 1)


def weight_of(element: Column) -> Column:
    """The number behind an element's first colon, 1 without a colon; an error if it isn't a number
    or either part is empty."""
    at = F.instr(element, ":")
    text = F.substring(element, at + 1, F.length(element))
    number = text.try_cast("double")
    bad = (at == 1) | ((at > 0) & number.isNull())
    return F.when(bad, F.raise_error(F.concat(F.lit("bad token weight: "), element)).cast("double")).otherwise(F.when(at > 0, number).otherwise(1.0))


def transformed(x: Column, kind: str = "constant", a: float = 1.0, n: float = 1.0) -> Column:
    """constant: 1; logarithm: ln x; polynomial: a * x ** n; the last two 0 where x isn't positive."""
    if kind == "constant":
        return F.lit(1.0)
    if kind == "logarithm":
        return F.when(x > 0, F.log(x)).otherwise(0.0)
    if kind == "polynomial":
        return F.when(x > 0, a * F.pow(x, F.lit(n))).otherwise(0.0)
    raise ValueError(f"unknown transform {kind}")


def flushed(x: Column) -> Column:
    """Values below 1e-16 as zero."""
    return F.when(x < TINY, 0.0).otherwise(x)


def sign_or_minus(x: Column) -> Column:
    """1 for a positive number, else -1."""
    return F.when(x > 0, 1.0).otherwise(-1.0)
