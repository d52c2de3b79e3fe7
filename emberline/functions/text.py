"""Text functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditional import as_col

MISSING_TEXT = "NA"
KEY_SEPARATOR = "__"
MAX_LOOKUP = 1000


def squish(c: Column | str) -> Column:
    """Trim and reduce inner whitespace to single blanks."""
    return F.trim(F.regexp_replace(as_col(c), r"\s+", " "))


def lower(c: Column | str) -> Column:
    return F.lower(as_col(c))


def text_matches(c: Column | str, regex: str) -> Column:
    return as_col(c).rlike(regex)


def number_text(c: Column | str) -> Column:
    """Shortest decimal text of a number: no trailing zeros, no bare point."""
    text = as_col(c).cast("decimal(28,12)").cast("string")
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def n_decimals(c: Column | str) -> Column:
    """Digits after the decimal point as the number would be written; NULL gives 0."""
    # The decimal text always has a point and twelve digits after it.
    fraction = F.substring_index(as_col(c).cast("decimal(28,12)").cast("string"), ".", -1)
    return F.coalesce(F.length(F.rtrim(fraction, F.lit("0"))), F.lit(0)).cast("int")


def paste_key(*cols: Column | str, sep: str = KEY_SEPARATOR) -> Column:
    """Composite text key in which a missing part is written out, not skipped."""
    parts = [F.coalesce(as_col(c).cast("string"), F.lit(MISSING_TEXT)) for c in cols]
    return F.concat_ws(sep, *parts)


def safe_num(c: Column | str) -> Column:
    """Text to number, NULL where the text is not a number.

    The guard comes first because a plain cast also takes suffixes such as 12d.
    """
    text = F.trim(as_col(c))
    decimal = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    hexadecimal = text.rlike(r"^0[xX][0-9a-fA-F]{1,15}$")
    return F.when(decimal, text.try_cast("double")).when(
        hexadecimal, F.conv(F.substring(text, 3, 15), 16, 10).try_cast("double")
    )


def label(number: Column | str, digits: int, suffix: str) -> Column:
    """Rounded number followed by a unit, for use as a printed label."""
    return F.concat(number_text(F.bround(as_col(number), digits)), F.lit(suffix))


def lookup(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Display name of an id from a short fixed mapping; unknown ids give NULL."""
    if not 0 < len(mapping) <= MAX_LOOKUP:
        raise ValueError(f"lookup takes 1 to {MAX_LOOKUP} entries; join a table instead")
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), as_col(c).cast("string"))
