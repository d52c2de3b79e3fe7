"""Date functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conditional import as_col, case_when, if_else

# Separators are made uniform and month names cut to three letters first.
ORDERS = {
    "mdy": ("M-d-yyyy", "MMM-d-yyyy", "M-d-yy", "MMM-d-yy", "MMddyyyy"),
    "dmy": ("d-M-yyyy", "d-MMM-yyyy", "d-M-yy", "d-MMM-yy", "ddMMyyyy"),
    "ymd": ("yyyy-M-d", "yyyy-MMM-d", "yyyyMMdd"),
}
# Two-digit years from here on belong to the last century.
LAST_CENTURY = 69
DEFAULT_ORDER = ("mdy", "dmy", "ymd")


_DAY, _MONTH = r"0*([12][0-9]|3[01]|[1-9])", r"0*(1[0-2]|[1-9])"
# What a part of a pattern can read, for all that stands in uniform text.
_PARTS = {"M": _MONTH, "d": _DAY, "MMM": r"\p{L}+", "yyyy": "[0-9]{4}", "yy": "[0-9]{2}"}


def _shape(pattern: str) -> str:
    """A regular expression that all texts meet which ``pattern`` can parse. Failing to parse costs far more than not trying."""
    if "-" not in pattern:
        return "^-?[0-9]{4,}-?[0-9]{4,}$"
    shape = "-".join(_PARTS[p] for p in pattern.split("-"))
    # A separator before the year makes it negative.
    return f"^-?{shape.replace('{4}', '{4,}', 1)}$" if pattern.startswith("yyyy") else f"^{shape}$"


def _uniform(c: Column) -> Column:
    uniform = F.regexp_replace(F.trim(c), r"[^0-9\p{L}]+", "-")
    # "12th" is 12, "January" is Jan.
    named = F.regexp_replace(uniform, r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    # Case makes no difference to the parser.
    named = F.regexp_replace(named, r"(\p{L}{3})\p{L}+", "$1")
    return F.when(uniform.rlike(r"\p{L}"), named).otherwise(uniform)


def _attempt(uniform: Column, order: str) -> Column:
    def tried(pattern: str) -> Column:
        day = F.try_to_timestamp(uniform, F.lit(pattern)).cast("date")
        if "yyyy" not in pattern:
            day = F.when(F.year(day) % 100 >= LAST_CENTURY, F.add_months(day, -1200)).otherwise(day)
        return F.when(uniform.rlike(_shape(pattern)), day)

    return F.coalesce(*[tried(p) for p in ORDERS[order]])


def _once(c: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` mentions it."""
    return F.transform(F.array(c), fn)[0]


def parse_date(c: Column | str, order: Sequence[str] = DEFAULT_ORDER) -> Column:
    """Date from mixed day/month/year text; the first order that fits wins."""
    return _once(_uniform(as_col(c)), lambda u: F.coalesce(*[_attempt(u, o) for o in order]))


def trained_order(df: DataFrame, c: Column | str) -> tuple[str, ...]:
    """Orders ranked by how many values of the column each one parses."""
    uniform = _uniform(as_col(c))

    def counted(order: str) -> Column:
        return F.count(_once(uniform, lambda u: _attempt(u, order))).alias(order)

    hits = df.agg(*[counted(o) for o in DEFAULT_ORDER]).first()
    return tuple(sorted(DEFAULT_ORDER, key=lambda o: -hits[o]))


def to_day(c: Column | str) -> Column:
    """Calendar day of an instant (the session runs in UTC)."""
    return as_col(c).cast("date")


def days_since(survey: Column | str, burn: Column | str, eligible: Column) -> Column:
    """Signed days from burn to survey, for eligible rows with both dates."""
    return F.when(eligible, F.date_diff(as_col(survey), as_col(burn)))


def clamp_days(days: Column | str, eligible: Column) -> Column:
    """Negative day counts of eligible rows become 0."""
    days = as_col(days)
    return if_else(eligible & days.isNotNull() & (days < 0), F.lit(0), days)


def timing_class(raw_days: Column | str, eligible: Column) -> Column:
    """Where the survey falls relative to the burn day."""
    raw = as_col(raw_days)
    return case_when(
        [
            (~eligible, "Control_or_before"),
            (raw < 0, "Near_fire_date"),
            (raw == 0, "DayOf"),
            (raw > 0, "After"),
        ]
    )
