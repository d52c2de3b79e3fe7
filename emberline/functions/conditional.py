"""Conditions with the three-valued logic the survey rules expect."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice in which a NULL condition gives NULL, not the second branch."""
    return F.when(cond, as_value(yes)).when(~cond, as_value(no))


def case_when(branches: Sequence[tuple[Column, object]], default=None) -> Column:
    """First true branch wins; a NULL condition counts as false."""
    if not branches:
        raise ValueError("case_when needs at least one branch")
    (cond, value), *rest = branches
    out = F.when(cond, as_value(value))
    for cond, value in rest:
        out = out.when(cond, as_value(value))
    return out if default is None else out.otherwise(as_value(default))


def is_in(c: Column | str, values: Iterable) -> Column:
    """Membership that is FALSE, never NULL, for a NULL input."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def drop_sentinel(c: Column | str, sentinel) -> Column:
    """NULL in place of a code that means "no value"."""
    return F.nullif(as_col(c), F.lit(sentinel))


def limit_levels(c: Column | str, levels: Sequence[str]) -> Column:
    """Keep the listed levels, NULL for every other value."""
    c = as_col(c)
    return F.when(c.isin(list(levels)), c)


def positive_or_one(c: Column | str) -> Column:
    """Effort values: NULL, zero and negative become 1."""
    c = as_col(c)
    return F.when(c.isNull() | (c <= 0), F.lit(1.0)).otherwise(c)
