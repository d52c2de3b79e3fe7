"""Numeric functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditional import as_col

# The 0.975 quantile of Student's t for 1 to 30 degrees of freedom
# (published tables, 4 decimals or better).
T975 = (
    12.706204736432095, 4.302652729911275, 3.182446305284263, 2.7764451051977987,
    2.570581835636314, 2.4469118487916806, 2.3646242510102993, 2.3060041350333704,
    2.2621571627409915, 2.2281388519649385, 2.200985160082949, 2.178812829663418,
    2.1603686564610127, 2.1447866879169273, 2.131449545559323, 2.1199052992210112,
    2.1098155778331806, 2.10092204024096, 2.093024054408263, 2.0859634472658364,
    2.079613844727662, 2.0738730679040147, 2.0686576104190406, 2.0638985616280205,
    2.059538552753294, 2.055529438642871, 2.0518305164802833, 2.048407141795244,
    2.045229642132703, 2.042272456301238,
)
# Fixed value: the 0.975 quantile of the standard normal.
Z975 = 1.959963984540054
HECTARES_PER_KM2 = 100
M2_PER_HECTARE = 10000


def round_even(c: Column | str, n: int = 0) -> Column:
    """Round, ties to the even digit."""
    return F.bround(as_col(c), n)


def safe_log(c: Column | str) -> Column:
    """Natural logarithm; NULL where the argument is not positive."""
    c = as_col(c)
    return F.when(c > 0, F.ln(c))


def safe_log1p(c: Column | str) -> Column:
    """log(1 + x); NULL where x <= -1."""
    c = as_col(c)
    return F.when(c > -1, F.log1p(c))


def km2_to_ha(c: Column | str) -> Column:
    return as_col(c) * HECTARES_PER_KM2


def m2_to_ha(c: Column | str) -> Column:
    return as_col(c) / M2_PER_HECTARE


def is_whole(c: Column | str) -> Column:
    return as_col(c) % 1 == 0


def finite_or_null(c: Column | str) -> Column:
    """NULL in place of an infinity or a NaN."""
    c = as_col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def standardize(c: Column | str, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd, NULL where the spread is zero or unknown."""
    return F.try_divide(as_col(c) - mean, sd)


def t975(df: Column | str) -> Column:
    """0.975 quantile of Student's t: table up to 30 degrees of freedom, then
    the normal-quantile expansion (Abramowitz and Stegun 26.7.5)."""
    n = as_col(df).cast("double")
    z = Z975
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    tail = F.lit(z) + F.lit(g1) / n + F.lit(g2) / n**2 + F.lit(g3) / n**3 + F.lit(g4) / n**4
    table = F.element_at(F.array(*[F.lit(v) for v in T975]), n.cast("int"))
    return F.when((n >= 1) & (n <= len(T975)), table).when(n > len(T975), tail)
