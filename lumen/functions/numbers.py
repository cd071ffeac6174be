"""Rounding of binary floating-point values as Python does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumen.functions.text import _col

#: Digits that stay exact: a 56-bit mantissa times ten to them fits 38 decimal digits.
MAX_DIGITS = 18


def python_round(c, digits: int = 0) -> Column:
    """``round(x, digits)`` of the binary value: to the nearer decimal, exact ties to the even one.

    Spark rounds the shortest decimal text of a double half up (2.675 to 2.68),
    although the stored value lies below the tie (2.67). Here the value is taken
    apart into ``m / 2^k`` with integers, so ``m * 10^digits`` is divided by
    ``2^k`` exactly and the remainder decides. Null, NaN and infinities stay.
    """
    if not 0 <= digits <= MAX_DIGITS:
        raise ValueError(f"digits must lie between 0 and {MAX_DIGITS}")
    x = _col(c).cast("double")
    power = float(10 ** digits)
    # from 2^53 steps on, neighbouring doubles lie further apart than the decimals: the value stays
    usual = x.isNotNull() & ~F.isnan(x) & (F.abs(x) * power < 2.0 ** 53) & (F.abs(x) >= 2.0 ** -64)
    a = F.when(usual, F.abs(x)).otherwise(F.lit(1.0))
    # two bits more than the mantissa, as log2 may be off by one at a power of two
    k = F.lit(54) - F.floor(F.log2(a)).cast("int")
    half = F.least(F.greatest(k, F.lit(0)), F.lit(60))
    rest = F.greatest(k, F.lit(0)) - half
    big, one = "decimal(38,0)", F.lit(1).cast("long")
    m = (a * F.pow(F.lit(2.0), k.cast("double"))).cast("long").cast(big) * F.lit(10 ** digits).cast(big)
    unit = F.call_function("shiftleft", one, half).cast(big) * F.call_function("shiftleft", one, rest).cast(big)
    low = F.call_function("div", m, unit)
    twice = (m % unit) * F.lit(2).cast(big)
    up = (twice > unit) | ((twice == unit) & (low % 2 == 1))
    whole = (low + F.when(up, 1).otherwise(0)).cast("double") / power
    return (F.when(usual, F.when(x < 0, -whole).otherwise(whole))
            .when(F.abs(x) < 1.0, x * 0.0)  # far below any tie
            .otherwise(x))
