"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """``x`` with a fixed count of decimals, rounded from its exact binary value.

    ``format_string`` rounds the shortest decimal spelling instead and so differs
    from printf-style output on values such as 0.00015. Here the product
    ``x * 10^digits`` is taken together with its rounding error (Veltkamp split),
    which decides on which side of the half the exact value lies; an exact half
    goes to the even digit. Good for magnitudes below 2^52 / 10^digits.
    """
    unit = 10**digits
    a = F.abs(x.cast("double"))
    high = a * F.lit(134217729.0) - (a * F.lit(134217729.0) - a)
    scale = F.lit(float(unit))
    product = a * scale
    error = (high * scale - product) + (a - high) * scale
    whole = F.floor(product)
    side = (product - whole - F.lit(0.5)) + error
    n = whole + F.when((side > 0) | ((side == 0) & (whole % 2 == 1)), 1).otherwise(0)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    units = F.floor(n / F.lit(unit)).cast("string")
    if digits == 0:
        return F.concat(sign, units)
    return F.concat(sign, units, F.lit("."), F.lpad((n % F.lit(unit)).cast("string"), digits, "0"))
