"""Lossy rounding of floats to a number of significant digits or bits, so that they compress better; by arithmetic on columns."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Code, require

MODES = ("bitgroom", "granular_bitround", "bitround")


def quantized(column: str | Column, mode: str, digits: int, double: bool = True, place: str | Column = "goff") -> Column:
    """`column` rounded by `mode`: `digits` significant decimals, or bits of the mantissa for "bitround".

    The rounding modes go to the nearest multiple of a power of two, halves to even. "bitgroom" clears the bits left out where
    `place` is even and sets them where it is odd, so the result depends on the element and not on how rows are dealt. Nulls,
    zeros, infinite values, and those so small that the bits left out are below the least normal number, stay.
    """
    bits = 52 if double else 23
    require(mode in MODES and 0 < digits <= (bits if mode == "bitround" else (15 if double else 7)), Code.EINVAL, "quantize")
    v = (F.col(column) if isinstance(column, str) else column).cast("double")
    size = F.abs(v)
    usable = v.isNotNull() & ~F.isnan(v) & (size > F.lit(1e-290 if double else 1e-30)) & (size < F.lit(float("inf")))
    safe = F.when(usable, size).otherwise(1.0)
    near = F.floor(F.log2(safe))
    power = near + F.when(safe >= F.pow(F.lit(2.0), near + 1), 1).when(safe < F.pow(F.lit(2.0), near), -1).otherwise(0)
    if mode == "granular_bitround":
        unit = F.floor(F.log10(safe)) + 1 - digits  # the last significant decimal place
        keep = F.least(F.greatest(F.ceil(power - unit * log2(10)), F.lit(0)), F.lit(bits))
    else:
        keep = F.lit(min(bits, digits if mode == "bitround" else ceil(digits * log2(10)) + 1))
    step = F.pow(F.lit(2.0), power - keep)
    if mode == "bitgroom":
        odd = F.pmod(F.col(place) if isinstance(place, str) else place, F.lit(2)) == 1
        low = F.floor(safe / step) * step
        out = F.signum(v) * F.when(odd & (keep < bits), low + (step - F.pow(F.lit(2.0), power - bits))).otherwise(low)
    else:
        out = F.rint(v / step) * step
    return F.when(usable, out).otherwise(v).cast("double" if double else "float")
