"""Exact decimal columns: two-digit money, nearest-N rounding, line amounts.

Doubles are taken by their shortest decimal text, as Spark's own cast does; all rounding is half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import WIDE

#: Multiples to which a total may be rounded, with the factor that turns a division into an exact product.
_STEPS = {"nearest_1": ("1", 1), "nearest_5": ("0.2", 5), "nearest_10": ("0.1", 10)}


def dec(text: str, precision: int, scale: int) -> Column:
    return F.lit(text).cast(f"decimal({precision},{scale})")


def to_money(value: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(value.cast("decimal(38,12)"), 2).cast(WIDE)


def round_to_nearest(value: Column, mode: Column) -> Column:
    """Money rounded to a multiple of 1, 5 or 10; an unknown mode is an error."""
    out = F.when(mode == "none", to_money(value))
    for name, (factor, step) in _STEPS.items():
        out = out.when(mode == name, (F.round(value.cast(WIDE) * dec(factor, 2, 1), 0) * step).cast(WIDE))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown rounding mode: "), F.coalesce(mode, F.lit("null")))).cast(WIDE))


def line_amount(quantity: Column, rate: Column) -> Column:
    return F.round(quantity.cast("decimal(12,3)") * rate.cast("decimal(18,6)"), 2).cast(WIDE)


def tax_amount(amount: Column, gst: Column) -> Column:
    """Tax on an already rounded amount."""
    return F.round(amount.cast(WIDE) * gst.cast("decimal(5,2)") * dec("0.01", 2, 2), 2).cast(WIDE)


def marked_up(rate: Column, percent: Column) -> Column:
    return F.round(rate.cast("decimal(14,2)") * (F.lit(1) + percent.cast("decimal(6,2)") * dec("0.01", 2, 2)), 2).cast(WIDE)


def quotient(a: Column, b: Column) -> Column:
    """Division with twenty decimals; null where the divisor is zero or a number has more than twelve digits before its point."""
    return F.try_divide(a.try_cast("decimal(24,12)"), b.try_cast("decimal(18,6)"))


def _factor(gst: Column) -> Column:
    return F.lit(1) + gst.try_cast("decimal(5,2)") * dec("0.01", 2, 2)


def including_gst(rate: Column, gst: Column) -> Column:
    return (rate.try_cast("decimal(18,6)") * _factor(gst)).try_cast("decimal(24,12)")


def excluding_gst(rate: Column, gst: Column) -> Column:
    return quotient(rate, _factor(gst))
