"""Exact ratios: integer arithmetic, rounded half up, so that results do not depend on floating point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _units(numerator: Column, denominator: Column, places: int) -> Column:
    """``numerator / denominator`` in units of ``10**-places``, rounded half up, for non-negative integers."""
    scaled = F.lit(2 * 10**places) * numerator.cast("long") + denominator.cast("long")
    return F.call_function("div", scaled, F.lit(2) * denominator.cast("long"))


def ratio(numerator: Column, denominator: Column, places: int) -> Column:
    return _units(numerator, denominator, places) / F.lit(float(10**places))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return ratio(F.lit(100) * part.cast("long"), whole, places)


def percent_text(part: Column, whole: Column, places: int = 2) -> Column:
    """A percentage as text with a fixed number of decimals; zero when there is nothing to divide by."""
    units = F.when(whole > 0, _units(F.lit(100) * part.cast("long"), whole, places)).otherwise(F.lit(0))
    scale = F.lit(10**places)
    return F.concat_ws(
        ".",
        F.call_function("div", units, scale).cast("string"),
        F.lpad((units % scale).cast("string"), places, "0"),
    )
