"""Equal-width binning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A constant column gets a range of width one around its value."""
    flat = lo == hi
    return (F.when(flat, lo - F.lit(0.5)).otherwise(lo),
            F.when(flat, hi + F.lit(0.5)).otherwise(hi))


def equal_width(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin index 0..bins-1, NULL if missing; the last bin includes its upper edge."""
    lo, hi = edges(lo, hi)
    # least() skips NULL, so a missing value must be kept out of it.
    return F.when(x.isNotNull(), F.least(
        F.floor((x - lo) / (hi - lo) * F.lit(bins)).cast("int"), F.lit(bins - 1)))
