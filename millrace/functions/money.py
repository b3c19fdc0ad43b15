"""Rounding that doesn't depend on how a binary fraction happens to fall."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(x: Column, places: int = 2) -> Column:
    """Half-up rounding of the decimal value (to 8 places) of a double, as a double."""
    return F.round(x.cast("decimal(28,8)"), places).cast("double")
