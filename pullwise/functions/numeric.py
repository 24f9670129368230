"""Ratios, parsed numbers and the Wilson interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pullwise import dims


def ratio(numerator: Column, denominator: Column, places: int = 3) -> Column:
    """Rounded quotient, null where the denominator is not positive."""
    return F.round(F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")), places)


def parse_number(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def unparsed_number(value: Column) -> Column:
    return value.isNotNull() & parse_number(value).isNull()


def wilson(k: Column, n: Column, z: float = dims.Z_95) -> tuple[Column, Column]:
    """Score interval of k successes in n trials; no trials give (0, 1); k outside 0..n is an error."""
    kd, nd = k.cast("double"), n.cast("double")
    p = kd / nd
    denom = 1 + z * z / nd
    centre = (p + z * z / (2 * nd)) / denom
    half = z * F.sqrt(p * (1 - p) / nd + z * z / (4 * nd * nd)) / denom
    bad = F.raise_error(F.concat(F.lit("k="), k.cast("string"), F.lit(" is not between 0 and n="), n.cast("string")))

    def side(value: Column, empty: float) -> Column:
        return (F.when(n <= 0, F.lit(empty)).when((k < 0) | (k > n), bad.cast("double")).otherwise(value))

    return side(F.greatest(F.lit(0.0), centre - half), 0.0), side(F.least(F.lit(1.0), centre + half), 1.0)


def interval_text(low: Column, high: Column) -> Column:
    return F.concat(F.format_number(low, 2), F.lit("–"), F.format_number(high, 2))
