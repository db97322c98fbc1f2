"""Numbers: clamps, scaling, rounding, ratios and compound rates, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import col


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def scaled(x: Column | str, low: float, high: float) -> Column:
    """0 at low, 1 at high, cut to that range."""
    return clamp((col(x) - low) / (high - low), 0.0, 1.0)


def inverse_scaled(x: Column | str, low: float, high: float) -> Column:
    return F.lit(1.0) - scaled(x, low, high)


def half_up(x: Column | str, places: int = 0) -> Column:
    """Halves go up, also below zero."""
    return F.floor(col(x) * 10**places + 0.5) / 10**places


def rounded(x: Column | str, places: int) -> Column:
    """The product with a power of ten rounded to a whole number, halves away from zero, and divided again; round() itself goes by the shortest decimal text of a double instead."""
    return F.round(col(x).cast("double") * float(10**places), 0) / float(10**places)


def to_fixed(x: Column | str, places: int) -> Column:
    """Rounded by the exact binary value of a double, exact halves away from zero: 1.005 is below its half and goes down."""
    value = F.abs(col(x).cast("double"))
    halves = 2.0 * 10**places
    # Two parts of at most 27 bits, so that their products with halves are exact.
    high = value * 134217729.0 - (value * 134217729.0 - value)
    k = F.rint(value * halves)
    below = (high * halves - k) + (value - high) * halves < 0
    n = F.when((k % 2 == 1) & ~below, (k + 1) / 2).otherwise(F.floor(k / 2))
    return F.signum(col(x).cast("double")) * n / float(10**places)


def rate(x: Column | str) -> Column:
    """A rate over 1 is a percentage."""
    return F.when(col(x) > 1, col(x) / 100).otherwise(col(x))


def ratio(part: Column | str, whole: Column | str, places: int = 4) -> Column:
    """part / whole, 0 if whole is not positive."""
    return F.when(col(whole) > 0, F.round(col(part) / col(whole), places)).otherwise(F.lit(0.0))


def known_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, null if either is 0 or null."""
    return F.nullif(col(part), F.lit(0)) / F.nullif(col(whole), F.lit(0))


def product(x: Column | str) -> Column:
    """Aggregate: the product of a group's values; 1 for none. Zeros are allowed, so not a sum of logarithms."""
    return F.aggregate(F.array_sort(F.collect_list(col(x).cast("double"))), F.lit(1.0), lambda a, b: a * b)


def compound(x: Column | str) -> Column:
    """Aggregate: growth over a group's rates."""
    return product(col(x).cast("double") + 1) - 1


def annual_from_daily(x: Column | str, days: int = 252) -> Column:
    return F.pow(col(x).cast("double") + 1, days) - 1


def correction_rate(inflation: Column | str, base: Column | str, margin: float = 0.02, default: float = 0.12) -> Column:
    """The lower of inflation plus a margin and the base rate; what is known if one is null, else the default."""
    real = col(inflation) + margin
    return F.coalesce(F.least(real, col(base)), real, F.lit(default))


def reliability(paid: Column | str, due: Column | str, special: Column) -> Column:
    """68, or 45 under the special regime, plus up to 25 for what was paid of what was due, within 5 and 95."""
    share = F.least(F.coalesce(F.try_divide(col(paid).cast("double"), col(due).cast("double")), F.lit(0.0)), F.lit(1.0))
    return clamp(half_up(F.when(special, 45.0).otherwise(68.0) + 25 * share), 5.0, 95.0)


def at_least_one(x: Column | str) -> Column:
    """A count of which there is at least one: null and 0 are 1."""
    return F.greatest(col(x).cast("long"), F.lit(1).cast("long"))
