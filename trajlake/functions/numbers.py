"""Number rules that differ from Spark's defaults.

Spark orders NaN above every value and calls NaN equal to NaN; the rules here
treat NaN as failing every comparison, and rounding goes half up.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: a decimal number in text (no type suffixes, no NaN or Infinity words).
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(c: Column) -> Column:
    """True for a usable number; false for null, NaN and both infinities."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def above(c: Column, limit) -> Column:
    return (c > limit) & ~F.isnan(c)


def below(c: Column, limit) -> Column:
    return (c < limit) & ~F.isnan(c)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Round half toward +infinity; non-finite input passes through."""
    scale = float(10**digits)
    return F.when(finite(c), F.floor(c * scale + 0.5) / scale).otherwise(c)


def number_or_null(c: Column) -> Column:
    """Lenient coercion of text to a finite double; anything else is null."""
    text = F.trim(c.cast("string"))
    parsed = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    return F.when(finite(parsed), parsed)


def or_one(c: Column) -> Column:
    """Zero (and null, NaN) becomes 1: the guard before dividing by a range."""
    return F.when((c == 0) | c.isNull() | F.isnan(c), F.lit(1.0)).otherwise(c)


def log_slot(c: Column, per_octave: int = 4096) -> Column:
    """A coarse bucket that never decreases as ``c`` grows.

    Buckets are even on a log scale, so they split dense ranges of any size.
    """
    magnitude = F.floor(F.log2(F.abs(c)) * per_octave) + 10_000_000
    return (
        F.when(c == 0, F.lit(0))
        .when(c > 0, magnitude)
        .otherwise(-magnitude)
        .cast("long")
    )
