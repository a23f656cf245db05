"""Rounding and number-to-text expressions with correctly rounded results.

Spark's ``round`` and ``format_string`` round the shortest decimal form of a
double; reported scores here round its exact binary value, ties to even.  The
expressions below do that with plain double arithmetic, so they stay inside
generated code and never go through a text formatter.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves whose products with a small integer are exact.
_SPLITTER = 134217729.0  # 2**27 + 1
# Up to here x * scale keeps at least one fraction bit.
_EXACT_LIMIT = 2.0**51
# A whole number from here on.
_WHOLE = 2.0**53
# Larger doubles are split into two digits of this base.
_DIGIT = 2.0**60
_LARGEST = 2.0**115


def _half_even(x: Column, scale: int) -> Column:
    """Integer nearest to the exact product ``x * scale``, ties to even."""
    factor = F.lit(float(scale))
    product = x * factor
    low = F.floor(product)
    head = x * F.lit(_SPLITTER)
    high_half = head - (head - x)
    rounding_error = (high_half * factor - product) + (x - high_half) * factor
    side = F.signum(((product - low.cast("double")) - F.lit(0.5)) + rounding_error)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    steps = F.array(zero, F.pmod(low, F.lit(2).cast("bigint")), one)  # below, on, above the tie
    return low + F.element_at(steps, side.cast("int") + 2)


def _outside(x: Column, scale: int) -> Column:
    return F.abs(x) >= _EXACT_LIMIT / scale


def _exact_decimal(x: Column, digits: int) -> Column:
    """A non-negative double below 2**115, rounded to ``digits`` decimals, as an exact decimal.

    The whole part is split off first.  It has an even number of units, so the tie rule looks at
    the rest alone.
    """
    rest = F.when(x < _WHOLE, x - F.floor(x).cast("double")).otherwise(F.lit(0.0))
    units = _half_even(rest, 10**digits).cast("decimal(6,0)") * F.lit(Decimal(1).scaleb(-digits))
    high = F.floor(x / F.lit(_DIGIT))
    low = F.floor(x - high.cast("double") * F.lit(_DIGIT))
    whole = high.cast("decimal(19,0)") * F.lit(Decimal(2**60)) + low.cast("decimal(19,0)")
    return whole.cast(f"decimal({37 - digits},0)") + units


def round_exact(x: Column, digits: int = 3) -> Column:
    """Round a double to ``digits`` decimals, correctly rounded, ties to even."""
    scale = 10**digits
    rounded = _half_even(x, scale).cast("double") / F.lit(float(scale))
    large = _exact_decimal(F.abs(x), digits).cast("double") * F.signum(x)
    # from 2**53 on a double is whole
    return (
        F.when(F.isnan(x) | (F.abs(x) >= _WHOLE), x).when(_outside(x, scale), large).otherwise(rounded)
    )


def fixed_text(x: Column, digits: int = 2) -> Column:
    """Text with a fixed number of decimals and no thousands separator; null from 2**115 (4e34) on."""
    scale = 10**digits
    units = _half_even(F.abs(x), scale).cast("decimal(18,0)")
    small = (units * F.lit(Decimal(1).scaleb(-digits))).cast("string")
    large = F.when(F.abs(x) < _LARGEST, _exact_decimal(F.abs(x), digits).cast("string"))
    text = F.when(_outside(x, scale), large).otherwise(small)
    negative = (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(negative, F.concat(F.lit("-"), text))
        .otherwise(text)
    )


def compensated_sum(values: Column) -> Column:
    """Sum of an array of doubles in its order, carrying the rounding error of each step.

    The recorded results were summed this way; a plain sum can differ in the last
    digit, which decides comparisons with a threshold.
    """

    def add(state: Column, x: Column) -> Column:
        total = state["total"] + x
        lost = F.when(
            F.abs(state["total"]) >= F.abs(x), (state["total"] - total) + x
        ).otherwise((x - total) + state["total"])
        return F.struct(total.alias("total"), (state["lost"] + lost).alias("lost"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"))
    return F.aggregate(values, start, add, lambda s: s["total"] + s["lost"])


def percent_text(x: Column, digits: int = 1) -> Column:
    """``0.87`` -> ``87.0%``."""
    return F.concat(fixed_text(x * F.lit(100.0), digits), F.lit("%"))


def float_text(x: Column) -> Column:
    """Shortest text of a double: ``500.0``, ``12345678.9``, ``1e+16``, ``1.5e-05``.

    Spark's own cast switches to ``1.0E7`` notation at ten million.
    """
    text = x.cast("string")
    magnitude = F.abs(x)
    plain = F.regexp_replace(
        F.regexp_replace(x.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.regexp_extract(text, "^([^E]*)", 1), r"\.0$", "")
    power = F.regexp_extract(text, "E-?([0-9]+)$", 1)
    sign = F.when(F.contains(text, F.lit("E-")), F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(
        mantissa, F.lit("e"), sign, F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    )
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when((magnitude >= 1e16) | ((magnitude < 1e-4) & (magnitude > 0)), scientific)
        .when((magnitude >= 1e7) | ((magnitude < 1e-3) & (magnitude > 0)), plain)
        .otherwise(text)
    )
