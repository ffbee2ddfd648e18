"""Loose number reading: what a script runtime makes of a JSON value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.functions.text import as_column, let, strip_ws

_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_RADIX = (("^0[xX][0-9a-fA-F]+\\z", 16), ("^0[oO][0-7]+\\z", 8), ("^0[bB][01]+\\z", 2))


def finite(c: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def loose_number(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """A finite DOUBLE, or NULL where the value is not a finite number.

    Text is trimmed; empty text is 0; decimal, exponent, hex, octal and binary
    forms are read. ``cast`` alone would read ``1d`` as 1 and empty text as NULL.
    Give ``dtype`` when the column is known to be numeric.
    """
    c = as_column(c)
    if isinstance(dtype, T.FractionalType):
        return finite(c.cast("double"))
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return c.cast("double")

    def read(s: Column) -> Column:
        value = F.when(s == "", F.lit(0.0)).when(s.rlike(_DECIMAL), s.try_cast("double"))
        for pattern, radix in _RADIX:
            value = value.when(s.rlike(pattern), F.conv(F.substring(s, 3, 2147483647), radix, 10).cast("double"))
        return value

    return let(let(strip_ws(c.cast("string")), read), finite)


def number_or_zero(c: str | Column, dtype: T.DataType | None = None) -> Column:
    return F.coalesce(loose_number(c, dtype), F.lit(0.0))


def positive_or_null(c: str | Column, dtype: T.DataType | None = None) -> Column:
    n = loose_number(c, dtype)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return F.when(n > 0, n)
    return let(n, lambda x: F.when(x > 0, x))
