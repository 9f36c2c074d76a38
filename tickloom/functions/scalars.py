"""Scalar expressions on panel columns. String arguments are SQL expressions, such as column names."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import text
from tickloom.functions.text import (  # noqa: F401
    MAGNITUDE_BOUNDS,
    SHRINK_PREDICT,
    SHRINK_TRAIN,
    SHRINK_WIDE_TEST,
)


def nan_to_null(column: str) -> Column:
    return F.expr(text.nan_to_null(column))


def nan_to_null_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: nan_to_null(text.name(c)) for c in columns})


def zero_fill(df: DataFrame) -> DataFrame:
    """NaN and null to zero in every numeric column."""
    return df.na.fill(0)


def magnitude_class(x: str, bounds: Sequence[float] = MAGNITUDE_BOUNDS) -> Column:
    return F.expr(text.magnitude_class(x, bounds))


def shrink_by_class(p: str, klass: str, factors: Sequence[float]) -> Column:
    return F.expr(text.shrink_by_class(p, klass, factors))


def blend(parts: Sequence[tuple[str, float]]) -> Column:
    return F.expr(text.blend(parts))


def synthetic_responder(long_side: str, short_side: str, scale: float) -> Column:
    return F.expr(text.synthetic_responder(long_side, short_side, scale))


def clamp(x: str, bound: float | Column = 5.0) -> Column:
    hi = bound if isinstance(bound, Column) else F.lit(bound)
    return F.greatest(-hi, F.least(hi, F.expr(x)))


def cyclic(x: str, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = f"({x}) * {text.number(2 * math.pi / period)}"
    return F.expr(f"sin({angle})"), F.expr(f"cos({angle})")


def cast_index(df: DataFrame, dtype: str, columns: Sequence[str] = ("date_id", "time_id", "symbol_id")) -> DataFrame:
    """Cast key columns; a value outside the target range raises."""
    return df.withColumns({c: F.col(c).cast(dtype) for c in columns})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
