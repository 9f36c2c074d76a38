"""Series profiles and day-over-day correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.lags import self_join_day_lags
from tickloom.operators.select import date_slice, in_dates


def _profile(df: DataFrame, column: str, symbol_id: int, by: str) -> DataFrame:
    picked = df.where(F.col("symbol_id") == symbol_id)
    return (
        picked.groupBy(by)
        .agg(F.avg(column).alias(f"{column}_mean"), F.stddev_samp(column).alias(f"{column}_std"))
        .orderBy(by)
    )


def profile_over_dates(df: DataFrame, column: str, symbol_id: int) -> DataFrame:
    """Mean and sample deviation per slot over all dates of a symbol."""
    return _profile(df, column, symbol_id, "time_id")


def profile_over_times(df: DataFrame, column: str, symbol_id: int) -> DataFrame:
    """Mean and sample deviation per date over all slots of a symbol."""
    return _profile(df, column, symbol_id, "date_id")


def max_abs_scale(profile: DataFrame, column: str) -> DataFrame:
    """Largest absolute profile mean: the chart's scale."""
    return profile.agg(F.max(F.abs(F.col(f"{column}_mean"))).alias("scale"))


def lag_correlations(
    df: DataFrame,
    column: str,
    symbol_id: int,
    lag: int = 3,
    first: int | None = None,
    last: int | None = None,
    skip: int | None = None,
) -> DataFrame:
    """Correlation of each date of a symbol with the ``lag`` calendar dates before it.

    Only slots present on all of the dates count. The first ``skip`` dates of the slice are left
    out (``lag + 1`` unless given). A date without common slots, or with a constant series,
    keeps its row with nulls.
    """
    dates = date_slice(date_slice(df.select("date_id").distinct(), first, last), skip if skip is not None else lag + 1)
    one = df.where(F.col("symbol_id") == symbol_id).select("date_id", "time_id", "symbol_id", column)
    joined = self_join_day_lags(one, column, lag)
    x = F.col(f"{column}_d0")
    corr = []
    for i in range(1, lag + 1):
        y = F.col(f"{column}_d{i}")
        both = x.isNotNull() & y.isNotNull()
        sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
        corr.append(F.try_divide(F.covar_pop(x, y), sx * sy).alias(f"lag_{i}"))
    return dates.join(in_dates(joined, dates).groupBy("date_id").agg(*corr), "date_id", "left").orderBy("date_id")


def lag_correlation_rows(correlations: DataFrame, lags: Sequence[str]) -> DataFrame:
    return correlations.unpivot(["date_id"], list(lags), "variable", "value")
