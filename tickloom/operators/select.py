"""Filters, date sampling, unions, sorts and reshapes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import is_short, position_by_int
from tickloom.schema import INDEX


def filter_date_from(df: DataFrame, first: int) -> DataFrame:
    return df.where(F.col("date_id") >= first)


def series_date_symbol(df: DataFrame, column: str, symbol_id: int, date_id: int) -> DataFrame:
    """One column over the slots of a date, for one symbol."""
    picked = df.where((F.col("symbol_id") == symbol_id) & (F.col("date_id") == date_id))
    return picked.select(*INDEX, column).orderBy("time_id")


def series_time_symbol(df: DataFrame, column: str, symbol_id: int, time_id: int) -> DataFrame:
    """One column over dates at one slot, for one symbol."""
    picked = df.where((F.col("symbol_id") == symbol_id) & (F.col("time_id") == time_id))
    return picked.select(*INDEX, column).orderBy("date_id")


def distinct_sorted(df: DataFrame, column: str = "date_id") -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def _sized(dates: DataFrame) -> DataFrame:
    """Broadcast a list of dates only when smallint bounds it; otherwise the planner decides by size."""
    return F.broadcast(dates) if is_short(dates, "date_id") else dates


def in_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows whose date is in ``dates``; the list stays a DataFrame."""
    return df.join(_sized(dates.select("date_id").distinct()), "date_id", "left_semi")


def date_slice(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Dates by position in the sorted list of distinct dates, both ends included."""
    dates = df.select("date_id").distinct()
    if is_short(dates, "date_id"):
        # At most 65,536 dates, so one task can number them.
        placed = dates.withColumn("__p", F.row_number().over(Window.orderBy("date_id")) - 1)
    else:
        placed = position_by_int(dates.withColumn("__g", F.lit(0)), ["__g"], "date_id", "__p")
    if first is not None:
        placed = placed.where(F.col("__p") >= first)
    if last is not None:
        placed = placed.where(F.col("__p") <= last)
    return in_dates(df, placed)


def sample_dates(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` distinct dates in an order that depends only on the seed."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("date_id").cast("string")))
    return df.select("date_id").distinct().orderBy(key, "date_id").limit(n)


def sample_by_dates(df: DataFrame, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` sampled dates."""
    return df.join(_sized(sample_dates(df, n, seed)), "date_id", "left_semi")


def edge_rows_or_null_key(df: DataFrame, column: str, below: int) -> DataFrame:
    return df.where((F.col(column) < below) | F.col(column).isNull())


def rename_family(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def literal_columns(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def row_index(df: DataFrame, batch: Sequence[str], order: str, name: str = "row_id") -> DataFrame:
    """0-based row number inside each batch, ordered by a key that is unique there; null where that key is null."""
    return position_by_int(df, batch, order, name).withColumn(name, F.col(name).cast("bigint"))


def union_relaxed(*parts: DataFrame) -> DataFrame:
    """Stack tables by column name, widening types and keeping duplicates."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def sort_by_index(df: DataFrame) -> DataFrame:
    return df.orderBy(*INDEX)


def semi_join_index(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    return df.join(other.select(column).distinct(), column, "left_semi")


def full_outer_on_key(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "full_outer")


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "variable", "value")


def flatten_targets(df: DataFrame, targets: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One row per (row, target) with the target's number as a column. No shuffle."""
    cells = F.array(
        *[F.struct(F.lit(i).alias("responder_num"), F.col(c).alias("target")) for i, c in enumerate(targets)]
    )
    return df.select(*ids, F.explode(cells).alias("__x")).select(*ids, "__x.responder_num", "__x.target")


def attach_by_key(df: DataFrame, other: DataFrame, columns: Sequence[str], keys: Sequence[str] = INDEX) -> DataFrame:
    """Add columns of another table by panel key; rows have no position to go by."""
    return df.join(other.select(*keys, *columns), list(keys), "left")
