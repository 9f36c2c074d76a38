"""Rolling aggregates over slot values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.select import semi_join_index
from tickloom.operators.series import BY_DAY, SeriesLayout, over_series


def rolling_mean_rows(
    df: DataFrame, column: str, period: int, name: str = "rolling_mean", layout: SeriesLayout = BY_DAY
) -> DataFrame:
    """Mean over slot values in ``(t − period, t]``, one result per input row."""
    return over_series(
        df,
        lambda w: [f"avg({column}) OVER ({w} RANGE BETWEEN {period - 1} PRECEDING AND CURRENT ROW) AS {name}"],
        before=period - 1,
        layout=layout,
        slots=True,
    )


def expanding_window(
    df: DataFrame,
    period: int,
    index_column: str,
    group_by: Sequence[str],
    aggs: Sequence[Column] | None = None,
    named_aggs: dict[str, Column] | None = None,
) -> DataFrame:
    """Any aggregates over slot values in ``(t − period, t]`` for each group.

    A result row exists for every slot value of the whole table at which the group's window
    holds a row, also where the group itself has none. Each row is sent to the ``period``
    windows it is part of and combined on the map side; for a group without gaps
    ``rolling_mean_rows`` gives the same without copies.
    """
    if not aggs and not named_aggs:
        raise ValueError("no aggregate is given")
    dtype = df.schema[index_column].dataType
    exprs = list(aggs or []) + [c.alias(n) for n, c in (named_aggs or {}).items()]
    slot = F.col(index_column).cast("int")
    spread = df.withColumn("__t", F.explode(F.sequence(slot, slot + (period - 1))))
    windows = (
        spread.groupBy(*group_by, "__t")
        .agg(*exprs)
        .withColumnRenamed("__t", index_column)
    )
    kept = semi_join_index(windows, df.select(F.col(index_column).cast("int").alias(index_column)), index_column)
    return kept.withColumn(index_column, F.col(index_column).cast(dtype))


def rolling_compare(df: DataFrame, column: str, period: int, layout: SeriesLayout = BY_DAY) -> DataFrame:
    """Both rolling forms side by side on the panel keys."""
    left = rolling_mean_rows(df, column, period, layout=layout).select(
        "date_id", "time_id", "symbol_id", column, "rolling_mean"
    )
    right = expanding_window(
        df,
        period,
        "time_id",
        ["date_id", "symbol_id"],
        aggs=[F.avg(column).alias("rolling_mean2")],
        named_aggs={"rolling_mean3": F.avg(column)},
    )
    return left.join(right, ["date_id", "time_id", "symbol_id"], "full_outer")
