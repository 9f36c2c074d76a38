"""Responders of the previous day, aligned by countdown slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.select import in_dates
from tickloom.operators.series import SeriesLayout, attach_group_stats, home_rows, is_short, is_small, over_series, shift_columns
from tickloom.schema import INDEX, LAG_STEPS, RESPONDERS, SMA_RESPONDERS, lag_name
from tickloom.sources.panel import write_bucketed_cache, write_partitioned_cache

# Files of the clustered lag table.
LAG_BUCKETS = 64
BY_COUNTDOWN = SeriesLayout(keys=("symbol_id", "lag_time_id"), order="date_id")


def group_max(df: DataFrame, column: str = "time_id", keys: Sequence[str] = ("date_id", "symbol_id"), name: str = "last_time_id") -> DataFrame:
    """Largest value of the whole group on every row."""
    if is_short(df, column) and column not in keys:
        return df.withColumn(name, F.max(column).over(Window.partitionBy(*keys)))
    return attach_group_stats(df, keys, [F.max(column).alias(name)])


def lag_time_countdown(df: DataFrame) -> DataFrame:
    """``lag_time_id`` runs from T down to 1 while ``time_id`` runs from 0 to T−1."""
    return (
        group_max(df, name="__last")
        .withColumn("lag_time_id", F.col("__last").cast("int") + 1 - F.col("time_id"))
        .drop("__last")
    )


def tail_countdown(df: DataFrame, within: int, layout: SeriesLayout) -> DataFrame:
    """``lag_time_countdown`` of the rows whose countdown is at most ``within``; all others end in the task that sees them.

    They are among the last ``within`` rows of their series, so that statistics of groups are made of these few only.
    """
    order = layout.order
    ends = over_series(df, lambda w: [f"lead({order}, {within}) OVER ({w}) IS NULL AS __end"], after=within, layout=layout)
    last = (home_rows(ends, layout) if layout.cut else ends).where(f"__end AND {order} IS NOT NULL").drop("__end")
    countdown = F.max(order).over(Window.partitionBy(*layout.keys)).cast("int") + 1 - F.col(order)
    return last.withColumn("lag_time_id", countdown).where(F.col("lag_time_id") <= within)


def prev_date_shift(df: DataFrame, columns: Sequence[str] = RESPONDERS, lag: int = 1) -> DataFrame:
    """Value at the same countdown slot on the ``lag``-th previous date on which the symbol has it."""
    return shift_columns(df, [(f"{c}_shift_{lag}", c, lag) for c in columns], BY_COUNTDOWN)


def lag_responder_table(df: DataFrame, responders: Sequence[str] = RESPONDERS) -> DataFrame:
    """Previous-date responders per (date, time, symbol), with the countdown slot."""
    return _shifted_by_slot(lag_time_countdown(df.select(*INDEX, *responders)), responders)


def lag_tail_table(df: DataFrame, layout: SeriesLayout, responders: Sequence[str] = RESPONDERS) -> DataFrame:
    """The rows of ``lag_responder_table`` that tails are taken from: those at one of the ``LAG_STEPS``."""
    steps = sorted({i for used in LAG_STEPS.values() for i in used})
    return _shifted_by_slot(tail_countdown(df, steps[-1], layout).where(F.col("lag_time_id").isin(steps)), responders)


def _shifted_by_slot(counted: DataFrame, responders: Sequence[str]) -> DataFrame:
    return prev_date_shift(counted, responders).select(
        "date_id", "time_id", "lag_time_id", "symbol_id", *[f"{c}_shift_1" for c in responders]
    )


def cached_lag_responders(df: DataFrame, path: str) -> DataFrame:
    """The lag table, written on first use and scanned afterwards."""
    return write_partitioned_cache(lag_responder_table(df), path)


def clustered_lag_responders(df: DataFrame, path: str, buckets: int = LAG_BUCKETS) -> DataFrame:
    """The lag table, written on first use and hashed by (date, symbol), the keys that its tails are taken and attached by."""
    return _clustered(lag_responder_table(df), path, buckets)


def clustered_lag_tails(df: DataFrame, path: str, layout: SeriesLayout, buckets: int = LAG_BUCKETS) -> DataFrame:
    """``clustered_lag_responders`` with only the rows that tails are taken from: its size follows the number of series, not of rows."""
    return _clustered(lag_tail_table(df, layout), path, buckets)


def _clustered(table: DataFrame, path: str, buckets: int) -> DataFrame:
    return write_bucketed_cache(table, path, ["date_id", "symbol_id"], ["date_id", "symbol_id", "time_id"], buckets)


def lag_tail_pivot(lags: DataFrame) -> DataFrame:
    """One row per (date, symbol) with the 90 tail values of the previous date.

    Only rows at one of the 25 steps in use enter the shuffle, however long a series is.
    """
    cells = [(c, i) for sma, steps in LAG_STEPS.items() for c in SMA_RESPONDERS[sma] for i in steps]
    steps = sorted({i for _, i in cells})
    return (
        lags.where(F.col("lag_time_id").isin(steps))
        .groupBy("date_id", "symbol_id")
        .agg(
            *[
                F.expr(f"max(CASE WHEN lag_time_id = {i} THEN {c}_shift_1 END) AS {lag_name(c, i)}")
                for c, i in cells
            ]
        )
    )


def attach_prev_day_lags(df: DataFrame, lags: DataFrame) -> DataFrame:
    """Add the 90 tail values of the previous date to every row: one pivot and one join.

    From ``clustered_lag_responders`` neither the pivot nor the join moves a lag row; only ``df`` is shuffled, and not even
    that if it is a table of the same clustering. Tails that Catalyst estimates as small are broadcast, and ``df`` stays where it is.
    No job runs before the result is asked for. Rows with a null date or symbol have no tails.
    """
    tails = lag_tail_pivot(lags)
    # Few tails need no list of the dates of ``df``, which would have to be made for it.
    tails = F.broadcast(tails) if is_small(tails) else lag_tail_pivot(in_dates(lags, df.select("date_id")))
    tails = tails.withColumnsRenamed({"date_id": "__date", "symbol_id": "__symbol"})
    # Plain equality, as a null-safe one hides the clustering.
    return df.join(tails, (F.col("date_id") == F.col("__date")) & (F.col("symbol_id") == F.col("__symbol")), "left").drop("__date", "__symbol")


def self_join_day_lags(df: DataFrame, column: str, lags: int) -> DataFrame:
    """A column next to its values on calendar dates d−1 … d−n at the same slot, where all of them exist.

    Each row goes to the dates d … d+n that it is a lag of, and one aggregation per key puts them side by
    side: one shuffle for any number of lags. Keys are unique; rows with a null key match nothing.
    """
    day_type = df.schema["date_id"].dataType
    keyed = df.where(" AND ".join(f"{k} IS NOT NULL" for k in INDEX))
    sent = keyed.select(*INDEX, F.col(column).alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("__k"))
    sent = sent.withColumn("date_id", F.col("date_id").cast("int") + F.col("__k"))
    values = [F.max(F.when(F.col("__k") == i, F.col("__v"))).alias(f"{column}_d{i}") for i in range(lags + 1)]
    wide = sent.groupBy(*INDEX).agg(F.count(F.lit(1)).alias("__n"), *values).where(F.col("__n") == lags + 1)
    return wide.drop("__n").withColumn("date_id", F.col("date_id").cast(day_type))
