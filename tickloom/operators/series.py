"""Ordered work along a series whose length has no bound.

A plain window puts a whole (date, symbol) series into one task. That is fine when the
order column is a smallint: with unique keys a series then has at most 65,536 rows. For a
wider order column the series is cut into blocks of ``2**block_bits`` rows, each block gets
copies of the neighbouring rows that its frames can reach, and the window runs per block.
Results are the same, and no task ever holds more than one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import text

_POS = "__pos"
#: Number of a row's block.
BLOCK = "__blk"
BROADCAST_LIMIT = 32 * 1024 * 1024


@dataclass(frozen=True)
class SeriesLayout:
    """How rows form series. ``dense`` promises that ``order`` counts 0, 1, 2, … in each series, ``cut`` that the rows come
    from ``cut_series`` and their blocks hold the neighbours that all windows reach, one on top of the other."""

    keys: tuple[str, ...] = ("date_id", "symbol_id")
    order: str = "time_id"
    dense: bool = False
    block_bits: int = 13
    cut: bool = False


BY_DAY = SeriesLayout()
BY_DAY_DENSE = SeriesLayout(dense=True)
BY_DAY_CUT = SeriesLayout(dense=True, cut=True)


def is_short(df: DataFrame, column: str) -> bool:
    """True when the column type itself bounds the number of distinct values to 65,536."""
    return isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a table's size, from file sizes and row widths; no job runs. It leaves grouping and filters out
    of account, so that it is too large rather than too small."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join_sized(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table that is usually far smaller than ``df``. A null key matches a null key.

    Nothing is counted while the query is built. A table whose estimate is within the limit is broadcast, so the wide
    side is not shuffled. Any other is a shuffle join, in which adaptive execution broadcasts a side that turned out
    small once its shuffle is written, and splits hot keys otherwise.
    """
    keys, hidden = list(keys), {k: f"__k_{k}" for k in keys}
    if estimated_bytes(small) <= BROADCAST_LIMIT:
        small = F.broadcast(small)
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(n)) for k, n in hidden.items()])
    return df.join(small.withColumnsRenamed(hidden), same, how).drop(*hidden.values())


def is_small(df: DataFrame) -> bool:
    """True for a table within the limit of ``join_sized``, unless the session has switched broadcasts off."""
    allowed = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() >= 0
    return allowed and estimated_bytes(df) <= BROADCAST_LIMIT


def attach_group_stats(df: DataFrame, keys: Sequence[str], stats: Sequence[Column]) -> DataFrame:
    """Put per-group aggregates on every row.

    Aggregation combines on the map side, so a group that holds most rows is never gathered in
    one task.
    """
    return join_sized(df, df.groupBy(*keys).agg(*stats), keys)


def with_position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    coarse: Column,
    fine: Column,
    name: str,
) -> DataFrame:
    """Exact 0-based row position inside each group.

    Rows are counted per (group, coarse, fine) cell, cell starts come from running sums over
    the counts, and rows are numbered only inside their cell. Sorting by (coarse, fine) must
    agree with ``order``. Rows of a null group are a group; a row with a null order key stays and
    has a null position. The merge join finds the rows already partitioned and sorted by cell from the
    numbering, so the rows are shuffled once.
    """
    # A struct equals another one whose fields are null in the same places.
    cell = ["__g", "__c", "__f"]
    # Rows without a place are spread by their content; nothing matches their null __c.
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(4096))
    cells = df.withColumns({"__g": F.struct(*group), "__c": coarse, "__f": F.coalesce(fine.cast("bigint"), spread)})
    counts = cells.where(F.col("__c").isNotNull()).groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    in_coarse = Window.partitionBy("__g", "__c").orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    coarse_start = (
        counts.groupBy("__g", "__c")
        .agg(F.sum("__n").alias("__n"))
        .select("__g", "__c", F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__cs"))
    )
    starts = (
        counts.select(*cell, F.coalesce(F.sum("__n").over(in_coarse), F.lit(0)).alias("__fs"))
        .join(coarse_start, ["__g", "__c"])
        .select(*cell, (F.col("__cs") + F.col("__fs")).alias("__start"))
    )
    in_cell = Window.partitionBy(*cell).orderBy(*order)
    # The group is read from the cell, so that its columns do not go through the shuffle twice.
    back = [F.col("__g")[c].alias(c) if c in group else F.col(f"`{c}`") for c in df.columns]
    return (
        cells.drop(*[c for c in group if c not in order])
        .withColumn("__rn", F.row_number().over(in_cell))
        .join(starts.hint("merge"), cell, "left")
        .select(*back, (F.col("__start") + F.col("__rn") - 1).alias(name))
    )


def position_by_int(df: DataFrame, group: Sequence[str], order: str, name: str) -> DataFrame:
    """``with_position`` for an integer order column that is unique inside the group."""
    if is_short(df, order):
        # Nulls last, so that they leave the other positions alone.
        w = Window.partitionBy(*group).orderBy(F.col(order).asc_nulls_last())
        return df.withColumn(name, F.when(F.col(order).isNotNull(), F.row_number().over(w).cast("bigint") - 1))
    c = F.col(order)
    return with_position(df, group, [order], F.shiftright(c, 20), F.shiftright(c, 10), name)


def cut_series(
    df: DataFrame, *, before: int = 0, after: int = 0, layout: SeriesLayout = BY_DAY, slots: bool = False, together: Sequence[str] = ()
) -> DataFrame:
    """Rows in blocks, each with copies of the ``before`` rows behind it and the ``after`` rows ahead of it.

    Windows of a layout with ``cut`` then run one on top of the other in the same blocks, with one shuffle and one sort;
    ``before`` and ``after`` are the sums of what they reach. ``home_rows`` leaves the copies out again.

    With ``together``, keys that several series share, the blocks of these series with the same number go to the same task.
    In a dense layout it then has whole cross sections, and windows over these keys, ``BLOCK`` and the order column need no
    shuffle of their own.
    """
    blocks = _cut(df, before, after, layout, slots)
    return blocks.repartition(*together, BLOCK) if together else blocks


def _cut(df: DataFrame, before: int, after: int, layout: SeriesLayout, slots: bool) -> DataFrame:
    order, bits = layout.order, layout.block_bits
    if is_short(df, order):
        return df.withColumn(BLOCK, F.col(order).isNull().cast("bigint"))
    if slots or layout.dense:
        placed, pos = df, text.name(order)
    else:
        placed, pos = position_by_int(df, list(layout.keys), order, _POS), _POS
    home = f"shiftright({pos}, {bits})"
    if before or after:
        first = f"greatest(shiftright({pos} - {after}, {bits}), least({home}, 0))"
        last = f"shiftright({pos} + {before}, {bits})"
        return placed.selectExpr("*", f"explode(coalesce(sequence({first}, {last}), array({home}))) AS {BLOCK}")
    return placed.selectExpr("*", f"{home} AS {BLOCK}")


def home_rows(df: DataFrame, layout: SeriesLayout = BY_DAY) -> DataFrame:
    """The rows of ``cut_series`` without the copies."""
    if is_short(df, layout.order):
        return df.drop(BLOCK)
    pos = _POS if _POS in df.columns else text.name(layout.order)
    return df.where(f"{BLOCK} <=> shiftright({pos}, {layout.block_bits})").drop(_POS, BLOCK)


def over_series(
    df: DataFrame,
    build: Callable[[str], Sequence[str]],
    *,
    before: int = 0,
    after: int = 0,
    layout: SeriesLayout = BY_DAY,
    slots: bool = False,
) -> DataFrame:
    """Add window expressions along each series.

    ``build`` gets the text of the ordered window and returns SQL expressions with aliases; their
    frames may reach ``before`` rows back and ``after`` rows ahead. With ``slots`` the reach is in
    values of the order column (range frames). Rows whose order is null stay; they form a series
    of their own, which no other row sees.
    """
    window = f"PARTITION BY {', '.join([*layout.keys, BLOCK])} ORDER BY {layout.order}"
    if layout.cut:
        return df.selectExpr("*", *build(window))
    blocks = cut_series(df, before=before, after=after, layout=layout, slots=slots)
    return home_rows(blocks.selectExpr("*", *build(window)), layout)


def shifted(column: str, steps: int, window: str) -> str:
    """SQL for the value ``steps`` rows back (negative: ahead)."""
    if steps == 0:
        return text.name(column)
    return f"{'lag' if steps > 0 else 'lead'}({text.name(column)}, {abs(steps)}) OVER ({window})"


def reach(shifts: Sequence[tuple[str, str, int]]) -> tuple[int, int]:
    """How many rows back and ahead shifts reach."""
    return max([s for *_, s in shifts] + [0]), max([-s for *_, s in shifts] + [0])


def shift_columns(
    df: DataFrame, shifts: Sequence[tuple[str, str, int]], layout: SeriesLayout = BY_DAY
) -> DataFrame:
    """Add ``(new name, column, rows back)`` shifts; all share one shuffle and one sort."""
    back, ahead = reach(shifts)
    return over_series(
        df,
        lambda w: [f"{shifted(c, s, w)} AS {text.name(n)}" for n, c, s in shifts],
        before=back,
        after=ahead,
        layout=layout,
    )
