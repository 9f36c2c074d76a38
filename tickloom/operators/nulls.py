"""Filling missing values by a per-column policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import nan_to_null
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.series import join_sized


@dataclass(frozen=True)
class Fill:
    """What a missing value of a column becomes: a constant, or a statistic of the clean values, of all rows or of its group."""

    statistic: str = "constant"  # or "mean", "median"
    grouped: bool = False
    constant: float = 0.0


# Features filled with zero, and features filled with their mean.
FILLED_WITH_ZERO = (
    "feature_01", "feature_04", "feature_05", "feature_06", "feature_12", "feature_13",
    "feature_14", "feature_18", "feature_19", "feature_36", "feature_39",
)
FILLED_WITH_MEAN = (
    "feature_00", "feature_02", "feature_03", "feature_07", "feature_08", "feature_09",
    "feature_10", "feature_11", "feature_15", "feature_16", "feature_17", "feature_20",
    "feature_21", "feature_22", "feature_23", "feature_24", "feature_25", "feature_26",
    "feature_27", "feature_28", "feature_29", "feature_30", "feature_31", "feature_32",
    "feature_33", "feature_34", "feature_35", "feature_37", "feature_38",
)
FEATURE_FILLS = dict.fromkeys(FILLED_WITH_ZERO, Fill()) | dict.fromkeys(FILLED_WITH_MEAN, Fill("mean"))


def fill_by_strategy(df: DataFrame, fills: Mapping[str, Fill] = FEATURE_FILLS, group: Sequence[str] = ()) -> DataFrame:
    """Replace NaN and null as each column's ``Fill`` says; columns without one stay as they are.

    Statistics of all rows are one-row subqueries; group statistics are aggregated first and joined back.
    """
    def chosen(statistic: str, grouped: bool) -> list[str]:
        return [c for c, f in fills.items() if c in df.columns and (f.statistic, f.grouped) == (statistic, grouped)]

    values = {c: F.lit(f.constant) for c, f in fills.items() if f.statistic == "constant"}
    if chosen("mean", False):
        means = df.agg(*[F.avg(nan_to_null(c)).alias(c) for c in chosen("mean", False)])
        values |= {c: means.select(c).scalar() for c in chosen("mean", False)}
    for c in chosen("median", False):
        values[c] = exact_quantiles(df, F.col(c), [0.5]).select("value").scalar()
    out = df
    if chosen("mean", True):
        out = join_sized(out, df.groupBy(*group).agg(*[F.avg(nan_to_null(c)).alias(f"__g_{c}") for c in chosen("mean", True)]), group)
    for c in chosen("median", True):
        medians = exact_quantiles(df, F.col(c), [0.5], group).select(*group, F.col("value").alias(f"__g_{c}"))
        out = join_sized(out, medians, group)
    values |= {c: F.col(f"__g_{c}") for s in ("mean", "median") for c in chosen(s, True)}
    return out.select(*[F.coalesce(nan_to_null(c), values[c]).alias(c) if c in values else F.col(c) for c in df.columns])
