"""Rows for one epoch of online training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.select import sample_by_dates, sort_by_index, union_relaxed
from tickloom.operators.series import BY_DAY, SeriesLayout
from tickloom.plans.registry import FEATURE_SETS
from tickloom.schema import FEATURES, SEED
from tickloom.sources.panel import drop_service_columns


def online_sample(
    version: int,
    train: DataFrame,
    test: DataFrame | None,
    latest: DataFrame | None,
    n_train: int,
    n_test: int,
    sort_output: bool = False,
    seed: int = SEED,
    lags: DataFrame | None = None,
    features: Sequence[str] = FEATURES,
    layout: SeriesLayout = BY_DAY,
    dtype: str = "float",
) -> DataFrame:
    """Sampled train dates, all latest rows, sampled test dates, and the latest rows once more.

    Each part is extended after its dates are chosen, so only chosen dates are read. The
    extensions stay inside a date, which makes that exact.
    """
    spec = FEATURE_SETS[version]

    def prepare(df: DataFrame) -> DataFrame:
        return spec.transform(drop_service_columns(df), lags, features, layout, dtype)

    parts = [prepare(sample_by_dates(train, n_train, seed))]
    if latest is not None:
        # Extended once; each row then comes out twice.
        twice = F.explode(F.array(F.lit(1), F.lit(2)))
        parts.append(prepare(latest).select("*", twice.alias("__copy")).drop("__copy"))
    if test is not None:
        parts.append(prepare(sample_by_dates(test, n_test, seed)))
    out = union_relaxed(*parts)
    return sort_by_index(out) if sort_output else out
