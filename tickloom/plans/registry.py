"""Feature sets by version: input and target columns, and how the panel is extended."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import zero_fill
from tickloom.operators.chunks import chunk_windows
from tickloom.operators.features import (
    feature_lag_shifts,
    mean_features,
    responder_lag_shifts,
    responder_lead_shifts,
    signed_lead_shifts,
)
from tickloom.operators.lags import attach_prev_day_lags
from tickloom.operators.series import BLOCK, BY_DAY, SeriesLayout, home_rows, shift_columns
from tickloom.schema import (
    FEATURES,
    INDEX,
    LEAD_STEPS,
    LEAD_STEPS_FROM_ZERO,
    RESPONDERS,
    lag_name,
    lead_target_names,
    mean_name,
    responder_lag_names,
    wide_lead_target_names,
)


#: Before the names of lags of the day before, where a table holds lags of the same day too.
PREVIOUS = "day_before_"


@dataclass(frozen=True)
class FeatureSet:
    """What a model version reads and predicts, and the panel extensions that takes."""

    version: int
    means: bool = False
    lag_features: bool = False
    intraday_lags: bool = False
    previous_day: bool = False
    leads: str = ""  # "", "plain" or "wide"
    single_target: bool = False
    feature_targets: bool = False
    chunk: int = 0

    def inputs(self, features: Sequence[str] = FEATURES) -> list[str]:
        cols = ["time_id", "symbol_id", "weight", *features]
        if self.means:
            cols += [mean_name(c) for c in features]
        if self.lag_features:
            cols += [lag_name(c, 1) for c in features]
        if self.intraday_lags or self.previous_day:
            cols += responder_lag_names()
        return cols

    def targets(self, features: Sequence[str] = FEATURES) -> list[str]:
        if self.single_target:
            return ["responder_6"]
        cols = list(RESPONDERS)
        if self.feature_targets:
            cols += list(features)
        if self.leads == "plain":
            cols += lead_target_names()
        if self.leads == "wide":
            cols += wide_lead_target_names()
        return cols

    def shifts(self, features: Sequence[str] = FEATURES) -> list[tuple[str, str, int]]:
        """Lags and leads along a series, as ``(new name, column, rows back)``."""
        out = []
        if self.lag_features:
            out += feature_lag_shifts(1, features)
        if self.intraday_lags:
            out += responder_lag_shifts()
        if self.leads == "plain":
            out += responder_lead_shifts(LEAD_STEPS)
        if self.leads == "wide":
            out += responder_lead_shifts(LEAD_STEPS_FROM_ZERO) + signed_lead_shifts()
        return out

    def chunk_columns(self, features: Sequence[str] = FEATURES) -> list[str]:
        """Series that a chunked version reads and predicts side by side."""
        return [*features, *RESPONDERS]

    def transform(
        self,
        df: DataFrame,
        lags: DataFrame | None = None,
        features: Sequence[str] = FEATURES,
        layout: SeriesLayout = BY_DAY,
        dtype: str = "float",
    ) -> DataFrame:
        """Extend the panel. All lags and leads along a series share one shuffle and one sort."""
        return extended(df, [self], lags, features, layout, dtype)


def all_shifts(sets: Sequence[FeatureSet], features: Sequence[str] = FEATURES) -> list[tuple[str, str, int]]:
    """Lags and leads of several sets, each once."""
    return list(dict.fromkeys(shift for s in sets for shift in s.shifts(features)))


def extended(
    df: DataFrame, sets: Sequence[FeatureSet], lags: DataFrame | None, features: Sequence[str], layout: SeriesLayout, dtype: str
) -> DataFrame:
    """The panel with the extensions of all ``sets``, each made once.

    With a layout that is cut, ``df`` comes from ``cut_series`` with ``together`` the date. Lags of the day before have the names of lags of the same day; beside the latter they get ``PREVIOUS`` before their names.
    """
    # Blocks that are cut hold whole cross sections.
    by = ["date_id", "time_id", *([BLOCK] if layout.cut else [])]
    out = mean_features(df, features, by, dtype=dtype) if any(s.means for s in sets) else df
    shifts = all_shifts(sets, features)
    if shifts:
        out = shift_columns(out, shifts, layout)
    if layout.cut:
        out = home_rows(out, layout)
    if any(s.previous_day for s in sets):
        if lags is None:
            raise ValueError("the table of previous-day responders is missing")
        both = any(s.intraday_lags for s in sets)
        tails = {c: f"{PREVIOUS}{c}" for c in responder_lag_names()} if both else {}
        kept = [c for c in tails if c in out.columns]
        out = attach_prev_day_lags(out.withColumnsRenamed({c: f"__{c}" for c in kept}), lags).withColumnsRenamed(tails)
        out = out.withColumnsRenamed({f"__{c}": c for c in kept})
    return out


def shared_name(version: int, versions: Sequence[int], column: str) -> str:
    """Where a table that several versions share holds a version's column."""
    beside = any(FEATURE_SETS[v].intraday_lags for v in versions)
    return f"{PREVIOUS}{column}" if beside and FEATURE_SETS[version].previous_day and column in responder_lag_names() else column


def project(shared: DataFrame, version: int, versions: Sequence[int], features: Sequence[str] = FEATURES) -> DataFrame:
    """A version's keys, weight, inputs and targets from the table that ``versions`` share."""
    spec = FEATURE_SETS[version]
    cols = dict.fromkeys(["date_id", "time_id", "symbol_id", "weight", *spec.inputs(features), *spec.targets(features)])
    return shared.select(*[F.col(f"`{shared_name(version, versions, c)}`").alias(c) for c in cols])


FEATURE_SETS = {
    s.version: s
    for s in (
        FeatureSet(1, single_target=True),
        FeatureSet(2),
        FeatureSet(3, feature_targets=True),
        FeatureSet(4),
        FeatureSet(5),
        FeatureSet(6, means=True),
        FeatureSet(7, means=True),
        FeatureSet(8, means=True),
        FeatureSet(9, means=True),
        FeatureSet(10, means=True),
        FeatureSet(11, means=True, intraday_lags=True, leads="plain"),
        FeatureSet(12, means=True, lag_features=True, previous_day=True, leads="wide"),
        FeatureSet(13, means=True, lag_features=True, leads="plain"),
        FeatureSet(20, chunk=50),
        FeatureSet(21, chunk=120),
    )
}


def build(
    df: DataFrame,
    version: int,
    lags: DataFrame | None = None,
    features: Sequence[str] = FEATURES,
    layout: SeriesLayout = BY_DAY,
    dtype: str = "float",
) -> DataFrame:
    """Keys, weight, inputs and targets of a version, zero-filled."""
    spec = FEATURE_SETS[version]
    out = zero_fill(spec.transform(df, lags, features, layout, dtype))
    cols = ["date_id", "time_id", "symbol_id", "weight", *spec.inputs(features), *spec.targets(features)]
    return out.select(*dict.fromkeys(cols))


def build_shared(
    df: DataFrame,
    versions: Sequence[int],
    lags: DataFrame | None = None,
    features: Sequence[str] = FEATURES,
    layout: SeriesLayout = BY_DAY,
    dtype: str = "float",
) -> DataFrame:
    """One zero-filled table that holds the inputs and targets of several versions; ``project`` takes a version out of it.

    One scan, one pass for the means, one series shuffle for the lags and leads of all versions.
    """
    sets = [FEATURE_SETS[v] for v in versions]
    out = zero_fill(extended(df, sets, lags, features, layout, dtype))
    cols = [f"`{shared_name(v, versions, c)}`" for v, s in zip(versions, sets, strict=True) for c in (*s.inputs(features), *s.targets(features))]
    return out.select(*dict.fromkeys(["`date_id`", "`time_id`", "`symbol_id`", "`weight`", *cols]))


def build_chunks(df: DataFrame, version: int, features: Sequence[str] = FEATURES, stride: int = 1) -> DataFrame:
    """Inputs and targets of a chunked version: the last and the next ``chunk`` values of every series of a symbol, zero-filled."""
    spec = FEATURE_SETS[version]
    if not spec.chunk:
        raise ValueError(f"version {version} reads no chunks")
    columns = spec.chunk_columns(features)
    return chunk_windows(zero_fill(df).select(*INDEX, *columns), columns, spec.chunk, spec.chunk, stride=stride)


def model_matrix(df: DataFrame, inputs: Sequence[str], targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Float arrays ``X``, ``y`` and ``w`` in column order, zero-filled; no ``y`` for served rows."""
    filled = zero_fill(df)
    cast = lambda cols: F.array(*[F.col(c).cast("float") for c in cols])
    out = [cast(inputs).alias("X")]
    if "responder_6" in df.columns:
        out.append(cast(targets).alias("y"))
    return filled.select(*keep, *out, cast(["weight"]).alias("w"))
