"""Cross-sectional, lagged and leading columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators.series import (
    BY_DAY,
    SeriesLayout,
    attach_group_stats,
    is_short,
    over_series,
    shift_columns,
    shifted,
)
from tickloom.schema import (
    FEATURES,
    LAG_STEPS,
    LEAD_STEPS,
    LEAD_STEPS_FROM_ZERO,
    SIGNED_LEAD_STEPS,
    SMA_RESPONDERS,
    lag_name,
    lead_name,
    mean_name,
    signed_lead_name,
)

Shift = tuple[str, str, int]


def mean_features(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    by: Sequence[str] = ("date_id", "time_id"),
    member: str = "symbol_id",
    dtype: str = "float",
) -> DataFrame:
    """Mean of each feature over the symbols of a (date, time) cross section, NaN and null skipped.

    A smallint ``member`` bounds a cross section, so one shuffle and one window do. Otherwise
    the means are aggregated first and joined back.
    """
    mean = lambda c, over: f"CAST(avg({text.nan_to_null(c)}){over} AS {dtype}) AS {mean_name(c)}"
    if is_short(df, member):
        return df.selectExpr("*", *[mean(c, f" OVER (PARTITION BY {', '.join(by)})") for c in features])
    return attach_group_stats(df, by, [F.expr(mean(c, "")) for c in features])


def feature_lag_shifts(lag: int, features: Sequence[str] = FEATURES) -> list[Shift]:
    return [(lag_name(c, lag), c, lag) for c in features]


def responder_lag_shifts() -> list[Shift]:
    return [(lag_name(c, i), c, i) for sma, steps in LAG_STEPS.items() for c in SMA_RESPONDERS[sma] for i in steps]


def responder_lead_shifts(steps: Sequence[int] = LEAD_STEPS) -> list[Shift]:
    return [(lead_name(c, i), c, -i) for c in SMA_RESPONDERS[4] for i in steps]


def signed_lead_shifts() -> list[Shift]:
    return [
        (signed_lead_name(c, i), c, -i)
        for sma, steps in SIGNED_LEAD_STEPS.items()
        for c in SMA_RESPONDERS[sma]
        for i in steps
    ]


def lagged_features(
    df: DataFrame, lag: int, features: Sequence[str] = FEATURES, layout: SeriesLayout = BY_DAY
) -> DataFrame:
    """Each feature ``lag`` rows earlier in its (date, symbol) series. NaN stays, the start is null."""
    return shift_columns(df, feature_lag_shifts(lag, features), layout)


def responder_lags_intraday(df: DataFrame, layout: SeriesLayout = BY_DAY) -> DataFrame:
    """90 same-day responder lags. Same-day responders are not served at prediction time."""
    return shift_columns(df, responder_lag_shifts(), layout)


def responder_leads(df: DataFrame, layout: SeriesLayout = BY_DAY) -> DataFrame:
    return shift_columns(df, responder_lead_shifts(), layout)


def responder_leads_from_zero(df: DataFrame, layout: SeriesLayout = BY_DAY) -> DataFrame:
    return shift_columns(df, responder_lead_shifts(LEAD_STEPS_FROM_ZERO), layout)


def responder_signed_leads(df: DataFrame, layout: SeriesLayout = BY_DAY) -> DataFrame:
    return shift_columns(df, signed_lead_shifts(), layout)


def responder_wide_targets(df: DataFrame, layout: SeriesLayout = BY_DAY) -> DataFrame:
    """Leads from zero and signed leads in one pass: 165 columns."""
    return shift_columns(df, responder_lead_shifts(LEAD_STEPS_FROM_ZERO) + signed_lead_shifts(), layout)


def forward_sma(
    df: DataFrame, signals: Sequence[str], windows: Sequence[int] = (4, 20, 120), layout: SeriesLayout = BY_DAY
) -> DataFrame:
    """Mean of a signal over the current and the next ``k - 1`` rows, shorter at the end."""
    return over_series(
        df,
        lambda w: [
            f"avg({c}) OVER ({w} ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS {c}_sma_{k}"
            for c in signals
            for k in windows
        ],
        after=max(windows) - 1,
        layout=layout,
    )


def sma_reconstruction(
    df: DataFrame, pairs: Sequence[tuple[str, str]], layout: SeriesLayout = BY_DAY
) -> DataFrame:
    """Slow average rebuilt from five fast ones at leads 0, 4, …, 16, with the residual.

    Filled only where 20 rows lie ahead, so that all five parts are full averages.
    """

    def build(w):
        out = []
        ahead = f"lead(time_id, 19) OVER ({w}) IS NOT NULL"
        for fast, slow in pairs:
            parts = [shifted(fast, -i, w) for i in LEAD_STEPS_FROM_ZERO]
            mean = f"{text.total(parts)} / {len(parts)}"
            out += [
                f"CASE WHEN {ahead} THEN {mean} END AS {slow}_rebuilt",
                f"CASE WHEN {ahead} THEN {slow} - {mean} END AS {slow}_residual",
            ]
        return out

    return over_series(df, build, after=19, layout=layout)


def difference_residuals(df: DataFrame, triples: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Residual of ``total = long − short`` for each responder triple."""
    return df.selectExpr("*", *[f"{t} - ({a} - {b}) AS {t}_residual" for t, a, b in triples])
