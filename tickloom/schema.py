"""Column families, schemas and naming rules of the market panel."""

from __future__ import annotations

from pyspark.sql import types as T

# Key columns, column families, SMA window of each responder, seed.
INDEX = ["date_id", "time_id", "symbol_id"]
N_FEATURES = 79
N_RESPONDERS = 9
FEATURES = [f"feature_{i:02d}" for i in range(N_FEATURES)]
RESPONDERS = [f"responder_{i}" for i in range(N_RESPONDERS)]
SMA_RESPONDERS = {
    4: ["responder_2", "responder_5", "responder_8"],
    20: ["responder_0", "responder_3", "responder_6"],
    120: ["responder_1", "responder_4", "responder_7"],
}
SERVICE_COLUMNS = ["row_id", "is_scored", "partition_id"]
SEED = 3407

# Row offsets used for each SMA family.
LAG_STEPS = {4: list(range(1, 5)), 20: list(range(1, 21)), 120: list(range(1, 121, 20))}
LEAD_STEPS = [4, 8, 12, 16]
LEAD_STEPS_FROM_ZERO = [0, 4, 8, 12, 16]
SIGNED_LEAD_STEPS = {4: list(range(-4, 25)), 20: list(range(-10, 11))}


def panel_schema(n_features: int = N_FEATURES, responders: bool = True) -> T.StructType:
    """Schema of the training panel; ``date_id`` is the partition column."""
    fields = [
        T.StructField("date_id", T.ShortType()),
        T.StructField("time_id", T.ShortType()),
        T.StructField("symbol_id", T.ShortType()),
        T.StructField("weight", T.FloatType()),
    ]
    fields += [T.StructField(c, T.FloatType()) for c in FEATURES[:n_features]]
    if responders:
        fields += [T.StructField(c, T.FloatType()) for c in RESPONDERS]
    return T.StructType(fields)


def served_test_columns(features: list[str] = FEATURES) -> list[str]:
    return ["row_id", *INDEX, "weight", "is_scored", *features]


def served_lags_columns() -> list[str]:
    return [*INDEX, *[f"{c}_lag_1" for c in RESPONDERS]]


def mean_name(feature: str) -> str:
    return f"mean_{feature}"


def lag_name(column: str, steps: int) -> str:
    return f"{column}_lag_{steps}"


def lead_name(column: str, steps: int) -> str:
    return f"{column}_lead_{steps}"


def signed_lead_name(column: str, steps: int) -> str:
    return f"{column}_lead_v2_{steps}"


def responder_lag_names() -> list[str]:
    """The 90 lagged-responder columns, shared by intraday lags and previous-day tails."""
    return [lag_name(c, i) for sma, steps in LAG_STEPS.items() for c in SMA_RESPONDERS[sma] for i in steps]


def lead_target_names() -> list[str]:
    return [lead_name(c, i) for c in SMA_RESPONDERS[4] for i in LEAD_STEPS]


def wide_lead_target_names() -> list[str]:
    """Leads from zero of the SMA-4 family, then signed leads of the SMA-4 and SMA-20 families."""
    names = [lead_name(c, i) for c in SMA_RESPONDERS[4] for i in LEAD_STEPS_FROM_ZERO]
    for sma, steps in SIGNED_LEAD_STEPS.items():
        names += [signed_lead_name(c, i) for c in SMA_RESPONDERS[sma] for i in steps]
    return names


def target_block(targets: list[str], responder: str, kind: str = "plain") -> list[tuple[int, str]]:
    """Positions and names of one responder's targets: ``plain``, ``lead`` or ``lead_v2``."""
    if kind == "plain":
        wanted = lambda c: c == responder
    elif kind == "lead":
        wanted = lambda c: c.startswith(f"{responder}_lead_") and "_lead_v2_" not in c
    else:
        wanted = lambda c: c.startswith(f"{responder}_lead_v2_")
    return [(i, c) for i, c in enumerate(targets) if wanted(c)]
