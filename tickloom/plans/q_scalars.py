"""Queries on scalar and array expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import arrays, scalars, text
from tickloom.operators import features, lags, metrics, nulls
from tickloom.operators.nulls import Fill
from tickloom.operators.series import BY_DAY_DENSE
from tickloom.plans.catalog import KEYS, LOGITS, PANEL, PREDICTED, SETTLED, SLOTS, clean, query, r, rn, s, sn, zero
from tickloom.plans.registry import FEATURE_SETS, model_matrix
from tickloom.schema import INDEX, RESPONDERS, target_block
from tickloom.sources.fixtures import (
    PANEL_FEATURES,
    logit_table,
    panel,
    predictions,
    settled_panel,
    slot_panel,
)


@query(
    "cast_index",
    PANEL
    + f""" SELECT CAST(date_id AS INT) AS date_id, CAST(time_id AS INT) AS time_id, CAST(symbol_id AS INT) AS symbol_id,
    {s('CAST(CAST(feature_03 AS FLOAT) AS DOUBLE)')} AS feature_03 FROM P""",
)
def _(spark, sf):
    df = scalars.cast_index(panel(spark, sf, responders=False), "int")
    return df.select(*INDEX, r(F.col("feature_03").cast("float").cast("double")).alias("feature_03"))


@query("nan_to_null", PANEL + f" SELECT {KEYS}, {s(clean('feature_02'))} AS feature_02 FROM P")
def _(spark, sf):
    df = scalars.nan_to_null_columns(panel(spark, sf, responders=False), PANEL_FEATURES)
    return df.select(*INDEX, *rn("feature_02"))


@query(
    "zero_fill",
    PANEL + f" SELECT {KEYS}, " + ", ".join(f"{s(zero(c))} AS {c}" for c in PANEL_FEATURES) + " FROM P",
)
def _(spark, sf):
    return scalars.zero_fill(panel(spark, sf, responders=False)).select(*INDEX, *rn(*PANEL_FEATURES))


_POLICY = {
    "by_zero": Fill(),
    "by_mean": Fill("mean"),
    "by_median": Fill("median"),
    "by_group_mean": Fill("mean", grouped=True),
    "by_group_median": Fill("median", grouped=True),
}


@query(
    "fill_by_strategy",
    PANEL
    + f""", V AS (SELECT {KEYS}, {clean('feature_02')} AS v FROM P),
    G AS (SELECT symbol_id, avg(v) AS m, quantile_cont(v, 0.5) AS q FROM V GROUP BY 1),
    A AS (SELECT avg(v) AS m, quantile_cont(v, 0.5) AS q FROM V)
    SELECT date_id, time_id, V.symbol_id, {s('coalesce(v, 0.0)')} AS by_zero,
      {s('coalesce(v, (SELECT m FROM A))')} AS by_mean, {s('coalesce(v, (SELECT q FROM A))')} AS by_median,
      {s('coalesce(v, G.m)')} AS by_group_mean, {s('coalesce(v, G.q)')} AS by_group_median
    FROM V JOIN G ON V.symbol_id = G.symbol_id""",
)
def _(spark, sf):
    df = panel(spark, sf, responders=False).select(*INDEX, *[F.col("feature_02").alias(c) for c in _POLICY])
    return nulls.fill_by_strategy(df, _POLICY, ["symbol_id"]).select(*INDEX, *rn(*_POLICY))


def class_sql(column: str) -> str:
    return (
        f"CAST(CASE WHEN abs({column}) > 0.26 THEN 3 WHEN abs({column}) > 0.15 THEN 2 "
        f"WHEN abs({column}) > 0.06 THEN 1 ELSE 0 END AS INT)"
    )


@query(
    "magnitude_class",
    SETTLED + f" SELECT {KEYS}, {class_sql('responder_3')} AS class_3, {class_sql('responder_6')} AS class_6 FROM R",
)
def _(spark, sf):
    return settled_panel(spark, sf).select(
        *INDEX,
        scalars.magnitude_class("responder_3").alias("class_3"),
        scalars.magnitude_class("responder_6").alias("class_6"),
    )


ARGMAX = "CAST(list_position(logits, list_max(logits)) - 1 AS INT)"


@query("argmax_class", LOGITS + f" SELECT vec_id, {ARGMAX} AS klass FROM L")
def _(spark, sf):
    return logit_table(spark, sf).select("vec_id", arrays.argmax_class("logits").alias("klass"))


@query(
    "softmax_probs",
    LOGITS
    + ", E AS (SELECT vec_id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM L) SELECT vec_id, "
    + ", ".join(f"{s(f'e[{i + 1}] / list_sum(e)')} AS p{i}" for i in range(4))
    + " FROM E",
)
def _(spark, sf):
    df = logit_table(spark, sf).select("vec_id", arrays.softmax("logits").alias("p"))
    return df.select("vec_id", *[r(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(4)])


def shrink_sql(p: str, k: str, factors) -> str:
    return (
        f"({p}) * CASE {k} WHEN 0 THEN {float(factors[0])} WHEN 1 THEN {float(factors[1])} "
        f"WHEN 2 THEN {float(factors[2])} ELSE 1.0 END"
    )


@query(
    "shrink_by_class",
    LOGITS
    + f""" SELECT vec_id, {s(shrink_sql('y', ARGMAX, (.1, .25, .5)))} AS train, {s(shrink_sql('y', ARGMAX, (0, .25, .5)))} AS predict,
    {s(shrink_sql('y', ARGMAX, (.01, .1, .25)))} AS wide_test FROM L""",
)
def _(spark, sf):
    k = text.argmax_class("logits")
    return logit_table(spark, sf).select(
        "vec_id",
        r(scalars.shrink_by_class("y", k, scalars.SHRINK_TRAIN)).alias("train"),
        r(scalars.shrink_by_class("y", k, scalars.SHRINK_PREDICT)).alias("predict"),
        r(scalars.shrink_by_class("y", k, scalars.SHRINK_WIDE_TEST)).alias("wide_test"),
    )


@query(
    "scale_prediction",
    PREDICTED
    + f" SELECT {KEYS}, {s('pred_6 / 2.0')} AS halved, {s('pred_6 * 100 * 0.1')} AS wide, {s('pred_6 * 10 * 0.1')} AS narrow FROM Q",
)
def _(spark, sf):
    scaled = {"halved": ("pred_6", 0.5), "wide": ("pred_6 * 100", 0.1), "narrow": ("pred_6 * 10", 0.1)}
    return predictions(panel(spark, sf)).select(
        *INDEX, *[r(scalars.blend([part])).alias(n) for n, part in scaled.items()]
    )


@query(
    "blend_predictions",
    PREDICTED
    + f""" SELECT {KEYS}, {s('0.25*pred_6 + 0.75*pred_8')} AS two_heads, {s('0.25*pred_6 + 0.75*pred_8 + 0.0*pred_7')} AS three_heads,
    {s('0.6*pred_6 + 0.4*pred_8')} AS ungated FROM Q""",
)
def _(spark, sf):
    b = scalars.blend
    return predictions(panel(spark, sf)).select(
        *INDEX,
        r(b([("pred_6", 0.25), ("pred_8", 0.75)])).alias("two_heads"),
        r(b([("pred_6", 0.25), ("pred_8", 0.75), ("pred_7", 0.0)])).alias("three_heads"),
        r(b([("pred_6", 0.6), ("pred_8", 0.4)])).alias("ungated"),
    )


def synthetic_sql(a: str, b: str, scale: float) -> str:
    return (
        f"CASE WHEN ({a})/{scale} > -1 AND ({b})/{scale} > -1 "
        f"THEN (exp(ln(1 + ({a})/{scale}) - ln(1 + ({b})/{scale})) - 1) * {scale} END"
    )


@query(
    "synthetic_responders",
    SETTLED
    + f" SELECT {KEYS}, "
    + ", ".join(f"{s(synthetic_sql(f'responder_{i + 3}', f'responder_{i + 6}', 0.5))} AS responder_{i}" for i in range(3))
    + " FROM R",
)
def _(spark, sf):
    return settled_panel(spark, sf).select(
        *INDEX,
        *[
            r(scalars.synthetic_responder(f"responder_{i + 3}", f"responder_{i + 6}", 0.5)).alias(f"responder_{i}")
            for i in range(3)
        ],
    )


@query(
    "difference_targets",
    PANEL
    + f""" SELECT {KEYS}, {s('responder_0 - (responder_3 - responder_6)')} AS responder_0_residual,
    {s('responder_2 - (responder_5 - responder_8)')} AS responder_2_residual FROM P""",
)
def _(spark, sf):
    triples = [("responder_0", "responder_3", "responder_6"), ("responder_2", "responder_5", "responder_8")]
    df = features.difference_residuals(panel(spark, sf), triples)
    return df.select(*INDEX, *rn("responder_0_residual", "responder_2_residual"))


COUNTDOWN = "CAST(max(time_id) OVER (PARTITION BY date_id, symbol_id) + 1 - time_id AS INT) AS lag_time_id"


@query("lag_time_countdown", PANEL + f" SELECT {KEYS}, {COUNTDOWN} FROM P")
def _(spark, sf):
    return lags.lag_time_countdown(panel(spark, sf, responders=False).select(*INDEX))


@query(
    "clamp_range",
    SLOTS
    + f""" SELECT {KEYS}, {s('greatest(-5.0, least(5.0, feature_00 / 10.0))')} AS clamped,
    {s('greatest(-m, least(m, feature_00))')} AS scaled FROM S, (SELECT max(abs(f)) AS m FROM (SELECT avg(feature_00) AS f FROM S GROUP BY time_id))""",
)
def _(spark, sf):
    df = slot_panel(spark, sf)
    bound = df.groupBy("time_id").agg(F.avg("feature_00").alias("f")).agg(F.max(F.abs("f")).alias("m"))
    return df.select(
        *INDEX,
        r(scalars.clamp("feature_00 / 10.0D")).alias("clamped"),
        r(scalars.clamp("feature_00", bound.select("m").scalar())).alias("scaled"),
    )


def lead_sql(column: str, steps: int) -> str:
    if steps == 0:
        return column
    return f"{'lead' if steps > 0 else 'lag'}({column}, {abs(steps)}) OVER ser"


SERIES = "WINDOW ser AS (PARTITION BY date_id, symbol_id ORDER BY time_id)"
V12_BLOCKS = [("responder_5", "lead"), ("responder_5", "lead_v2"), ("responder_6", "lead_v2")]


def _block_leads(responder: str, kind: str) -> list[tuple[str, int]]:
    found = target_block(FEATURE_SETS[12].targets(PANEL_FEATURES), responder, kind)
    return [(name, int(name.rsplit("_", 1)[1])) for _, name in found]


@query(
    "select_target_block",
    PANEL
    + ", W AS (SELECT *, "
    + ", ".join(f'{lead_sql(c, i)} AS "{n}"' for c, k in V12_BLOCKS for n, i in _block_leads(c, k))
    + f" FROM P {SERIES}) SELECT {KEYS}, "
    + ", ".join(
        s("(" + " + ".join(f'coalesce("{n}", 0)' for n, _ in _block_leads(c, k)) + f") / {float(len(_block_leads(c, k)))}")
        + f" AS mean_{c}_{k}"
        for c, k in V12_BLOCKS
    )
    + " FROM W",
)
def _(spark, sf):
    df = scalars.zero_fill(features.responder_wide_targets(panel(spark, sf), BY_DAY_DENSE))
    out = []
    for c, k in V12_BLOCKS:
        names = [text.name(n) for n, _ in _block_leads(c, k)]
        out.append(r(F.expr(f"{text.total(names)} / {len(names)}")).alias(f"mean_{c}_{k}"))
    return df.select(*INDEX, *out)


@query(
    "grad_hess",
    PREDICTED
    + f""", T AS (SELECT sum(weight * responder_6 * responder_6) AS t FROM Q)
    SELECT {KEYS}, {s('1e6 * 2 * weight * (responder_6 - pred_6) / t')} AS grad, {s('1e6 * -2 * weight / t')} AS hess FROM Q, T""",
)
def _(spark, sf):
    df = metrics.grad_hess(predictions(panel(spark, sf)), "pred_6", "responder_6")
    return df.select(*INDEX, r(F.col("grad") * 1e6).alias("grad"), r(F.col("hess") * 1e6).alias("hess"))


@query(
    "clock_cyclic_encoding",
    PANEL + f" SELECT {KEYS}, {s('sin(2 * pi() * time_id / 100)')} AS time_sin, {s('cos(2 * pi() * time_id / 100)')} AS time_cos FROM P",
)
def _(spark, sf):
    sin, cos = scalars.cyclic("time_id", 100)
    return panel(spark, sf, responders=False).select(*INDEX, r(sin).alias("time_sin"), r(cos).alias("time_cos"))


def _weighted(cols) -> str:
    return " + ".join(f"{i + 1} * CAST(CAST({zero(c)} AS FLOAT) AS DOUBLE)" for i, c in enumerate(cols))


_X = ["weight", *PANEL_FEATURES]


@query(
    "model_matrix",
    PANEL
    + f""" SELECT {KEYS}, CAST({len(_X)} AS INT) AS n_x, CAST(9 AS INT) AS n_y, {s(_weighted(_X), 4)} AS x_sum,
    {s(_weighted(RESPONDERS), 4)} AS y_sum, weight + 0.0 AS w FROM P""",
)
def _(spark, sf):
    m = model_matrix(panel(spark, sf), _X, RESPONDERS, INDEX)
    ranked = lambda c: F.expr(text.array_sum(f"transform({c}, (x, i) -> CAST(x AS DOUBLE) * (i + 1))"))
    return m.select(
        *INDEX,
        F.size("X").alias("n_x"),
        F.size("y").alias("n_y"),
        r(ranked("X"), 4).alias("x_sum"),
        r(ranked("y"), 4).alias("y_sum"),
        F.get("w", F.lit(0)).cast("double").alias("w"),
    )


@query(
    "steps_to_array",
    LOGITS
    + f" SELECT vec_id, {s('list_avg(steps_a)')} AS mean_a, {s('list_avg(steps_b)')} AS mean_b, {s('block21[11]')} AS centre FROM L",
)
def _(spark, sf):
    return logit_table(spark, sf).select(
        "vec_id",
        r(arrays.array_mean("steps_a")).alias("mean_a"),
        r(arrays.array_mean("steps_b")).alias("mean_b"),
        r(arrays.step("block21", 10)).alias("centre"),
    )
