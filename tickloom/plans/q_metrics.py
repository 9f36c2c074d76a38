"""Queries on losses and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import metrics
from tickloom.operators.series import BY_DAY_DENSE, shift_columns
from tickloom.functions.scalars import zero_fill
from tickloom.plans import losses
from tickloom.plans.catalog import LOGITS, PREDICTED, SETTLED, query, r, rn, s, sn
from tickloom.plans.q_scalars import SERIES, class_sql, lead_sql, shrink_sql
from tickloom.schema import LEAD_STEPS_FROM_ZERO, RESPONDERS, SIGNED_LEAD_STEPS, SMA_RESPONDERS
from tickloom.sources.fixtures import (
    CLASS_CENTRES,
    PANEL_FEATURES,
    logit_table,
    model_outputs,
    panel,
    predictions,
    settled_panel,
)

PAIRS = [(f"pred_{i}", f"responder_{i}") for i in range(9)]
R6 = [("pred_6", "responder_6")]


def _num(pairs) -> str:
    return "sum(weight * (" + " + ".join(f"({y} - {p}) * ({y} - {p})" for p, y in pairs) + "))"


def _den(pairs) -> str:
    return "sum(weight * (" + " + ".join(f"{y} * {y}" for _, y in pairs) + "))"


def _q(spark, sf):
    return predictions(panel(spark, sf))


@query(
    "weighted_r2_loss",
    PREDICTED + f" SELECT {s(f'{_num(R6)} / NULLIF({_den(R6)}, 0)')} AS loss, count(*) AS n FROM Q",
)
def _(spark, sf):
    return metrics.weighted_r2_loss(_q(spark, sf), R6).select(rn("loss")[0], "n")


@query(
    "weighted_r2_pooled",
    PREDICTED + f" SELECT {s(f'{_num(PAIRS)} / NULLIF({_den(PAIRS)}, 0)')} AS loss, count(*) AS n FROM Q",
)
def _(spark, sf):
    return metrics.weighted_r2_loss(_q(spark, sf), PAIRS).select(rn("loss")[0], "n")


@query(
    "r2_scale_sweep",
    PREDICTED
    + " "
    + " UNION ALL ".join(
        f"SELECT CAST({sc} AS DOUBLE) AS scale, "
        + s(_num([(f"{sc} * {p}", y) for p, y in PAIRS]) + f" / {_den(PAIRS)}")
        + " AS loss, "
        + s(
            "sum(weight * ("
            + " + ".join(f"{p} * {y}" for p, y in PAIRS)
            + ")) / sum(weight * ("
            + " + ".join(f"{p} * {p}" for p, _ in PAIRS)
            + "))"
        )
        + " AS best_scale FROM Q"
        for sc in metrics.TEST_SCALES
    ),
)
def _(spark, sf):
    return metrics.r2_scale_sweep(_q(spark, sf), PAIRS).select("scale", *rn("loss", "best_scale"))


@query(
    "mse_loss",
    PREDICTED + " SELECT " + s("avg(" + " + ".join(f"({y} - {p}) * ({y} - {p})" for p, y in PAIRS) + ") / 9") + " AS loss FROM Q",
)
def _(spark, sf):
    return metrics.mse_loss(_q(spark, sf), PAIRS).select(*rn("loss"))


@query(
    "mae_loss",
    PREDICTED + " SELECT " + s("avg(" + " + ".join(f"abs({y} - {p})" for p, y in PAIRS) + ") / 9") + " AS loss FROM Q",
)
def _(spark, sf):
    return metrics.mae_loss(_q(spark, sf), PAIRS).select(*rn("loss"))


def _xen_columns(logits: str, klass: str) -> tuple[str, str]:
    lse = f"(list_max({logits}) + ln(list_sum(list_transform({logits}, lambda x: exp(x - list_max({logits}))))))"
    w = "[0.55::DOUBLE, 0.22::DOUBLE, 0.14::DOUBLE, 0.09::DOUBLE]"
    hit = f"({lse} - {logits}[{klass} + 1]) * {w}[{klass} + 1]"
    spread = " + ".join(f"({lse} - {logits}[{i + 1}]) * {c}" for i, c in enumerate((0.55, 0.22, 0.14, 0.09)))
    return f"(0.95 * {hit} + 0.0125 * ({spread}))", f"{w}[{klass} + 1]"


_N, _D = _xen_columns("logits", "cls")


@query("weighted_cross_entropy", LOGITS + f" SELECT {s(f'sum({_N}) / sum({_D})')} AS loss FROM L")
def _(spark, sf):
    return metrics.weighted_cross_entropy(logit_table(spark, sf), [("logits", "cls")]).select(*rn("loss"))


# Model outputs and zero-filled leads on the settled panel, in SQL.
_LEADS = {f"responder_{c[-1]}_lead_{i}": (c, i) for c in SMA_RESPONDERS[4] for i in LEAD_STEPS_FROM_ZERO}
_SIGNED = {
    f"{c}_lead_v2_{i}": (c, i) for sma, steps in SIGNED_LEAD_STEPS.items() for c in SMA_RESPONDERS[sma] for i in steps
}


def outputs_sql(scale: float) -> str:
    cols = [f"(0.6*responder_{k} + 0.1*feature_03) / {scale} AS regress_{k}" for k in range(9)]
    for k in range(9):
        inner = ", ".join(f"2.0 - 8.0 * abs(abs(responder_{k} * 0.9 + 0.02) - {c})" for c in CLASS_CENTRES)
        cols += [f"[{inner}] AS logits_{k}", f"{class_sql(f'responder_{k}')} AS class_{k}"]
    for k, fast in ((3, 5), (6, 8)):
        cols += [f"(0.5*responder_{fast} + 0.1*feature_03 + {0.01 * i}) / {scale} AS sma_{k}_{i}" for i in range(5)]
    for k in (2, 5, 8):
        cols += [f"(0.5*responder_{k} + {0.002 * i}) / {scale} AS wide4_{k}_{i}" for i in range(29)]
    for k in (0, 3, 6):
        cols += [f"(0.5*responder_{k} + {0.003 * i}) / {scale} AS wide20_{k}_{i}" for i in range(21)]
    leads = ", ".join(f'coalesce({lead_sql(c, i)}, 0.0) AS "{n}"' for n, (c, i) in {**_LEADS, **_SIGNED}.items())
    return SETTLED + f", LD AS (SELECT *, {leads} FROM R {SERIES}), M AS (SELECT *, {', '.join(cols)} FROM LD)"


def _mean(terms) -> str:
    return "(" + " + ".join(terms) + f") / {float(len(terms))}"


def _sum_r2(pairs) -> str:
    return f"{_num(pairs)} / {_den(pairs)}"


def _sum_mse(pairs) -> str:
    return "(sum(" + " + ".join(f"({y} - {p}) * ({y} - {p})" for p, y in pairs) + f") / (count(*) * {len(pairs)}))"


def _sum_xen(targets) -> str:
    parts = [_xen_columns(f"logits_{k}", f"class_{k}") for k in targets]
    return f"sum({' + '.join(n for n, _ in parts)}) / sum({' + '.join(d for _, d in parts)})"


def _gate_class(k: int) -> str:
    return f"(list_position(logits_{k}, list_max(logits_{k})) - 1)"


def train_sql(version: int) -> dict[str, str]:
    """Name → SQL aggregate, with ``total`` in terms of the others."""
    if version == 3:
        pairs = [(f"regress_{k}", f"responder_{k}") for k in range(9)]
        extra = [(f"(0.9 * {z})", z) for z in (f"zf_{c}" for c in PANEL_FEATURES)]
        return {"loss_rsq": _sum_r2(pairs), "loss_mse": _sum_mse(pairs + extra), "total": "loss_rsq + 1e-4 * loss_mse"}
    sc = losses.SCALE[version]
    y = lambda c: f'("{c}" / {sc})'
    regress = lambda ks: [(f"regress_{k}", y(f"responder_{k}")) for k in ks]
    if version in (9, 10):
        shrunk = [
            (shrink_sql(f"regress_{k}", _gate_class(k), (0.1, 0.25, 0.5)), f"responder_{k}") for k in range(9)
        ]
        shrunk = [(f"({p})", t) for p, t in shrunk]
        return {
            "loss_rsq": _sum_r2(shrunk),
            "loss_mse": _sum_mse(regress(range(9))),
            "loss_xen": _sum_xen(range(9)),
            "total": "loss_rsq + loss_mse / 2 + loss_xen / 4",
        }
    first = "lead_0" if version == 12 else None
    fast = lambda k: [f"responder_{k}_{first}" if first else f"responder_{k}"] + [f"responder_{k}_lead_{i}" for i in (4, 8, 12, 16)]
    steps = lambda k, f: [(f"sma_{k}_{i}", y(c)) for i, c in enumerate(fast(f))]
    avg = {k: f"({_mean([f'sma_{k}_{i}' for i in range(5)])})" for k in (3, 6)}
    slow = [(avg[k], y(f"responder_{k}")) for k in (3, 6)]
    out = {
        "loss_rsq": _sum_r2(regress(range(3, 9))) + (" / 6" if version == 12 else ""),
        "loss_mse": f"{sc} * {_sum_mse(regress(range(3, 9) if version == 11 else range(9)))}",
        "loss_xen": _sum_xen(range(3, 9)),
        "loss_sma004_r5": f"{sc} * {_sum_mse(steps(3, 5))}",
        "loss_sma004_r8": f"{sc} * {_sum_mse(steps(6, 8))}",
        "loss_sma020_r3": f"{sc} * {_sum_mse(slow[:1])}",
        "loss_sma020_r6": f"{sc} * {_sum_mse(slow[1:])}",
    }
    head = "loss_rsq + loss_mse / 2 + loss_xen / 4"
    five = "loss_sma004_r5 + loss_sma004_r8 + loss_sma020_r3 + loss_sma020_r6"
    if version == 11:
        out["loss_sma_rsq"] = _sum_r2(slow)
        return out | {"total": f"{head} + ({five} + loss_sma_rsq) / 5"}
    out["loss_sma004_r2"] = (
        f"{sc} * " + _sum_mse([(f"(sma_3_{i} - sma_6_{i})", y(c)) for i, c in enumerate(fast(2))])
    )
    out["loss_sma020_r0"] = f"{sc} * " + _sum_mse([(f"({avg[3]} - {avg[6]})", y("responder_0"))])
    seven = f"({five} + loss_sma004_r2 + loss_sma020_r0 + loss_sma_rsq) / 7 / 2"
    if version == 13:
        out["loss_sma_rsq"] = f"({_sum_r2(slow)} + {_sum_r2(steps(3, 5))} + {_sum_r2(steps(6, 8))}) / 3"
        return out | {"total": f"{head} + {seven}"}
    out["loss_sma_rsq"] = _sum_r2(slow) + " / 2"
    wide = lambda n, k, ks: [(f"wide{n}_{k}_{j}", y(f"responder_{k}_lead_v2_{i}")) for j, i in enumerate(ks)]
    w4 = {k: wide(4, k, range(-4, 25)) for k in (2, 5, 8)}
    w20 = {k: wide(20, k, range(-10, 11)) for k in (0, 3, 6)}
    out["loss_ll_mse004"] = f"{sc} / 3 * ({' + '.join(_sum_mse(v) for v in w4.values())})"
    out["loss_ll_mse020"] = f"{sc} / 3 * ({' + '.join(_sum_mse(v) for v in w20.values())})"
    out["loss_ll_rsq"] = f"({_sum_r2(w4[5])} + {_sum_r2(w4[8])}) / 2"
    return out | {"total": f"{head} + {seven} + (loss_ll_mse004 + loss_ll_mse020 + loss_ll_rsq) / 3"}


def loss_rows_sql(prefix: str, named: dict[str, str], version: int) -> str:
    total = named["total"]
    cols = ", ".join(f"{v} AS {n}" for n, v in named.items() if n != "total")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, {s(n if n != 'total' else total)} AS loss FROM V" for n in named)
    return f"SELECT CAST({version} AS INT) AS version, name, loss FROM ({prefix}, V AS (SELECT {cols} FROM M) {rows})"


def _filled_outputs(version: int) -> str:
    zf = ", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 ELSE {c} END AS zf_{c}" for c in PANEL_FEATURES)
    base = outputs_sql(losses.SCALE.get(version, 1.0))
    return base.replace("M AS (SELECT *, ", f"M AS (SELECT *, {zf}, ")


TRAIN_VERSIONS = (3, 9, 11, 12, 13)


# Outputs stand side by side, one set for each unit.
_SUFFIX = {v: f"_x{int(losses.SCALE.get(v, 1.0))}" for v in (3, 9, 10, 11, 12, 13)}
_COLUMNS = {v: (lambda name, end=end: f"{name}{end}") for v, end in _SUFFIX.items()}


def _side_by_side(df, versions):
    """The outputs of several versions next to the panel."""
    for v in sorted({_SUFFIX[v]: v for v in versions}.values()):
        df = model_outputs(df, losses.SCALE.get(v, 1.0), _SUFFIX[v])
    return df


def _trained(spark, sf):
    """Zero-filled settled panel with every lead that any version trains on, from one series pass, next to all outputs."""
    shifts = {n: (n, c, -i) for n, (c, i) in {**_LEADS, **_SIGNED}.items()}
    df = zero_fill(shift_columns(settled_panel(spark, sf), list(shifts.values()), BY_DAY_DENSE))
    df = df.selectExpr("*", *[f"0.9D * {c} AS pred_{c}{_SUFFIX[3]}" for c in PANEL_FEATURES])
    return _side_by_side(df, TRAIN_VERSIONS)


@query(
    "composite_loss",
    " UNION ALL ".join(loss_rows_sql(_filled_outputs(v), train_sql(v), v) for v in TRAIN_VERSIONS),
)
def _(spark, sf):
    columns = {v: _COLUMNS[v] for v in TRAIN_VERSIONS}
    return losses.train_losses(_trained(spark, sf), columns, PANEL_FEATURES).select("version", "name", *rn("loss"))


def _by_batch_sql(version: int) -> str:
    """Named losses per date, then their means weighted by rows."""
    named = train_sql(version)
    cols = ", ".join(f"{v} AS {n}" for n, v in named.items() if n != "total")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, {n if n != 'total' else named['total']} AS loss, rows FROM V" for n in named)
    return (
        f"SELECT CAST({version} AS INT) AS version, name, {s('sum(loss * rows) / sum(CASE WHEN loss IS NOT NULL THEN rows END)')} AS loss, CAST(sum(rows) AS BIGINT) AS n, count(*) AS batches "
        f"FROM ({_filled_outputs(version)}, V AS (SELECT date_id, count(*) AS rows, {cols} FROM M GROUP BY date_id) {rows}) GROUP BY name"
    )


@query("named_batch_losses", " UNION ALL ".join(_by_batch_sql(v) for v in TRAIN_VERSIONS))
def _(spark, sf):
    columns = {v: _COLUMNS[v] for v in TRAIN_VERSIONS}
    return losses.train_losses_by_batch(_trained(spark, sf), columns, PANEL_FEATURES).select("version", "name", *rn("loss"), "n", "batches")


def gated_sql(version: int) -> dict[str, str]:
    sc = losses.SCALE[version]
    factors = (0.01, 0.1, 0.25) if version == 12 else (0, 0.25, 0.5)
    heads = {"": f"(regress_6 * {sc})", "sma_": f"({_mean([f'sma_6_{i}' for i in range(5)])} * {sc})"}
    if version == 12:
        heads["ll_"] = f"(wide20_6_10 * {sc})"
    out = {}
    for h, p in heads.items():
        for name, q in (("raw", p), ("kelly", f"({p} * 0.1)"), ("zerox", f"({shrink_sql(p, _gate_class(6), factors)})")):
            out[f"loss_{h}{name}_rsq"] = _sum_r2([(q, "responder_6")])
    return out | {"total": "(" + " + ".join(out) + f") / {len(out)}"}


def pooled_gate_sql(version: int) -> dict[str, str]:
    gate = lambda p, k: f"({shrink_sql(p, _gate_class(k), (0, 0.25, 0.5))})"
    sc = losses.SCALE[version]
    direct = [(gate(f"regress_{k} * {sc}", k), f"responder_{k}") for k in (range(3, 9) if version == 11 else range(9))]
    if version != 11:
        return {"loss_rsq": _sum_r2(direct), "total": "loss_rsq"}
    slow = [(gate(f"{_mean([f'sma_{k}_{i}' for i in range(5)])} * {sc}", k), f"responder_{k}") for k in (3, 6)]
    return {"loss_rsq": _sum_r2(direct), "loss_sma_rsq": _sum_r2(slow), "total": "loss_rsq + loss_sma_rsq"}


TEST_VERSIONS = (9, 10, 11, 12, 13)


@query(
    "gated_r2_report",
    " UNION ALL ".join(
        loss_rows_sql(outputs_sql(losses.SCALE[v]), pooled_gate_sql(v) if v <= 11 else gated_sql(v), v) for v in TEST_VERSIONS
    ),
)
def _(spark, sf):
    df = _side_by_side(zero_fill(settled_panel(spark, sf)), TEST_VERSIONS)
    return losses.gated_r2_report(df, {v: _COLUMNS[v] for v in TEST_VERSIONS}).select("version", "name", *rn("loss"))


@query(
    "batch_weighted_loss",
    PREDICTED
    + f""", B AS (SELECT {_num(R6)} / NULLIF({_den(R6)}, 0) AS loss, count(*) AS n FROM Q GROUP BY date_id)
    SELECT {s('sum(loss * n) / sum(n)')} AS loss, CAST(sum(n) AS BIGINT) AS n, count(*) AS batches FROM B""",
)
def _(spark, sf):
    return metrics.batch_weighted_loss(_q(spark, sf), R6).select(rn("loss")[0], "n", "batches")


@query(
    "magnitude_quantiles",
    PREDICTED
    + " "
    + " UNION ALL ".join(
        f"SELECT CAST({q} AS DOUBLE) AS q, {s(f'quantile_cont(abs(responder_6), {q})')} AS value FROM P"
        for q in metrics.GATE_QUANTILES
    ),
)
def _(spark, sf):
    return metrics.magnitude_quantiles(panel(spark, sf), "responder_6").select("q", *rn("value"))


@query(
    "class_distribution",
    SETTLED
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS responder, {class_sql(c)} AS klass, count(*) AS n FROM R GROUP BY 1, 2" for c in RESPONDERS
    ),
)
def _(spark, sf):
    return metrics.class_distribution(settled_panel(spark, sf), RESPONDERS)


_QS = (0.1, 0.5, 0.9)


@query(
    "pinball_loss",
    PREDICTED
    + " "
    + " UNION ALL ".join(
        f"SELECT CAST({q} AS DOUBLE) AS quantile, {s(f'avg(greatest((responder_6 - pred_6) * {q}, (responder_6 - pred_6) * ({q} - 1)))')} AS loss FROM Q"
        for q in _QS
    ),
)
def _(spark, sf):
    return metrics.pinball_loss(_q(spark, sf), R6[0], _QS).select("quantile", *rn("loss"))


@query(
    "r2_by_group",
    PREDICTED
    + f""" SELECT 'date' AS kind, CAST(date_id AS INT) AS id, {s(f'{_num(R6)} / NULLIF({_den(R6)}, 0)')} AS loss, count(*) AS n FROM Q GROUP BY 2
    UNION ALL SELECT 'symbol', CAST(symbol_id AS INT), {s(f'{_num(R6)} / NULLIF({_den(R6)}, 0)')}, count(*) FROM Q GROUP BY 2""",
)
def _(spark, sf):
    parts = []
    for kind in ("date", "symbol"):
        by = metrics.weighted_r2_loss(_q(spark, sf), R6, by=[f"{kind}_id"])
        parts.append(
            by.select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("int").alias("id"), rn("loss")[0], "n")
        )
    return parts[0].unionByName(parts[1])
