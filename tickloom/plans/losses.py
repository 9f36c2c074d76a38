"""Training and test losses of each version, stated over named columns.

Model outputs: ``regress_k``, ``logits_k``, ``sma_3``/``sma_6`` (steps), ``wide4_k`` and
``wide20_k`` (steps), in units of ``1/scale``. Targets carry their panel names. Where several versions are
scored side by side, ``column`` names the columns that hold a version's outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from tickloom.functions import text
from tickloom.operators.metrics import LossSet, LossTerm, composite_loss, version_batch_losses, version_losses
from tickloom.schema import FEATURES, LEAD_STEPS, SIGNED_LEAD_STEPS, lead_name, signed_lead_name

# Units of the outputs of each multi-head version.
SCALE = {9: 1.0, 10: 1.0, 11: 100.0, 12: 100.0, 13: 10.0}


# Steps of the short head, and the middle of the 21-step head.
SHORT_STEPS = 5
CENTRE_STEP = 10


Named = Callable[[str], str]


def own_name(output: str) -> str:
    return output


def step_mean(k: int, column: Named = own_name) -> str:
    """Mean over the steps of the short head of responder 3 or 6."""
    return f"({text.total([text.item(column(f'sma_{k}'), i) for i in range(SHORT_STEPS)])} / {SHORT_STEPS})"


def _y(k: int) -> str:
    return f"responder_{k}"


def _scaled(column: str, scale: float) -> str:
    return f"({text.name(column)} / {text.number(scale)})"


def _classes(targets, column: Named) -> tuple:
    return tuple((column(f"logits_{k}"), text.magnitude_class(_y(k))) for k in targets)


def _pairs(prefix: str, targets, scale: float, column: Named) -> tuple:
    return tuple((column(f"{prefix}_{k}"), _scaled(_y(k), scale)) for k in targets)


def _steps(prediction: str, targets: list[str], scale: float) -> tuple:
    return tuple((text.item(prediction, i), _scaled(t, scale)) for i, t in enumerate(targets))


def _fast_targets(k: int, version: int) -> list[str]:
    """Five SMA-4 targets at leads 0, 4, …, 16; the wide version has lead 0 as a column of its own."""
    first = lead_name(_y(k), 0) if version == 12 else _y(k)
    return [first] + [lead_name(_y(k), i) for i in LEAD_STEPS]


def train_loss(version: int, features: Sequence[str] = FEATURES, column: Named = own_name) -> tuple[list[LossTerm], dict[str, float]]:
    """Named losses and the weights of their total."""
    if version == 3:
        pairs = tuple((column(f"regress_{k}"), _y(k)) for k in range(9))
        extra = tuple((column(f"pred_{c}"), c) for c in features)
        terms = [LossTerm("loss_rsq", (("r2", pairs),)), LossTerm("loss_mse", (("mse", pairs + extra),))]
        return terms, {"loss_rsq": 1.0, "loss_mse": 1e-4}
    scale = SCALE[version]
    if version in (9, 10):
        shrunk = tuple(
            (text.shrink_by_class(column(f"regress_{k}"), text.argmax_class(column(f"logits_{k}")), text.SHRINK_TRAIN), _y(k))
            for k in range(9)
        )
        terms = [
            LossTerm("loss_rsq", (("r2", shrunk),)),
            LossTerm("loss_mse", (("mse", _pairs("regress", range(9), 1.0, column)),)),
            LossTerm("loss_xen", (("xen", _classes(range(9), column)),)),
        ]
        return terms, {"loss_rsq": 1.0, "loss_mse": 1 / 2, "loss_xen": 1 / 4}

    mse_targets = range(3, 9) if version == 11 else range(9)
    slow = tuple((step_mean(k, column), _scaled(_y(k), scale)) for k in (3, 6))
    r5 = _steps(column("sma_3"), _fast_targets(5, version), scale)
    r8 = _steps(column("sma_6"), _fast_targets(8, version), scale)
    terms = [
        LossTerm("loss_rsq", (("r2", _pairs("regress", range(3, 9), scale, column)),), 1 / 6 if version == 12 else 1.0),
        LossTerm("loss_mse", (("mse", _pairs("regress", mse_targets, scale, column)),), scale),
        LossTerm("loss_xen", (("xen", _classes(range(3, 9), column)),)),
        LossTerm("loss_sma004_r5", (("mse", r5),), scale),
        LossTerm("loss_sma004_r8", (("mse", r8),), scale),
        LossTerm("loss_sma020_r3", (("mse", slow[:1]),), scale),
        LossTerm("loss_sma020_r6", (("mse", slow[1:]),), scale),
    ]
    total = {"loss_rsq": 1.0, "loss_mse": 1 / 2, "loss_xen": 1 / 4}
    sma = [t.name for t in terms[3:]] + ["loss_sma_rsq"]
    if version == 11:
        terms.append(LossTerm("loss_sma_rsq", (("r2", slow),)))
        return terms, total | {n: 1 / 5 for n in sma}

    gap = lambda i: f"({text.item(column('sma_3'), i)} - {text.item(column('sma_6'), i)})"
    r2 = tuple((gap(i), _scaled(t, scale)) for i, t in enumerate(_fast_targets(2, version)))
    r0 = ((f"({step_mean(3, column)} - {step_mean(6, column)})", _scaled(_y(0), scale)),)
    terms += [
        LossTerm("loss_sma004_r2", (("mse", r2),), scale),
        LossTerm("loss_sma020_r0", (("mse", r0),), scale),
    ]
    sma += ["loss_sma004_r2", "loss_sma020_r0"]
    if version == 13:
        terms.append(LossTerm("loss_sma_rsq", (("r2", slow), ("r2", r5), ("r2", r8)), 1 / 3))
        return terms, total | {n: 1 / 14 for n in sma}

    terms.append(LossTerm("loss_sma_rsq", (("r2", slow),), 1 / 2))
    wide = lambda prefix, k, sma_n: _steps(
        column(f"{prefix}_{k}"), [signed_lead_name(_y(k), i) for i in SIGNED_LEAD_STEPS[sma_n]], scale
    )
    terms += [
        LossTerm("loss_ll_mse004", tuple(("mse", wide("wide4", k, 4)) for k in (2, 5, 8)), scale / 3),
        LossTerm("loss_ll_mse020", tuple(("mse", wide("wide20", k, 20)) for k in (0, 3, 6)), scale / 3),
        LossTerm("loss_ll_rsq", tuple(("r2", wide("wide4", k, 4)) for k in (5, 8)), 1 / 2),
    ]
    extra = {n: 1 / 3 for n in ("loss_ll_mse004", "loss_ll_mse020", "loss_ll_rsq")}
    return terms, total | {n: 1 / 14 for n in sma} | extra


def composite_train_loss(df: DataFrame, version: int, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per named loss; version 3 also predicts ``features``, as columns ``pred_<feature>``."""
    terms, total = train_loss(version, features)
    return composite_loss(df, terms, total)


def heads(version: int, column: Named = own_name) -> dict[str, str]:
    """Unscaled predictions of responder 6 by head: direct, averaged steps, centre step."""
    unit = text.number(SCALE[version])
    out = {"": f"({column('regress_6')} * {unit})", "sma_": f"({step_mean(6, column)} * {unit})"}
    if version == 12:
        out["ll_"] = f"({text.item(column('wide20_6'), CENTRE_STEP)} * {unit})"
    return out


def head_test_loss(version: int, column: Named = own_name) -> LossSet:
    """R² loss of responder 6 for each head: raw, a tenth of it, and shrunk by predicted class."""
    factors = text.SHRINK_WIDE_TEST if version == 12 else text.SHRINK_PREDICT
    klass = text.argmax_class(column("logits_6"))
    terms = []
    for head, p in heads(version, column).items():
        for variant, q in (("raw", p), ("kelly", f"({p} * 0.1D)"), ("zerox", text.shrink_by_class(p, klass, factors))):
            terms.append(LossTerm(f"loss_{head}{variant}_rsq", (("r2", ((q, "responder_6"),)),)))
    return terms, {t.name: 1 / len(terms) for t in terms}


def pooled_test_loss(version: int, column: Named = own_name) -> LossSet:
    """Shrunk direct heads of the predicted responders pooled: all nine (versions 9 and 10), or 3 to 8 and besides the shrunk
    step means of 3 and 6 (version 11)."""
    unit = text.number(SCALE[version])
    gated = lambda p, k: (
        text.shrink_by_class(f"{p} * {unit}", text.argmax_class(column(f"logits_{k}")), text.SHRINK_PREDICT),
        _y(k),
    )
    direct = tuple(gated(column(f"regress_{k}"), k) for k in (range(3, 9) if version == 11 else range(9)))
    terms = [LossTerm("loss_rsq", (("r2", direct),))]
    if version == 11:
        terms.append(LossTerm("loss_sma_rsq", (("r2", tuple(gated(step_mean(k, column), k) for k in (3, 6))),)))
    return terms, {t.name: 1.0 for t in terms}


def test_loss(version: int, column: Named = own_name) -> LossSet:
    """Named test losses of a version with gated heads."""
    return pooled_test_loss(version, column) if version in (9, 10, 11) else head_test_loss(version, column)


def train_losses(df: DataFrame, columns: Mapping[int, Named], features: Sequence[str] = FEATURES) -> DataFrame:
    """Named training losses of all versions that ``columns`` gives outputs of, in one pass."""
    return version_losses(df, {v: train_loss(v, features, c) for v, c in columns.items()})


def train_losses_by_batch(df: DataFrame, columns: Mapping[int, Named], features: Sequence[str] = FEATURES, batch: Sequence[str] = ("date_id",)) -> DataFrame:
    """The same losses accumulated over batches."""
    return version_batch_losses(df, {v: train_loss(v, features, c) for v, c in columns.items()}, batch=batch)


def gated_r2_report(df: DataFrame, columns: Mapping[int, Named]) -> DataFrame:
    """Named test losses of all versions that ``columns`` gives outputs of, in one pass."""
    return version_losses(df, {v: test_loss(v, c) for v, c in columns.items()})
