"""SQL text of the panel's scalar expressions.

Wide steps build hundreds of columns. Composing text and parsing it once per column keeps the
driver's share small; the Column functions in ``scalars`` and ``arrays`` parse the same text.
"""

from __future__ import annotations

from collections.abc import Sequence

# Upper bounds of the magnitude classes, and factors per predicted class.
MAGNITUDE_BOUNDS = (0.06, 0.15, 0.26)
SHRINK_TRAIN = (0.10, 0.25, 0.50)
SHRINK_PREDICT = (0.0, 0.25, 0.50)
SHRINK_WIDE_TEST = (0.01, 0.10, 0.25)
# Class weights and label smoothing of the magnitude classifier.
CLASS_WEIGHTS = (0.55, 0.22, 0.14, 0.09)
LABEL_SMOOTHING = 0.05


def name(column: str) -> str:
    """A column name that may hold a minus sign."""
    return f"`{column}`"


def number(value: float) -> str:
    return f"{float(value)!r}D"


def total(parts: Sequence[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def nan_to_null(x: str) -> str:
    return f"nanvl({x}, CAST(NULL AS DOUBLE))"


def magnitude_class(x: str, bounds: Sequence[float] = MAGNITUDE_BOUNDS) -> str:
    """Class of |x|: 0 up to and including the first bound, then 1, 2, …; NaN counts as zero."""
    cases = " ".join(f"WHEN abs({x}) > {number(b)} THEN {i}" for i, b in reversed(list(enumerate(bounds, start=1))))
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 0 {cases} ELSE 0 END)"


def shrink_by_class(p: str, klass: str, factors: Sequence[float]) -> str:
    """``p`` times the factor of its class; classes past the table stay as they are."""
    cases = " ".join(f"WHEN {i} THEN {number(f)}" for i, f in enumerate(factors))
    return f"(({p}) * CASE {klass} {cases} ELSE 1.0D END)"


def blend(parts: Sequence[tuple[str, float]]) -> str:
    return total([f"({p}) * {number(w)}" for p, w in parts])


def synthetic_responder(a: str, b: str, scale: float) -> str:
    """Difference of two log returns, back as a return. Null where a return is −100 % or worse."""
    x, y = f"({a}) / {number(scale)}", f"({b}) / {number(scale)}"
    return f"(CASE WHEN {x} > -1 AND {y} > -1 THEN expm1(log1p({x}) - log1p({y})) * {number(scale)} END)"


def argmax_class(logits: str) -> str:
    return f"CAST(array_position({logits}, array_max({logits})) - 1 AS INT)"


def item(array: str, index: int | str) -> str:
    """0-based entry, null past the end."""
    return f"get({array}, {index})"


def array_sum(array: str) -> str:
    return f"aggregate({array}, 0.0D, (acc, x) -> acc + x)"


def array_mean(array: str) -> str:
    return f"({array_sum(array)} / nullif(size({array}), 0))"


def cross_entropy_parts(
    logits: str, klass: str, class_weights: Sequence[float] = CLASS_WEIGHTS, smoothing: float = LABEL_SMOOTHING
) -> tuple[str, str]:
    """Per-row numerator and denominator of the class-weighted, smoothed cross entropy."""
    n = len(class_weights)
    entries = [item(logits, i) for i in range(n)]
    top = f"array_max({logits})"
    lse = f"({top} + ln({total([f'exp({e} - {top})' for e in entries])}))"
    weight = f"(CASE {klass} " + " ".join(f"WHEN {i} THEN {number(w)}" for i, w in enumerate(class_weights)) + " END)"
    share = smoothing / n
    scale = f"({number(1 - smoothing)} * {weight} + {number(share * sum(class_weights))})"
    spread = total([f"{number(share * w)} * {e}" for w, e in zip(class_weights, entries)])
    return f"({lse} * {scale} - {number(1 - smoothing)} * {weight} * {item(logits, klass)} - {spread})", weight
