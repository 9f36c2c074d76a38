"""Losses and scores as distributed aggregates. Inputs are expected zero-filled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators.quantiles import exact_quantiles

# (prediction, target), both SQL expressions over the table's columns.
Pair = tuple[str, str]

# Multipliers of the prediction tried by the scale sweep, and reported quantiles.
TEST_SCALES = (0.001, 0.003, 0.005, 0.01, 0.03, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 1.25, 1.5)
GATE_QUANTILES = (0.10, 0.25, 0.40)


def _squared_errors(pairs: Sequence[Pair]) -> str:
    return text.total([f"({y} - {p}) * ({y} - {p})" for p, y in pairs])


def r2_sums(pairs: Sequence[Pair], weight: str = "weight") -> tuple[str, str]:
    """Numerator and denominator of the weighted R² loss, all targets pooled."""
    squares = text.total([f"{y} * {y}" for _, y in pairs])
    return f"sum({weight} * {_squared_errors(pairs)})", f"sum({weight} * {squares})"


def r2_loss(pairs: Sequence[Pair], weight: str = "weight") -> Column:
    num, den = r2_sums(pairs, weight)
    return F.expr(f"try_divide({num}, {den})")


def weighted_r2_loss(
    df: DataFrame, pairs: Sequence[Pair], weight: str = "weight", by: Sequence[str] = ()
) -> DataFrame:
    """``Σw(y−p)² / Σwy²`` over all rows and targets, or per group; 0 is best, not mean-centred."""
    return df.groupBy(*by).agg(r2_loss(pairs, weight).alias("loss"), F.count(F.lit(1)).alias("n"))


def mse_loss(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    return df.agg(F.expr(f"avg({_squared_errors(pairs)}) / {len(pairs)} AS loss"))


def mae_loss(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    errors = text.total([f"abs({y} - {p})" for p, y in pairs])
    return df.agg(F.expr(f"avg({errors}) / {len(pairs)} AS loss"))


def pinball_loss(df: DataFrame, pair: Pair, quantiles: Sequence[float]) -> DataFrame:
    e = f"({pair[1]} - {pair[0]})"
    wide = df.agg(
        *[F.expr(f"avg(greatest({e} * {q}D, {e} * ({q}D - 1))) AS q{i}") for i, q in enumerate(quantiles)]
    )
    return _rows(wide, "quantile", [(text.number(q), f"q{i}") for i, q in enumerate(quantiles)])


def _rows(wide: DataFrame, label: str, cells: Sequence[tuple[str, str]], *keep: str) -> DataFrame:
    """One row per (label, loss) from a one-row table."""
    items = ", ".join(f"named_struct('{label}', {k}, 'loss', {v})" for k, v in cells)
    return wide.selectExpr(f"inline(array({items}))", *keep)


def r2_scale_sweep(
    df: DataFrame, pairs: Sequence[Pair], scales: Sequence[float] = TEST_SCALES, weight: str = "weight"
) -> DataFrame:
    """Loss of each multiple of the prediction, from three moments of a single pass."""
    moment = lambda parts, n: F.expr(f"sum({weight} * {text.total(parts)}) AS {n}")
    wide = df.agg(
        moment([f"{y} * {y}" for _, y in pairs], "yy"),
        moment([f"{y} * {p}" for p, y in pairs], "yp"),
        moment([f"{p} * {p}" for p, _ in pairs], "pp"),
    )
    cells = [(n, f"try_divide(yy - 2 * {n} * yp + {n} * {n} * pp, yy)") for n in map(text.number, scales)]
    return _rows(wide, "scale", cells, "try_divide(yp, pp) AS best_scale")


def batch_weighted_loss(
    df: DataFrame, pairs: Sequence[Pair], weight: str = "weight", batch: Sequence[str] = ("date_id",)
) -> DataFrame:
    """Mean of per-batch losses weighted by batch size; differs from the pooled loss.

    A batch without a loss (its targets weigh nothing) counts neither above nor below the line.
    """
    per_batch = weighted_r2_loss(df, pairs, weight, batch)
    return per_batch.agg(
        F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum(F.when(F.col("loss").isNotNull(), F.col("n")))).alias("loss"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("batches"),
    )


def weighted_cross_entropy(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Class-weighted, label-smoothed cross entropy over (logits, class) pairs."""
    parts = [text.cross_entropy_parts(a, k) for a, k in pairs]
    num, den = ([f"sum({p[i]})" for p in parts] for i in (0, 1))
    return df.agg(F.expr(f"try_divide({text.total(num)}, {text.total(den)}) AS loss"))


def grad_hess(df: DataFrame, prediction: str, target: str, weight: str = "weight") -> DataFrame:
    """Gradient and Hessian of the weighted R² with respect to each row's prediction."""
    w, y, p = F.col(weight), F.col(target), F.col(prediction)
    total = df.agg(F.sum(w * y * y).alias("t")).select("t").scalar()
    return df.select(
        "*", F.try_divide(2 * w * (y - p), total).alias("grad"), F.try_divide(-2 * w, total).alias("hess")
    )


def magnitude_quantiles(
    df: DataFrame, column: str, quantiles: Sequence[float] = GATE_QUANTILES
) -> DataFrame:
    """Exact quantiles of the absolute value."""
    return exact_quantiles(df, F.abs(F.col(column)), quantiles)


def class_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per magnitude class for each column; counts combine on the map side."""
    cells = ", ".join(f"named_struct('responder', '{c}', 'klass', {text.magnitude_class(c)})" for c in columns)
    return df.selectExpr(f"inline(array({cells}))").groupBy("responder", "klass").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class LossTerm:
    """A named loss: ``factor`` times the sum of its parts ``(kind, pairs)``.

    Kinds: ``mse`` and ``r2`` over (prediction, target) pairs, ``xen`` over (logits, class).
    """

    name: str
    parts: tuple[tuple[str, tuple[Pair, ...]], ...]
    factor: float = 1.0


# A version's terms and the weights of their total.
LossSet = tuple[Sequence[LossTerm], Mapping[str, float]]


def _row_parts(kind: str, pairs: Sequence[Pair], weight: str) -> tuple[str, str]:
    """What one row adds to a part's numerator and denominator."""
    if kind == "r2":
        return f"{weight} * {_squared_errors(pairs)}", f"{weight} * {text.total([f'{y} * {y}' for _, y in pairs])}"
    if kind == "mse":
        return _squared_errors(pairs), f"{len(pairs)}.0D"
    if kind == "xen":
        parts = [text.cross_entropy_parts(a, k) for a, k in pairs]
        return text.total([n for n, _ in parts]), text.total([d for _, d in parts])
    raise ValueError(f"unknown loss kind {kind}")


def _reduced(df: DataFrame, sets: Mapping, weight: str, by: Sequence[str]) -> tuple[DataFrame, str]:
    """Sums of all terms per group in one pass, and the SQL array of ``(version, name, loss)`` made from them.

    Below the aggregate each row is reduced to one number for every different numerator and denominator, so the aggregate sees
    few narrow columns whatever the number of heads, steps and versions, and stays within generated code. The row id keeps
    the optimizer from folding the numbers back into the aggregate.
    """
    numbers: dict[str, str] = {}

    def total_of(part: str) -> str:
        return f"sum_{numbers.setdefault(part, f'n{len(numbers)}')}"

    cells = []
    for version, (terms, weights) in sets.items():
        values = {}
        for term in terms:
            ratios = []
            for kind, pairs in term.parts:
                num, den = _row_parts(kind, pairs, weight)
                ratios.append(f"try_divide({total_of(num)}, {total_of(den)})")
            values[term.name] = f"({text.total(ratios)} * {text.number(term.factor)})"
        if weights:
            values["total"] = text.total([f"{values[n]} * {text.number(f)}" for n, f in weights.items()])
        cells += [f"named_struct('version', {version}, 'name', '{n}', 'loss', {v})" for n, v in values.items()]
    rows = df.selectExpr(*[text.name(c) for c in by], *[f"coalesce({e}, 0.0D) AS {n}" for e, n in numbers.items()], "monotonically_increasing_id() AS __row")
    sums = rows.groupBy(*by).agg(*[F.sum(n).alias(f"sum_{n}") for n in numbers.values()], F.count("__row").alias("n"))
    return sums, f"array({', '.join(cells)})"


def version_losses(df: DataFrame, sets: Mapping[int, LossSet], weight: str = "weight") -> DataFrame:
    """All named losses and the weighted total (where weights are given) of every version: ``version, name, loss``, from one pass over ``df``."""
    sums, cells = _reduced(df, sets, weight, ())
    return sums.selectExpr(f"inline({cells})")


def version_batch_losses(df: DataFrame, sets: Mapping[int, LossSet], weight: str = "weight", batch: Sequence[str] = ("date_id",)) -> DataFrame:
    """Every named loss as the mean over batches weighted by their sizes: ``version, name, loss, n, batches``.

    This is what accumulating per-batch losses gives; it differs from the pooled loss. A batch without a loss (its targets weigh
    nothing) counts neither above nor below the line. One pass and one shuffle of sums per batch.
    """
    sums, cells = _reduced(df, sets, weight, batch)
    per_batch = sums.selectExpr("n", f"inline({cells})")
    sized = F.sum(F.when(F.col("loss").isNotNull(), F.col("n")))
    return per_batch.groupBy("version", "name").agg(
        F.try_divide(F.sum(F.col("loss") * F.col("n")), sized).alias("loss"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("batches")
    )


def composite_loss(
    df: DataFrame, terms: Sequence[LossTerm], total: Mapping[str, float], weight: str = "weight"
) -> DataFrame:
    """All named losses and their weighted total from one aggregation; one row per loss."""
    return version_losses(df, {0: (terms, total)}, weight).drop("version")
