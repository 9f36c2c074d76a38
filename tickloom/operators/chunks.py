"""Supervised pairs of past and future chunks along a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators.series import with_position


def chunk_windows(
    df: DataFrame,
    column: str | Sequence[str],
    n_in: int,
    n_out: int,
    group: Sequence[str] = ("symbol_id",),
    stride: int = 1,
    block_bits: int = 13,
) -> DataFrame:
    """The last ``n_in`` and the next ``n_out`` values of each row's series, full chunks only.

    A series runs over dates and slots; a new chunk starts every ``stride`` rows. One column comes out as ``past`` and
    ``future``; a list of columns shares the sort and the gathering, and comes out as ``past_<column>`` and ``future_<column>``.

    Starts are chosen first. Rows that no chunk reads are left out, the others are gathered into sorted blocks, each with
    the few rows that its last chunks reach into the next, and every start cuts its own range out of its block: what is
    gathered per chunk is the chunk.
    """
    columns = [column] if isinstance(column, str) else list(column)
    out = {c: "" if isinstance(column, str) else f"_{c}" for c in columns}
    size = n_in + n_out
    step = min(stride, size)
    placed = with_position(
        df.select("date_id", "time_id", *group, *columns),
        group,
        ["date_id", "time_id"],
        F.col("date_id"),
        F.shiftright("time_id", 10),
        "position",
    )
    # Rows that chunks read, numbered without the gaps between chunks.
    if stride > size:
        wanted = placed.where(F.expr(f"position % {stride} < {size}")).withColumn("__q", F.expr(f"position DIV {stride} * {size} + position % {stride}"))
    else:
        wanted = placed.where("position IS NOT NULL").withColumn("__q", F.col("position"))
    reach = f"shiftright(greatest(__q - {size - 1}, 0), {block_bits})"
    copies = wanted.select("*", F.expr(f"explode(sequence({reach}, shiftright(__q, {block_bits})))").alias("__b"))
    item = F.struct("__q", "position", "date_id", "time_id", *columns)
    # A group key may be null, which groupBy takes as a group.
    blocks = copies.groupBy(*group, "__b").agg(F.sort_array(F.collect_list(item)).alias("__rows"))
    first = f"shiftleft(__b, {block_bits})"
    low = f"(({first} + {step - 1}) DIV {step} * {step})"
    high = f"least({first} + {(1 << block_bits) - 1}, get(__rows, size(__rows) - 1).__q - {size - 1})"
    starts = blocks.select("*", F.expr(f"explode(CASE WHEN {low} <= {high} THEN sequence({low}, {high}, {step}L) ELSE array() END)").alias("__s"))
    at = f"CAST(__s - {first} AS INT)"
    chunks = starts.selectExpr(
        *[f"`{c}`" for c in group], f"get(__rows, {at} + {n_in - 1}) AS __row", f"slice(__rows, {at} + 1, {n_in}) AS past", f"slice(__rows, {at} + {n_in + 1}, {n_out}) AS future"
    )
    cells = [F.col(side)[c].alias(f"{side}{out[c]}") for c in columns for side in ("past", "future")]
    return chunks.select("__row.date_id", "__row.time_id", *group, "__row.position", *cells)


def instance_normalize(df: DataFrame, column: str = "past", eps: float = 1e-5) -> DataFrame:
    """Normalise each chunk by its own mean and deviation, both kept for the way back."""
    squares = f"aggregate({column}, 0.0D, (acc, x) -> acc + (x - mu) * (x - mu))"
    return (
        df.withColumn("mu", F.expr(text.array_mean(column)))
        .withColumn("sd", F.expr(f"sqrt({squares} / size({column}) + {text.number(eps)})"))
        .withColumn(f"{column}_normal", F.expr(f"transform({column}, x -> (x - mu) / sd)"))
    )


def denormalize(values: Column, mu: Column, sd: Column) -> Column:
    return F.transform(values, lambda x: x * sd + mu)
