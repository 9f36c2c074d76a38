"""Exact quantiles without gathering a group's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import join_sized

#: Bits of a value that each round looks at, from the top. No task ranks more than two to the power of one round.
ROUNDS = (16, 16, 16, 16)


def _ordered_bits(v: Column) -> Column:
    """A long that sorts as the double does."""
    # Adding zero makes minus zero plain zero.
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def exact_quantiles(
    df: DataFrame, value: Column, qs: Sequence[float], group: Sequence[str] = (), rounds: Sequence[int] = ROUNDS
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group: columns ``q`` and ``value``. NaN and null are left out.

    A distributed selection by the digits of a value's 64 bits: a round counts the next digit of the values that share the
    digits found so far, with map-side combine, and running counts tell in which cell each wanted rank lies. However many
    values fall into one cell, the next round splits it by the next digit; a window never holds more cells than a digit has
    values. Each round reads the column once, and only values below a wanted cell are counted.
    """
    if sum(rounds) != 64:
        raise ValueError("the rounds must cover 64 bits")
    group = list(group)
    v = value.cast("double")
    # A struct equals another one whose fields are null in the same places.
    key = F.struct(*group) if group else F.lit(0)
    data = df.select(key.alias("__g"), v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v")).withColumn("__k", _ordered_bits(F.col("__v")))
    left = 64 - rounds[0]
    cells = data.groupBy("__g", F.shiftright("__k", left).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy("__g")
    ranked = cells.withColumns({"__lo": _before(whole.orderBy("__p")), "__total": F.sum("__n").over(whole)})
    wanted = ranked.withColumn("__t", F.explode(F.array(*[rank for q in qs for rank in _ranks(q)]))).select(
        "__g", "__p", "__lo", "__n", "__t.q", "__t.side", "__t.frac", "__t.rank"
    )
    targets = _hits(wanted)
    for i, bits in enumerate(rounds[1:], start=2):
        left -= bits
        last = i == len(rounds)
        parents = targets.select("__g", "__p").distinct()
        under = data.withColumn("__p", F.shiftright("__k", left + bits))
        if group:
            near = join_sized(under, parents, ["__g", "__p"], "left_semi")
        else:
            near = under.join(F.broadcast(parents), ["__g", "__p"], "left_semi")  # two cells for each quantile at most
        # In the last round a cell is one value.
        extra = [F.max("__v").alias("__v")] if last else []
        cells = near.groupBy("__g", "__p", F.shiftright("__k", left).alias("__c")).agg(F.count(F.lit(1)).alias("__n"), *extra)
        ranked = cells.withColumn("__lo", _before(Window.partitionBy("__g", "__p").orderBy("__c")))
        targets = _hits(ranked.join(targets, ["__g", "__p"]).drop("__p").withColumnRenamed("__c", "__p"))
    low = F.max(F.when(F.col("side") == 0, F.col("__v")))
    high = F.max(F.when(F.col("side") == 1, F.col("__v")))
    # Between equal values nothing is interpolated: infinity less itself is no number.
    found = targets.groupBy("__g", "q").agg(F.when(low == high, low).otherwise(low + (high - low) * F.max("frac")).alias("value"))
    return found.select(*[F.col(f"__g.`{c}`").alias(c) for c in group], "q", "value")


def _before(ordered: Window) -> Column:
    """Values in the cells before this one."""
    return F.coalesce(F.sum("__n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _ranks(q: float) -> list[Column]:
    """The two ranks that a quantile lies between."""
    h = F.lit(float(q)) * (F.col("__total") - 1)
    return [
        F.struct(F.lit(float(q)).alias("q"), F.lit(side).alias("side"), rank.cast("bigint").alias("rank"), (h - F.floor(h)).alias("frac"))
        for side, rank in ((0, F.floor(h)), (1, F.ceil(h)))
    ]


def _hits(ranked: DataFrame) -> DataFrame:
    """Cells that hold a wanted rank, which is counted from the start of the cell from here on."""
    hit = ranked.where((F.col("rank") >= F.col("__lo")) & (F.col("rank") < F.col("__lo") + F.col("__n")))
    return hit.withColumn("rank", F.col("rank") - F.col("__lo")).drop("__lo", "__n")
