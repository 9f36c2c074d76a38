"""Panels derived from the supplied tables; the shapes the operators are used on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.functions import text
from tickloom.operators.series import BY_DAY_CUT, BY_DAY_DENSE, SeriesLayout, cut_series, over_series, with_position
from tickloom.schema import RESPONDERS
from tickloom.sources.panel import scan_panel, write_partitioned_cache

PANEL_FEATURES = [f"feature_{i:02d}" for i in range(4)]
# Price and quantity scales of the two signals, class centres of the made logits.
PRICE_SCALE = 52500.0
QUANTITY_SCALE = 25.5
CLASS_CENTRES = (0.03, 0.105, 0.205, 0.4)
# Rows of the longest forward average.
LONGEST = 120

_staged: dict[tuple[str, str], tuple[str, StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, weight and features from ``lineitem``; ``time_id`` counts rows of each (month, symbol).

    ``date_id`` and ``symbol_id`` are smallint, which bounds cross sections and day lists by
    type. ``time_id`` is an int and grows with the data, so series are handled in blocks.
    """
    staged = _scan_staged(spark, sf_dir)
    if staged is not None:
        return staged.select("date_id", "time_id", "symbol_id", "weight", *PANEL_FEATURES, "sig_b")
    li = table(spark, sf_dir, "lineitem")
    keyed = li.select(
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("smallint").alias("date_id"),
        (F.col("l_suppkey") % 5).cast("smallint").alias("symbol_id"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("feature_01"),
        F.when((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "R"), F.lit(float("nan")))
        .otherwise(F.col("l_tax"))
        .alias("feature_02"),
    )
    # The date orders the cells already.
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    placed = with_position(
        keyed, ["date_id", "symbol_id"], order, F.col("l_shipdate"), F.shiftright("l_orderkey", 20), "__t"
    )
    # What follows from price and quantity is made behind the shuffle, which carries these two.
    return placed.select(
        "date_id",
        F.col("__t").cast("int").alias("time_id"),
        "symbol_id",
        F.col("l_quantity").alias("weight"),
        (F.col("l_extendedprice") / 1000.0).alias("feature_00"),
        "feature_01",
        "feature_02",
        ((F.col("l_extendedprice") - PRICE_SCALE) / PRICE_SCALE).alias("feature_03"),
        ((F.col("l_quantity") - QUANTITY_SCALE) / QUANTITY_SCALE).alias("sig_b"),
    )


def panel(spark: SparkSession, sf_dir: str, responders: bool = True) -> DataFrame:
    """The dense panel. Responders are forward averages over 4, 20 and 120 rows of two signals."""
    staged = _scan_staged(spark, sf_dir)
    if staged is not None:
        cols = ["date_id", "time_id", "symbol_id", "weight", *PANEL_FEATURES, *(RESPONDERS if responders else [])]
        return staged.select(*cols)
    base = base_panel(spark, sf_dir)
    if not responders:
        return base.drop("sig_b")
    return _with_responders(base).drop("sig_b")


def cut_panel(spark: SparkSession, sf_dir: str, before: int = 0, after: int = 0, together: Sequence[str] = ()) -> DataFrame:
    """The panel in blocks (layout ``BY_DAY_CUT``) whose rows and copies within ``before`` and ``after`` rows have their responders,
    so that windows on responders share the shuffle and the sort that make these."""
    staged = _scan_staged(spark, sf_dir)
    if staged is not None:
        return cut_series(panel(spark, sf_dir), before=before, after=after, layout=BY_DAY_DENSE, together=together)
    blocks = cut_series(base_panel(spark, sf_dir), before=before, after=after + LONGEST - 1, layout=BY_DAY_DENSE, together=together)
    return _with_responders(blocks, BY_DAY_CUT).drop("sig_b")


def _with_responders(base: DataFrame, layout: SeriesLayout = BY_DAY_DENSE) -> DataFrame:
    def forward_means(w):
        return [
            f"avg({c}) OVER ({w} ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS __{p}{k}"
            for k in (4, 20, LONGEST)
            for p, c in (("a", "feature_03"), ("b", "sig_b"))
        ]

    means = over_series(base, forward_means, after=LONGEST - 1, layout=layout)
    responder = {}
    for i, k in enumerate((20, LONGEST, 4)):
        responder |= {i: f"__a{k} - __b{k}", i + 3: f"__a{k}", i + 6: f"__b{k}"}
    return means.selectExpr(*base.columns, *[f"{responder[i]} AS responder_{i}" for i in range(9)])


def settled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with responders rounded to 9 digits, for steps that compare with a threshold."""
    df = panel(spark, sf_dir)
    return df.selectExpr(*[f"round({c}, 9) AS {c}" if c in RESPONDERS else c for c in df.columns])


def stage_panel(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Write the panel once as a table partitioned by date; later calls in this session scan it."""
    df = _with_responders(base_panel(spark, sf_dir))
    write_partitioned_cache(df, path)
    _staged[(spark.sparkContext.applicationId, sf_dir)] = (path, df.schema)
    return panel(spark, sf_dir)


def _scan_staged(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    found = _staged.get((spark.sparkContext.applicationId, sf_dir))
    return scan_panel(spark, *found) if found else None


def slot_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapped panel of hourly slots from ``events``; all keys are smallint."""
    ev = table(spark, sf_dir, "events")
    return (
        ev.select(
            F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("smallint").alias("date_id"),
            F.hour("ts").cast("smallint").alias("time_id"),
            (F.col("user_id") % 5).cast("smallint").alias("symbol_id"),
            "value",
        )
        .groupBy("date_id", "time_id", "symbol_id")
        .agg(
            F.count(F.lit(1)).cast("double").alias("weight"),
            F.avg("value").alias("feature_00"),
            F.max("value").alias("feature_01"),
        )
    )


def predictions(df: DataFrame) -> DataFrame:
    """Nine never-perfect predictions next to the panel's responders."""
    return df.selectExpr("*", *[f"0.6D * {c} + 0.1D * feature_03 AS pred_{i}" for i, c in enumerate(RESPONDERS)])


def model_outputs(df: DataFrame, scale: float, suffix: str = "") -> DataFrame:
    """Columns a multi-head network would return for each row, in units of ``1/scale``, with ``suffix`` in their names.

    ``regress_k`` (k 0..8), ``logits_k`` (4 classes), ``sma_3``/``sma_6`` (5 steps),
    ``wide4_k`` (29 steps), ``wide20_k`` (21 steps).
    """
    n = text.number
    cols = [f"(0.6D * {c} + 0.1D * feature_03) / {n(scale)} AS regress_{i}{suffix}" for i, c in enumerate(RESPONDERS)]
    for k in range(9):
        near = [f"2.0D - 8.0D * abs(abs(responder_{k} * 0.9D + 0.02D) - {n(c)})" for c in CLASS_CENTRES]
        cols.append(f"array({', '.join(near)}) AS logits_{k}{suffix}")
    for head, fast in ((3, "responder_5"), (6, "responder_8")):
        steps = [f"(0.5D * {fast} + 0.1D * feature_03 + {n(0.01 * i)}) / {n(scale)}" for i in range(5)]
        cols.append(f"array({', '.join(steps)}) AS sma_{head}{suffix}")
    for count, gap, heads, name in ((29, 0.002, (2, 5, 8), "wide4"), (21, 0.003, (0, 3, 6), "wide20")):
        for k in heads:
            steps = [f"(0.5D * responder_{k} + {n(gap * i)}) / {n(scale)}" for i in range(count)]
            cols.append(f"array({', '.join(steps)}) AS {name}_{k}{suffix}")
    return df.selectExpr("*", *cols)


def logit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class logits and step blocks from ``embeddings``."""
    e = F.col("embedding")
    piece = lambda a, b: F.transform(F.slice(e, a, b - a + 1), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("label") % 4).cast("int").alias("cls"),
        F.transform(piece(1, 4), lambda x: x * 8.0).alias("logits"),
        piece(5, 9).alias("steps_a"),
        piece(10, 14).alias("steps_b"),
        piece(15, 35).alias("block21"),
        F.get(e, F.lit(35)).cast("double").alias("y"),
        (1.0 + F.col("label")).cast("double").alias("w"),
    )
