"""Blocked work along long series gives what plain windows give."""

import random
from dataclasses import replace

import pytest
from helpers import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import features, lags, rolling
from tickloom.operators.quantiles import exact_quantiles
from tickloom.operators.series import SeriesLayout, cut_series, home_rows, join_sized, over_series, position_by_int, with_position
from tickloom.schema import LAG_STEPS

KEYS = ["date_id", "symbol_id", "time_id"]


@pytest.fixture(scope="module")
def gapped(spark):
    """One hot series with gaps next to short ones; key widths that force the blocked path."""
    rng = random.Random(5)
    data = []
    for date, symbol, n in ((0, 0, 900), (0, 1, 3), (1, 0, 40), (1, 2, 1)):
        for t in sorted(rng.sample(range(5000), n)):
            x = rng.choice([None, float("nan"), rng.random(), rng.random(), rng.random()])
            data.append((date, t, symbol, x, rng.random()))
    return spark.createDataFrame(
        data, "date_id int, time_id int, symbol_id int, feature_00 double, responder_6 double"
    ).persist()


@pytest.fixture(scope="module")
def short(gapped):
    return gapped.withColumn("time_id", F.col("time_id").cast("smallint"))


def same(a, b):
    x, y = rows(a, *KEYS), rows(b, *KEYS)
    norm = lambda r: tuple("nan" if v != v else v for v in r)
    assert [norm(r) for r in x] == [norm(r) for r in y]


@pytest.mark.parametrize("bits", [3, 6, 13])
@pytest.mark.parametrize("steps", [1, -1, 20, -20])
def test_shift_in_blocks_equals_plain_window(gapped, short, bits, steps):
    shifts = [("moved", "feature_00", steps)]
    blocked = features.shift_columns(gapped, shifts, SeriesLayout(block_bits=bits))
    plain = features.shift_columns(short, shifts)
    assert "__blk" in blocked._jdf.queryExecution().toString()
    same(blocked, plain.withColumn("time_id", F.col("time_id").cast("int")))


def test_shift_larger_than_a_block(gapped, short):
    shifts = [("back", "responder_6", 37), ("ahead", "responder_6", -37)]
    blocked = features.shift_columns(gapped, shifts, SeriesLayout(block_bits=2))
    same(blocked, features.shift_columns(short, shifts).withColumn("time_id", F.col("time_id").cast("int")))


@pytest.mark.parametrize("bits", [2, 5, 13])
def test_windows_on_windows_in_one_cut_equal_separate_passes(gapped, short, bits):
    ahead = lambda w: [f"avg(responder_6) OVER ({w} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS mean"]
    shifts = [("back", "mean", 5), ("front", "mean", -9)]
    null_order = gapped.limit(2).withColumn("time_id", F.lit(None).cast("int"))
    layout = SeriesLayout(block_bits=bits)
    for df in (gapped.unionByName(null_order), short):
        blocks = cut_series(df, before=5, after=9 + 6, layout=layout)
        inside = replace(layout, cut=True)
        once = home_rows(features.shift_columns(over_series(blocks, ahead, layout=inside), shifts, inside), inside)
        twice = features.shift_columns(over_series(df, ahead, after=6, layout=layout), shifts, layout)
        assert once.columns == twice.columns
        same(once.where("time_id IS NOT NULL"), twice.where("time_id IS NOT NULL"))
        assert once.count() == twice.count()


@pytest.mark.parametrize("bits", [3, 13])
def test_tail_rows_are_those_of_the_whole_lag_table(gapped, bits):
    rng = random.Random(6)
    data = [(d, t, s, rng.random()) for d, s, n in ((0, 0, 130), (1, 0, 90), (3, 0, 300), (0, 1, 2), (3, 1, 25), (None, 2, 4)) for t in sorted(rng.sample(range(n * 2), n))]
    df = gapped.sparkSession.createDataFrame([*data, (3, None, 0, 0.5)], "date_id smallint, time_id int, symbol_id int, responder_6 double")
    layout = SeriesLayout(block_bits=bits)
    steps = sorted({i for used in LAG_STEPS.values() for i in used})
    want = lags.lag_responder_table(df, ["responder_6"]).where(F.col("lag_time_id").isin(steps) & F.col("date_id").isNotNull())
    got = lags.lag_tail_table(df, layout, ["responder_6"]).where("date_id IS NOT NULL")
    assert got.dtypes == want.dtypes and want.count() > 50
    same(got, want)
    inside = replace(layout, cut=True)
    same(lags.lag_tail_table(cut_series(df, after=steps[-1], layout=layout), inside, ["responder_6"]).where("date_id IS NOT NULL"), want)


def test_rolling_in_blocks_equals_plain_window(gapped, short):
    blocked = rolling.rolling_mean_rows(gapped, "responder_6", 50, layout=SeriesLayout(block_bits=4))
    plain = rolling.rolling_mean_rows(short, "responder_6", 50).withColumn("time_id", F.col("time_id").cast("int"))
    rounded = lambda df: df.withColumn("rolling_mean", F.round("rolling_mean", 10))
    same(rounded(blocked), rounded(plain))


def test_dense_layout_needs_no_positions(gapped):
    w = Window.partitionBy("date_id", "symbol_id").orderBy("time_id")
    dense = gapped.withColumn("time_id", F.row_number().over(w) - 1)
    layout = SeriesLayout(dense=True, block_bits=4)
    same(
        features.lagged_features(dense, 3, ["responder_6"], layout),
        features.lagged_features(dense, 3, ["responder_6"]),
    )


def test_positions_are_exact_and_ordered(gapped):
    w = Window.partitionBy("date_id", "symbol_id").orderBy("time_id")
    placed = position_by_int(gapped, ["date_id", "symbol_id"], "time_id", "pos")
    assert placed.withColumn("rn", F.row_number().over(w) - 1).where("rn != pos").count() == 0
    fine = with_position(
        gapped, ["date_id"], ["symbol_id", "time_id"], F.col("symbol_id"), F.shiftright("time_id", 2), "pos"
    )
    w = Window.partitionBy("date_id").orderBy("symbol_id", "time_id")
    assert fine.withColumn("rn", F.row_number().over(w) - 1).where("rn != pos").count() == 0


def test_group_max_paths_agree(gapped, short):
    a = lags.group_max(gapped.select(*KEYS))
    b = lags.group_max(short.select(*KEYS)).withColumns(
        {"time_id": F.col("time_id").cast("int"), "last_time_id": F.col("last_time_id").cast("int")}
    )
    same(a, b)


def test_mean_paths_agree(gapped):
    wide = features.mean_features(gapped, ["feature_00"], dtype="double")
    narrow = gapped.withColumn("symbol_id", F.col("symbol_id").cast("smallint"))
    window = features.mean_features(narrow, ["feature_00"], dtype="double")
    pick = lambda df: df.select(F.col("symbol_id").cast("int").alias("symbol_id"), "date_id", "time_id", F.round("mean_feature_00", 10))
    same(pick(wide), pick(window))


def test_join_sized_broadcasts_by_estimate(spark, gapped, monkeypatch, tmp_path):
    gapped.groupBy("date_id").agg(F.max("time_id").alias("m")).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert "ResolvedHint" in join_sized(gapped, small, ["date_id"])._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr("tickloom.operators.series.BROADCAST_LIMIT", 0)
    assert "ResolvedHint" not in join_sized(gapped, small, ["date_id"])._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("rounds", [(16, 16, 16, 16), (8,) * 8, (4, 30, 30)])
def test_quantiles_split_a_crowded_cell(spark, rounds):
    """All values share their first digits; each round's window holds the cells of one digit only."""
    values = [1.0 + i * 2.0**-50 for i in range(3000)] + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.q: r.value for r in exact_quantiles(df, F.col("v"), [0.0, 0.3, 0.5, 1.0], rounds=rounds).collect()}
    want = df.where("not isnan(v)").agg(F.percentile("v", F.array(*[F.lit(q) for q in (0.0, 0.3, 0.5, 1.0)]))).first()[0]
    assert [got[q] for q in (0.0, 0.3, 0.5, 1.0)] == want
    signs = spark.createDataFrame([(x,) for x in (-0.0, 0.0, -1e300, 1e300, -5e-324, 5e-324, float("-inf"), float("inf"), -2.5)], "v double")
    assert {r.q: r.value for r in exact_quantiles(signs, F.col("v"), [0.0, 0.125, 0.25, 0.5, 1.0], rounds=rounds).collect()} == {
        0.0: float("-inf"), 0.125: -1e300, 0.25: -2.5, 0.5: 0.0, 1.0: float("inf")}


def test_quantiles_of_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g int, v double")
    assert {r.g: r.value for r in exact_quantiles(df, F.col("v"), [0.5], ["g"]).collect()} == {None: 2.0, 1: 5.0}


def test_exact_quantiles_match_percentile(gapped, spark):
    rng = random.Random(9)
    data = [(g, rng.choice([0.0, 1.0, rng.gauss(0, 1), rng.gauss(0, 1e6), -rng.random()])) for g in (0,) * 800 + (1,) * 5]
    df = spark.createDataFrame(data, "g int, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, F.col("v"), qs, ["g"]).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("p")).collect()
    for r in want:
        for q, p in zip(qs, r.p):
            assert got[(r.g, q)] == pytest.approx(p, abs=1e-9)
