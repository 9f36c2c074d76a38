"""Small hand-made cases for the rules that are easy to get wrong."""

import math

import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import arrays, scalars
from tickloom.operators import chunks, features, lags, metrics, models, nulls, profiles, rolling, select
from tickloom.operators.nulls import FEATURE_FILLS, Fill
from tickloom.plans.registry import FEATURE_SETS, build, model_matrix
from tickloom.sources import panel as io

NAN = float("nan")
SHORT = "date_id smallint, time_id smallint, symbol_id smallint"


def test_mean_skips_nan_and_null(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 1.0), (0, 0, 1, NAN), (0, 0, 2, None), (0, 0, 3, 3.0), (0, 1, 0, NAN), (0, 1, 1, None)],
        f"{SHORT}, feature_00 double",
    )
    out = features.mean_features(df, ["feature_00"])
    assert dict(out.dtypes)["mean_feature_00"] == "float"
    got = {(r.time_id, r.symbol_id): r.mean_feature_00 for r in out.collect()}
    assert got[(0, 1)] == 2.0 and got[(0, 2)] == 2.0 and got[(1, 0)] is None


def test_lag_counts_rows_and_keeps_nan(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 5, 0, NAN), (0, 6, 0, 3.0)], f"{SHORT}, feature_00 double")
    got = [r[-1] for r in rows(features.lagged_features(df, 1, ["feature_00"]), "time_id")]
    assert got[0] is None and got[1] == 1.0 and math.isnan(got[2])


def test_previous_available_date_differs_from_calendar_date(spark):
    data = [(0, 0, 0, 1.0), (2, 0, 0, 2.0), (3, 0, 0, 3.0)]  # no date 1
    df = spark.createDataFrame(data, f"{SHORT}, responder_0 double")
    shifted = lags.lag_responder_table(df, ["responder_0"])
    assert [r.responder_0_shift_1 for r in shifted.orderBy("date_id").collect()] == [None, 1.0, 2.0]
    served = io.served_lags(df, ["responder_0"])
    assert [(r.date_id, r.responder_0_lag_1) for r in served.collect()] == [(3, 2.0)]


def test_served_lags_need_slot_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (1, 3, 0, 2.0)], f"{SHORT}, responder_0 double")
    assert io.served_lags(df, ["responder_0"]).count() == 0


def test_countdown_ends_at_one(spark):
    df = spark.createDataFrame([(0, t, s) for s, n in ((0, 4), (1, 2)) for t in range(n)], SHORT)
    got = {(r.symbol_id, r.time_id): r.lag_time_id for r in lags.lag_time_countdown(df).collect()}
    assert got == {(0, 0): 4, (0, 1): 3, (0, 2): 2, (0, 3): 1, (1, 0): 2, (1, 1): 1}


def test_expanding_window_fills_slots_of_other_groups(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 1.0), (0, 1, 1, 5.0), (0, 2, 1, 7.0), (0, 9, 1, 9.0)], f"{SHORT}, x double"
    )
    out = rolling.expanding_window(df, 3, "time_id", ["date_id", "symbol_id"], named_aggs={"m": F.avg("x")})
    assert dict(out.dtypes)["time_id"] == "smallint"
    got = {(r.symbol_id, r.time_id): r.m for r in out.collect()}
    # Symbol 0 has results at slots 1 and 2, which only symbol 1 has; slots 3, 4 exist nowhere.
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 1.0, (1, 1): 5.0, (1, 2): 6.0, (1, 9): 9.0}
    with pytest.raises(ValueError):
        rolling.expanding_window(df, 3, "time_id", ["date_id"])


def test_magnitude_bounds_belong_to_the_lower_class(spark):
    values = [0.0, 0.06, 0.0601, 0.15, -0.16, 0.26, -0.27, NAN, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, y double")
    got = [r[1] for r in rows(df.select("i", scalars.magnitude_class("y").alias("k")), "i")]
    assert got == [0, 0, 1, 1, 2, 2, 3, 0, None]


def test_shrink_leaves_the_top_class(spark):
    df = spark.createDataFrame([(k, 2.0) for k in range(4)], "k int, p double")
    out = df.select("k", scalars.shrink_by_class("p", "k", scalars.SHRINK_TRAIN).alias("v"))
    assert [r[1] for r in rows(out, "k")] == [0.2, 0.5, 1.0, 2.0]


def test_argmax_takes_the_first_of_a_tie(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],)], "a array<double>")
    assert df.select(arrays.argmax_class("a")).first()[0] == 1
    p = df.select(arrays.softmax("a").alias("p")).first().p
    assert sum(p) == pytest.approx(1.0) and p[1] == p[2]


def test_synthetic_is_null_outside_its_domain(spark):
    df = spark.createDataFrame([(0.1, 0.05), (-1.0, 0.0), (0.0, -2.0)], "a double, b double")
    got = [r[0] for r in df.select(scalars.synthetic_responder("a", "b", 1.0)).collect()]
    assert got[0] == pytest.approx(1.1 / 1.05 - 1) and got[1] is None and got[2] is None


def test_cross_entropy_matches_the_formula(spark):
    logits, klass = [[0.3, -1.0, 2.0, 0.1], [1.0, 1.0, 0.0, -3.0]], [2, 0]
    df = spark.createDataFrame(list(zip(logits, klass)), "a array<double>, k int")
    w, eps = [0.55, 0.22, 0.14, 0.09], 0.05
    num = den = 0.0
    for a, k in zip(logits, klass):
        lse = math.log(sum(math.exp(x) for x in a))
        nll = [lse - x for x in a]
        num += (1 - eps) * w[k] * nll[k] + eps / 4 * sum(wi * n for wi, n in zip(w, nll))
        den += w[k]
    assert metrics.weighted_cross_entropy(df, [("a", "k")]).first().loss == pytest.approx(num / den)


def test_fill_policies(spark):
    df = spark.createDataFrame(
        [(0, 1.0), (0, 3.0), (0, None), (0, 11.0), (1, NAN), (1, 10.0)], "g int, v double"
    ).select("g", *[F.col("v").alias(c) for c in "zmdab"])
    policy = {"z": Fill(), "m": Fill("mean"), "d": Fill("median"),
              "a": Fill("mean", grouped=True), "b": Fill("median", grouped=True)}
    out = nulls.fill_by_strategy(df, policy, ["g"]).toPandas()
    zero_group = out[(out.g == 0) & (out.z == 0.0)].iloc[0]
    one_group = out[(out.g == 1) & (out.z == 0.0)].iloc[0]
    assert (zero_group.m, zero_group.d, zero_group.a, zero_group.b) == (6.25, 6.5, 5.0, 3.0)
    assert (one_group.a, one_group.b) == (10.0, 10.0)
    assert not out.isna().any().any()


def test_fill_map_is_total():
    assert sorted(FEATURE_FILLS) == schema.FEATURES[:40]


def test_group_of_one_and_constant_series(spark):
    df = spark.createDataFrame(
        [(d, t, 0, 1.0 if d < 3 else float(t * d)) for d in range(6) for t in range(4)], f"{SHORT}, x double"
    )
    out = profiles.lag_correlations(df, "x", 0, lag=1, skip=0)
    got = {r.date_id: r.lag_1 for r in out.collect()}
    assert got[0] is None and got[1] is None and got[3] is None  # no day before; constant series
    assert got[4] == pytest.approx(1.0)
    one = df.where("date_id = 0 AND time_id = 0")
    assert profiles.profile_over_dates(one, "x", 0).first().x_std is None


def test_lag_correlation_skips_one_more_date_than_needed(spark):
    df = spark.createDataFrame([(d, t, 0, float(t + d)) for d in range(8) for t in range(3)], f"{SHORT}, x double")
    assert [r.date_id for r in profiles.lag_correlations(df, "x", 0, lag=3).collect()] == [4, 5, 6, 7]


def test_chunks_keep_nulls_and_honour_stride(spark):
    df = spark.createDataFrame([(0, t, 0, None if t == 1 else float(t)) for t in range(7)], "date_id smallint, time_id int, symbol_id smallint, x double")
    got = rows(chunks.chunk_windows(df, "x", 3, 2).select("position", "past", "future"), "position")
    assert got == [
        (2, [0.0, None, 2.0], [3.0, 4.0]),
        (3, [None, 2.0, 3.0], [4.0, 5.0]),
        (4, [2.0, 3.0, 4.0], [5.0, 6.0]),
    ]
    assert [r[0] for r in rows(chunks.chunk_windows(df, "x", 3, 2, stride=2).select("position"), "position")] == [2, 4]


def test_chunks_of_several_columns_are_the_chunks_of_each(spark):
    df = spark.createDataFrame([(0, t, 0, None if t == 1 else float(t), -float(t)) for t in range(9)], "date_id smallint, time_id int, symbol_id smallint, x double, y double")
    both = chunks.chunk_windows(df, ["x", "y"], 3, 2, stride=2)
    assert both.columns == ["date_id", "time_id", "symbol_id", "position", "past_x", "future_x", "past_y", "future_y"]
    for c in ("x", "y"):
        one = chunks.chunk_windows(df, c, 3, 2, stride=2).select("position", "past", "future")
        assert rows(both.select("position", f"past_{c}", f"future_{c}"), "position") == rows(one, "position")


def test_date_slice_counts_positions(spark):
    df = spark.createDataFrame([(d, 0, 0) for d in (3, 7, 8, 20)], SHORT)
    assert [r.date_id for r in select.date_slice(df, 1, 2).orderBy("date_id").collect()] == [7, 8]
    wide = df.withColumn("date_id", F.col("date_id").cast("int"))
    assert [r.date_id for r in select.date_slice(wide, 1, 2).orderBy("date_id").collect()] == [7, 8]


def test_contract_and_service_columns(spark):
    df = spark.createDataFrame([(1, True, 2)], "row_id int, is_scored boolean, x int")
    assert io.drop_service_columns(df).columns == ["x"]
    assert io.schema_contract(df, df.columns).count() == 0
    wrong = io.schema_contract(df, ["row_id", "x", "is_scored"]).collect()
    assert [r.position for r in wrong] == [1, 2]
    with pytest.raises(ValueError):
        io.assert_contract(df, ["x"])


def test_cache_is_written_once_and_rewritten_after_a_failed_write(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "date_id smallint, x double")
    path = str(tmp_path / "cache")
    first = io.write_partitioned_cache(df, path)
    assert dict(first.dtypes)["date_id"] == "smallint" and first.count() == 2
    assert io.write_partitioned_cache(df.where("x > 1"), path).count() == 2
    half = tmp_path / "half"
    (half / "date_id=0").mkdir(parents=True)
    (half / "date_id=0" / "junk.parquet").write_bytes(b"not parquet")
    assert io.write_partitioned_cache(df, str(half)).count() == 2


def test_cache_leaves_foreign_folders_alone(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0)], "date_id smallint, x double")
    (tmp_path / "notes.txt").write_text("keep")
    with pytest.raises(FileExistsError):
        io.write_partitioned_cache(df, str(tmp_path))
    with pytest.raises(FileExistsError):
        io.write_partitioned_cache(df, str(tmp_path / "notes.txt"))
    assert (tmp_path / "notes.txt").read_text() == "keep"


def test_union_keeps_duplicates_and_widens(spark):
    a = spark.createDataFrame([(1, 2)], "x smallint, y int")
    b = spark.createDataFrame([(2.5, 1)], "y double, x int")
    out = select.union_relaxed(a, b, b)
    assert out.count() == 3 and dict(out.dtypes) == {"x": "int", "y": "double"}


def test_target_block_offsets():
    names = FEATURE_SETS[12].targets()
    assert names[:9] == schema.RESPONDERS and len(names) == 174
    at = lambda r, k: [i for i, _ in schema.target_block(names, r, k)]
    assert at("responder_2", "lead") == list(range(9, 14)) and at("responder_8", "lead") == list(range(19, 24))
    assert at("responder_2", "lead_v2") == list(range(24, 53)) and at("responder_8", "lead_v2") == list(range(82, 111))
    assert at("responder_0", "lead_v2") == list(range(111, 132)) and at("responder_6", "lead_v2") == list(range(153, 174))


@pytest.mark.parametrize(
    "version, n_x, n_y",
    [(1, 82, 1), (2, 82, 9), (3, 82, 88), (6, 161, 9), (9, 161, 9), (11, 251, 21), (12, 330, 174), (13, 240, 21), (21, 82, 9)],
)
def test_column_counts(version, n_x, n_y):
    assert len(FEATURE_SETS[version].inputs()) == n_x and len(FEATURE_SETS[version].targets()) == n_y


def test_full_width_panel_builds(spark):
    """All 79 features with smallint keys, for the widest set."""
    data = [(d, t, s) for d in range(2) for t in range(3) for s in range(2)]
    df = spark.createDataFrame(data, SHORT).select(
        "*",
        F.lit(1.0).cast("float").alias("weight"),
        *[F.col("time_id").cast("float").alias(c) for c in schema.FEATURES],
        *[(F.col("date_id") * 10 + F.col("time_id")).cast("float").alias(c) for c in schema.RESPONDERS],
    )
    out = build(df, 12, lags.lag_responder_table(df))
    assert len(out.columns) == 1 + 330 + 174 and out.count() == 12
    row = out.where("date_id = 1 AND time_id = 0 AND symbol_id = 0").first()
    assert row["responder_0_lag_1"] == 2.0 and row["responder_0_lag_3"] == 0.0 and row["responder_2_lead_v2_-4"] == 0.0
    served = model_matrix(df.drop(*schema.RESPONDERS), schema.FEATURES[:3], schema.RESPONDERS)
    assert served.columns == ["X", "w"]


def test_empty_latest_and_batch_limit(spark):
    from tickloom.operators.sampling import online_sample

    df = spark.createDataFrame([(d, 0, 0, float(d)) for d in range(5)], f"{SHORT}, feature_00 double")
    assert online_sample(2, df, None, None, 3, 0).count() == 3
    assert online_sample(2, df, df, df.where("date_id > 9"), 3, 2).count() == 5
    sizes = []

    def predictor(batch: pd.DataFrame) -> pd.DataFrame:
        assert len(batch) <= 2
        return pd.DataFrame({"predict": batch["feature_00"] * 2})

    out = models.score_batches(df, predictor, ["feature_00"], ["predict"], batch_size=2)
    assert sorted(r.predict for r in out.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0] and sizes == []


def test_attach_by_key_ignores_row_order(spark):
    a = spark.createDataFrame([(0, t, 0, float(t)) for t in range(4)], f"{SHORT}, x double")
    b = a.orderBy(F.desc("time_id")).withColumn("y", F.col("x") * 2).drop("x")
    assert all(r.y == 2 * r.x for r in select.attach_by_key(a, b, ["y"]).collect())


def test_package_functions_travel_with_tasks():
    from pyspark import cloudpickle

    assert "tickloom" in cloudpickle.list_registry_pickle_by_value()
    assert b"tickloom.operators.models\x94\x8c\x06_solve" not in cloudpickle.dumps(models._solve)


class FakeSession:
    def __init__(self, master, folder):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder or default)})


def test_shared_folder_follows_the_session():
    from tickloom.session import shared_dir

    a, b = (shared_dir(FakeSession("yarn", "hdfs:///shared/"), "x") for _ in range(2))
    assert a.startswith("hdfs:///shared/x-") and a != b
    assert "tickloom-" in shared_dir(FakeSession("local[2]", None), "x")
    with pytest.raises(ValueError):
        shared_dir(FakeSession("yarn", None), "x")


@pytest.mark.parametrize("newest_first", [False, True])
def test_streamed_lag_takes_order_from_the_data(spark, tmp_path, newest_first):
    """A series that spans micro-batches, with gaps in its slots, nulls beside NaN, and files in either order."""
    from tickloom.streaming import replay as st

    data = [(0, t, 0, None if t == 3 else float("nan") if t == 8 else float(t)) for t in (0, 2, 3, 7, 8, 20, 21, 22)] + [(1, t, 0, float(t)) for t in (0, 5)]
    df = spark.createDataFrame(data, "date_id smallint, time_id int, symbol_id smallint, feature_00 double")
    src = st.stage_stream(df, str(tmp_path / "in"), files=4, newest_first=newest_first)
    out = st.intraday_lag(st.read_staged(spark, src, batches=5), str(tmp_path / "work"), ["feature_00"], dates_late=5)
    want = rows(features.lagged_features(df, 1, ["feature_00"]).drop("feature_00"), "date_id", "time_id")
    assert str(rows(out, "date_id", "time_id")) == str(want)


def test_late_rows_come_out_beside_the_kept(spark, tmp_path):
    from tickloom.streaming import replay as st

    schema = "date_id int, time_id int, symbol_id int, x double"
    sent = [
        [(0, 0, 1, 1.0), (0, 0, 1, 0.5), (3, 0, 1, 2.0)],  # a copy at once: the smaller row stays
        [(0, 0, 2, 9.0), (2, 1, 1, 4.0), (3, 0, 1, 2.5), (5, 0, 1, 3.0)],  # behind the watermark, on time, known
        [(3, 0, 1, 7.0), (4, 1, 1, 5.0)],
    ]
    for part in sent:
        st.deliver(spark.createDataFrame(part, schema), str(tmp_path / "in"))
        stream = st.read_deliveries(spark, str(tmp_path / "in"), st.with_event_time(spark.createDataFrame(part, schema)).schema)
        kept, late = st.dedup_with_late(stream, str(tmp_path / "work"))
    assert sorted(r.x for r in kept.collect()) == [0.5, 2.0, 3.0, 4.0, 5.0]
    assert sorted(r.x for r in late.collect()) == [7.0, 9.0]


@pytest.mark.parametrize("batches", [1, 2, 8])
def test_online_epochs_do_not_depend_on_batches(spark, tmp_path, batches):
    from tickloom.streaming import replay as st

    df = spark.createDataFrame([(d, t, s, 1.0, float(d + t)) for d in range(9) for t in range(3) for s in range(2)], "date_id smallint, time_id int, symbol_id smallint, weight double, feature_00 double")
    src = st.stage_stream(df.where("date_id >= 6"), str(tmp_path / "in"), files=8)
    out = st.online_samples(
        st.read_staged(spark, src, batches), str(tmp_path / "work"), 1, df.where("date_id < 4"), df.where("date_id IN (4, 5)"), 2, 1, ["feature_00"], columns=["date_id", "time_id"]
    )
    counts = {}
    for r in out.groupBy("epoch", "date_id").count().collect():
        counts.setdefault(r.epoch, {})[r.date_id] = r["count"]
    assert set(counts) == {6, 7, 8}
    for epoch, got in counts.items():
        assert got.pop(epoch) == 12 and set(got.values()) == {6} and len(got) == 3 and sum(d < 4 for d in got) == 2


@pytest.mark.parametrize("stride", [1, 2, 5, 7])
def test_chunks_cut_from_blocks(spark, stride):
    df = spark.createDataFrame([(d, t, s, float(100 * d + t)) for s in (0, 1) for d in range(3) for t in range(15 + s)], "date_id smallint, time_id int, symbol_id smallint, x double")
    got = {(r.symbol_id, r.position): (r.past, r.future) for r in chunks.chunk_windows(df, "x", 3, 2, stride=stride, block_bits=3).collect()}
    want = {}
    for s in (0, 1):
        x = [float(100 * d + t) for d in range(3) for t in range(15 + s)]
        want |= {(s, i + 2): (x[i : i + 3], x[i + 3 : i + 5]) for i in range(0, len(x) - 4, stride)}
    assert got == want


def test_named_losses_by_batch(spark):
    """Means of per-batch ratios weighted by rows; a batch whose targets weigh nothing is left out."""
    df = spark.createDataFrame([(0, 1.0, 1.0, 2.0), (0, 1.0, 0.0, 1.0), (1, 2.0, 3.0, 3.0), (2, 0.0, 1.0, 5.0)], "date_id int, weight double, p double, y double")
    sets = {7: ([metrics.LossTerm("a", (("r2", (("p", "y"),)),)), metrics.LossTerm("b", (("mse", (("p", "y"),)),), 2.0)], {"a": 1.0, "b": 0.5})}
    got = {r.name: (r.loss, r.n, r.batches) for r in metrics.version_batch_losses(df, sets).collect()}
    assert got["a"] == (pytest.approx((2 / 5 * 2 + 0 * 1) / 3), 4, 3)
    assert got["b"] == (pytest.approx(2 * (1 * 2 + 0 + 16) / 4), 4, 3)
    pooled = {r.name: r.loss for r in metrics.version_losses(df, sets).collect()}
    assert pooled["a"] == pytest.approx(2 / 23) and pooled["total"] == pytest.approx(2 / 23 + 0.5 * 2 * 18 / 4)


def test_stream_rows_without_a_place_on_the_clock_stop_the_job(spark, tmp_path):
    from tickloom.streaming.replay import stage_stream

    for k, row in enumerate([(0, 1 << 22, 1), (1 << 20, 0, 1), (None, 0, 1), (0, None, 1)]):
        with pytest.raises(Exception, match="no place on the clock"):
            stage_stream(spark.createDataFrame([row], "date_id int, time_id int, symbol_id int"), str(tmp_path / f"s{k}"), files=1)


@pytest.mark.parametrize("batches", [2, 8])
def test_streams_keep_late_slots_far_dates_and_any_symbol(spark, tmp_path, batches):
    from tickloom.streaming import replay as st

    rows = [(d, t, s, float(d + t + s)) for d in (0, 1, 2, 40_000) for t in (3_600, 90_000, 90_001) for s in (-1, 4)]
    df = spark.createDataFrame(rows, "date_id int, time_id int, symbol_id int, x double")
    src = st.stage_stream(df, str(tmp_path / "in"), files=8)
    read = lambda: st.read_staged(spark, src, batches)
    value = {r[:3]: r[3] for r in rows}
    out = st.run_to_table(st.dedup(read()), str(tmp_path / "dedup")).collect()
    assert sorted((r.date_id, r.time_id, r.symbol_id) for r in out) == sorted(value)
    out = st.run_to_table(st.prev_day_lags(read(), read(), ["x"]), str(tmp_path / "lag")).collect()
    assert len(out) == len(rows)
    assert all(r.x_lag_1 == value.get((r.date_id - 1, r.time_id, r.symbol_id)) for r in out)
    out = st.run_to_table(st.cross_section_means(read(), ["x"]), str(tmp_path / "mean")).collect()
    assert {(r.date_id, r.time_id): r.mean_x for r in out} == {(d, t): d + t + 1.5 for d, t, _ in value}
    out = st.run_to_table(st.rolling_means(read(), "x", 2), str(tmp_path / "roll")).collect()
    got = {(r.date_id, r.time_id, r.symbol_id): r.rolling_mean for r in out}
    assert all(got[k] == (v + value.get((k[0], k[1] - 1, k[2]), v)) / 2 for k, v in value.items())


@pytest.mark.parametrize("kind", ["smallint", "int"])
def test_rows_with_null_keys_stay(spark, kind):
    from tickloom.operators.features import lagged_features
    from tickloom.operators.rolling import rolling_mean_rows
    from tickloom.operators.select import row_index
    from tickloom.operators.series import BY_DAY, attach_group_stats

    rows = [(0, 0, 1, 1.0), (0, 1, 1, 2.0), (0, None, 1, 9.0), (0, 0, None, 5.0), (0, 1, None, 7.0), (None, 0, 1, 3.0)]
    df = spark.createDataFrame(rows, f"date_id {kind}, time_id {kind}, symbol_id {kind}, x double")
    got = {tuple(r[:3]): r[4] for r in lagged_features(df, 1, ["x"], BY_DAY).select("date_id", "time_id", "symbol_id", "x", "x_lag_1").collect()}
    assert got == {(0, 0, 1): None, (0, 1, 1): 1.0, (0, None, 1): None, (0, 0, None): None, (0, 1, None): 5.0, (None, 0, 1): None}
    assert rolling_mean_rows(df, "x", 2).count() == len(rows)
    ids = {tuple(r[:3]): r.row_id for r in row_index(df, ["date_id", "symbol_id"], "time_id").collect()}
    assert ids == {(0, 0, 1): 0, (0, 1, 1): 1, (0, None, 1): None, (0, 0, None): 0, (0, 1, None): 1, (None, 0, 1): 0}
    best = {tuple(r[:3]): r.best for r in attach_group_stats(df, ["date_id", "symbol_id"], [F.max("x").alias("best")]).collect()}
    assert best[(0, 0, None)] == 7.0 and best[(None, 0, 1)] == 3.0 and len(best) == len(rows)


def test_day_lags_in_one_shuffle(spark):
    from tickloom.operators.lags import self_join_day_lags

    df = spark.createDataFrame([(d, 0, 1, None if d == 2 else float(d)) for d in (0, 1, 2, 4)], "date_id smallint, time_id int, symbol_id smallint, x double")
    out = self_join_day_lags(df, "x", 1)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.date_id, r.x_d0, r.x_d1) for r in out.collect()) == [(1, 1.0, 0.0), (2, None, 1.0)]
    assert out.schema["date_id"].dataType == df.schema["date_id"].dataType



def test_batch_without_loss_is_left_out(spark):
    from tickloom.operators.metrics import batch_weighted_loss

    df = spark.createDataFrame([(0, 1.0, 2.0, 1.0), (1, 1.0, 0.0, 1.0)], "date_id int, weight double, y double, p double")
    assert batch_weighted_loss(df, [("p", "y")]).first().loss == pytest.approx(0.25)
