"""Shape of physical plans: shuffles, joins, pruning."""

import re

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from tickloom.operators import features, lags, select
from tickloom.operators.series import BY_DAY_DENSE
from tickloom.plans import load_all
from tickloom.schema import INDEX, LAG_STEPS, RESPONDERS
from tickloom.sources.fixtures import PANEL_FEATURES
from tickloom.sources.panel import scan_panel, write_bucketed_cache, write_partitioned_cache


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan(df)))


@pytest.fixture(scope="module")
def stored(spark, small_panel, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    return write_partitioned_cache(small_panel, path)


def test_means_take_one_shuffle(stored):
    assert shuffles(features.mean_features(stored, PANEL_FEATURES)) == 1


def test_all_shifts_share_one_shuffle_and_sort(stored):
    df = features.responder_wide_targets(stored, BY_DAY_DENSE)
    assert shuffles(df) == 1 and plan(df).count("+- Sort") == 1


@pytest.mark.parametrize("name", ["responder_signed_leads", "responder_lags_intraday"])
def test_responders_and_their_shifts_share_one_shuffle(spark, name):
    text = plan(load_all()[0][name](spark, SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*__blk", text)) == 1


def jobs(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_tails_come_from_the_clustered_table_without_moving_it(spark, stored, tmp_path):
    table = lags.clustered_lag_responders(stored, str(tmp_path / "lags"), buckets=4)
    again = lags.clustered_lag_responders(stored, str(tmp_path / "lags"), buckets=4)
    assert again.inputFiles() == table.inputFiles()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small enough for a broadcast
    try:
        before = jobs(spark)
        df = lags.attach_prev_day_lags(stored.select(*INDEX), table)
        text = plan(df).splitlines()
        assert jobs(spark) == before  # nothing runs while the query is built
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scan = next(i for i, line in enumerate(text) if "Bucketed: true" in line)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in text]
    above, at = [], depth[scan]
    for i in range(scan - 1, -1, -1):
        if depth[i] < at:
            above.append(text[i])
            at = depth[i]
    assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)
    want = lags.attach_prev_day_lags(stored.select(*INDEX), lags.lag_responder_table(stored))
    assert df.exceptAll(want).isEmpty() and df.count() == want.count()


def test_only_rows_of_tails_are_written(spark):
    from tickloom.plans.q_windows import written_lags

    table = written_lags(spark, SMALL)
    assert table.where(f"lag_time_id > {max(LAG_STEPS[120])}").isEmpty()
    assert table.count() < 6000 and lags.lag_tail_pivot(table).count() == table.select("date_id", "symbol_id").distinct().count()


def test_versions_are_made_in_the_blocks_of_the_panel(spark):
    text = plan(load_all()[0]["feature_set_registry"](spark, SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*__blk", text)) == 1 and not re.search(r"Exchange hashpartitioning\(date_id#\d+, time_id", text)


def test_compared_versions_write_only_what_they_read(spark, tmp_path, monkeypatch):
    from tickloom.operators import models
    from tickloom.plans import q_models
    from tickloom.plans.registry import FEATURE_SETS, build_shared, project
    from tickloom.sources.fixtures import panel

    monkeypatch.setattr(q_models, "shared_dir", lambda spark, label: str(tmp_path / label))
    monkeypatch.setattr(models, "compare_specs", lambda built, *_: built)
    built = load_all()[0]["compare_specs"](spark, SMALL)
    assert len(spark.read.parquet(str(tmp_path / "compared-specs")).columns) == 17
    versions = (2, 6, 12, 13)
    shared = build_shared(panel(spark, SMALL), versions, q_models.written_lags(spark, SMALL), PANEL_FEATURES, BY_DAY_DENSE, dtype="double")
    for v in (6, 12):
        table, inputs = built[f"v{v:02d}"]
        cols = ["date_id", *inputs, "responder_6"]
        want, got = (df.select(*[F.round(c, 9).alias(c) for c in cols]) for df in (project(shared, v, versions, PANEL_FEATURES), table))
        assert inputs == FEATURE_SETS[v].inputs(PANEL_FEATURES)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_epochs_read_their_dates_of_a_written_panel(spark, monkeypatch):
    from tickloom.plans import q_streams

    seen = {}
    monkeypatch.setattr(q_streams.st, "staged", lambda df, label: (spark, "in", "work"))
    monkeypatch.setattr(q_streams.st, "read_staged", lambda *_: None)
    monkeypatch.setattr(q_streams.st, "online_samples", lambda *_, train, test, **__: seen.update(train=train, test=test) or spark.range(1).selectExpr("1 AS epoch", "1 AS date_id"))
    load_all()[0]["stream_online_sample"](spark, SMALL)
    for df in seen.values():
        assert not df.isEmpty() and all("online-panel" in f and "date_id=" in f for f in df.inputFiles())
        assert "Exchange" not in plan(df)


def test_small_tails_leave_the_rows_where_they_are(stored, tmp_path):
    table = lags.clustered_lag_tails(stored, str(tmp_path / "tails"), BY_DAY_DENSE, buckets=4)
    limit = stored.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    stored.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(lags.attach_prev_day_lags(stored.select(*INDEX), table))
    finally:
        stored.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert re.search(r"BroadcastHashJoin.*LeftOuter", text) and "SortMergeJoin" not in text


def test_a_table_of_the_same_clustering_is_not_moved_either(spark, stored, tmp_path):
    table = lags.clustered_lag_responders(stored, str(tmp_path / "lags"), buckets=4)
    rows = write_bucketed_cache(stored.select(*INDEX), str(tmp_path / "rows"), ["date_id", "symbol_id"], list(INDEX), 4)
    tails = lags.lag_tail_pivot(table).withColumnsRenamed({"date_id": "d", "symbol_id": "s"})
    assert shuffles(rows.join(tails, (F.col("date_id") == F.col("d")) & (F.col("symbol_id") == F.col("s")), "left")) == 0


def test_group_statistics_run_no_job_while_the_query_is_built(spark, stored):
    before = jobs(spark)
    lags.lag_responder_table(stored)
    features.mean_features(stored, PANEL_FEATURES)
    assert jobs(spark) == before


def test_losses_of_all_versions_take_one_scan_and_one_series_shuffle(spark, stored):
    from tickloom.plans import losses
    from tickloom.plans.q_metrics import _COLUMNS, TRAIN_VERSIONS, _trained
    from tickloom.sources import fixtures

    key = (spark.sparkContext.applicationId, "stored")
    fixtures._staged[key] = (stored.inputFiles()[0].rsplit("/date_id=", 1)[0], stored.schema)
    try:
        df = losses.train_losses(_trained(spark, "stored"), {v: _COLUMNS[v] for v in TRAIN_VERSIONS}, PANEL_FEATURES)
        text = plan(df)
    finally:
        del fixtures._staged[key]
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1


def test_date_list_is_a_broadcast_semi_join(stored):
    df = select.in_dates(stored, stored.where("symbol_id = 1").select("date_id"))
    assert re.search(r"BroadcastHashJoin.*LeftSemi", plan(df))


def test_filters_and_columns_reach_the_scan(stored):
    df = select.filter_date_from(stored, 40).select("date_id", "time_id", "responder_6")
    text = plan(df)
    assert re.search(r"PartitionFilters: \[[^\]]*date_id[^\]]*>= 40", text)
    assert re.search(r"ReadSchema: struct<time_id:int,responder_6:double>", text)
    one = select.series_date_symbol(stored, "responder_6", 3, 40)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(symbol_id,3\)", plan(one))


def test_series_filter_goes_below_the_window(stored):
    lagged = features.lagged_features(stored, 1, ["feature_00"], BY_DAY_DENSE).where("date_id = 3")
    assert re.search(r"PartitionFilters: \[[^\]]*date_id[^\]]*= 3", plan(lagged))


def test_flattening_does_not_shuffle(stored):
    assert shuffles(select.flatten_targets(stored, RESPONDERS, INDEX)) == 0


def test_scan_keeps_partition_type(spark, stored):
    assert dict(stored.dtypes)["date_id"] == "smallint"
    path = stored.inputFiles()[0].rsplit("/date_id=", 1)[0]
    assert scan_panel(spark, path, stored.schema, ["date_id", "weight"]).columns == ["date_id", "weight"]
    assert stored.groupBy().agg(F.count("*")).first()[0] == 6000
