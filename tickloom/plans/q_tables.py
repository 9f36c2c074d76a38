"""Queries on sources, filters, unions, sorts and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import lags as lag_ops
from tickloom.operators import profiles, rolling, select
from tickloom.operators.sampling import online_sample
from tickloom.operators.series import BY_DAY_DENSE
from tickloom.plans.catalog import KEYS, PANEL, SLOTS, clean, query, rn, s, sn
from tickloom.schema import INDEX, RESPONDERS, served_test_columns
from tickloom.session import shared_dir
from tickloom.sources import panel as io
from tickloom.sources.fixtures import PANEL_FEATURES, panel, slot_panel

FEATURE_SQL = sn(*PANEL_FEATURES)
RESPONDER_SQL = sn(*RESPONDERS)


@query(
    "scan_panel",
    f"SELECT l_orderkey, l_linenumber, {sn('l_quantity', 'l_extendedprice')} FROM lineitem",
)
def _(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    return io.scan_panel(spark, f"{sf}/lineitem.parquet", columns=cols).select(*cols[:2], *rn(*cols[2:]))


@query("read_small_table", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(spark, sf):
    return io.read_small_table(spark, f"{sf}/supplier.parquet").select("s_suppkey", "s_nationkey")


@query("write_partitioned_cache", PANEL + f" SELECT {KEYS}, {RESPONDER_SQL} FROM P")
def _(spark, sf):
    df = panel(spark, sf).select(*INDEX, *RESPONDERS)
    return io.write_partitioned_cache(df, shared_dir(spark, "panel")).select(*INDEX, *rn(*RESPONDERS))


@query(
    "schema_contract",
    PANEL + " SELECT date_id, count(*) AS n_rows, CAST(0 AS INT) AS mismatches FROM P GROUP BY 1",
)
def _(spark, sf):
    served = io.served_test(panel(spark, sf, responders=False), PANEL_FEATURES)
    expected = served_test_columns(PANEL_FEATURES)
    wrong = io.schema_contract(served, expected).count()
    return (
        io.assert_contract(served, expected)
        .groupBy("date_id")
        .agg(F.count("row_id").alias("n_rows"))
        .withColumn("mismatches", F.lit(wrong).cast("int"))
    )


@query("drop_service_columns", PANEL + f" SELECT {KEYS}, weight + 0.0 AS weight FROM P")
def _(spark, sf):
    served = io.served_test(panel(spark, sf, responders=False), PANEL_FEATURES)
    return io.drop_service_columns(served).drop(*PANEL_FEATURES)


@query("column_families", PANEL + f" SELECT {KEYS}, {FEATURE_SQL}, {RESPONDER_SQL} FROM P")
def _(spark, sf):
    df = io.column_families(panel(spark, sf), features=PANEL_FEATURES)
    return df.select(*INDEX, *rn(*PANEL_FEATURES, *RESPONDERS))


@query("filter_date_from", PANEL + f" SELECT {KEYS}, {FEATURE_SQL} FROM P WHERE date_id >= 40")
def _(spark, sf):
    df = select.filter_date_from(panel(spark, sf, responders=False), 40)
    return df.select(*INDEX, *rn(*PANEL_FEATURES))


@query(
    "series_date_symbol",
    PANEL + f" SELECT {KEYS}, {sn('responder_6')} FROM P WHERE symbol_id = 3 AND date_id = 40 ORDER BY time_id",
)
def _(spark, sf):
    df = select.series_date_symbol(panel(spark, sf), "responder_6", 3, 40)
    return df.withColumns({"responder_6": rn("responder_6")[0]})


@query(
    "series_time_symbol",
    PANEL + f" SELECT {KEYS}, {sn('responder_6')} FROM P WHERE symbol_id = 3 AND time_id = 10 ORDER BY date_id",
)
def _(spark, sf):
    df = select.series_time_symbol(panel(spark, sf), "responder_6", 3, 10)
    return df.withColumns({"responder_6": rn("responder_6")[0]})


@query("distinct_sorted_dates", PANEL + " SELECT DISTINCT date_id FROM P ORDER BY 1")
def _(spark, sf):
    return select.distinct_sorted(panel(spark, sf, responders=False))


@query(
    "filter_in_dates",
    PANEL
    + f""" SELECT {KEYS}, {FEATURE_SQL} FROM P
    WHERE date_id IN (SELECT date_id FROM P WHERE symbol_id = 0 AND time_id >= 150)""",
)
def _(spark, sf):
    df = panel(spark, sf, responders=False)
    busy = df.where((F.col("symbol_id") == 0) & (F.col("time_id") >= 150)).select("date_id")
    return select.in_dates(df, busy).select(*INDEX, *rn(*PANEL_FEATURES))


@query(
    "date_slice_by_position",
    SLOTS
    + f""", D AS (SELECT date_id, row_number() OVER (ORDER BY date_id) - 1 AS p FROM (SELECT DISTINCT date_id FROM S))
    SELECT {KEYS}, {sn('feature_00')} FROM S WHERE date_id IN (SELECT date_id FROM D WHERE p BETWEEN 5 AND 12)""",
)
def _(spark, sf):
    return select.date_slice(slot_panel(spark, sf), 5, 12).select(*INDEX, *rn("feature_00"))


SAMPLED = "SELECT date_id FROM (SELECT DISTINCT date_id FROM {t}) ORDER BY md5(concat('{seed}:', CAST(date_id AS VARCHAR))), date_id LIMIT {n}"


@query(
    "sample_dates",
    PANEL + f" SELECT {KEYS}, {FEATURE_SQL} FROM P WHERE date_id IN ({SAMPLED.format(t='P', seed=7, n=12)})",
)
def _(spark, sf):
    return select.sample_by_dates(panel(spark, sf, responders=False), 12, 7).select(*INDEX, *rn(*PANEL_FEATURES))


# One row per index value t of the whole table at which the group's window (t-5, t] holds a row.
EXPANDING = """, T AS (SELECT DISTINCT time_id AS t FROM S),
X AS (SELECT S.date_id, S.symbol_id, T.t AS time_id, avg(S.feature_00) AS rolling_mean2,
             avg(S.feature_00) AS rolling_mean3, max(S.feature_01) AS top, count(*) AS n
      FROM S JOIN T ON S.time_id <= T.t AND S.time_id > T.t - 5 GROUP BY 1, 2, 3)"""
ROLLING = """, M AS (SELECT date_id, time_id, symbol_id, feature_00, avg(feature_00) OVER (
      PARTITION BY date_id, symbol_id ORDER BY time_id RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_mean FROM S)"""
COMPARED = SLOTS + EXPANDING + ROLLING + """,
C AS (SELECT date_id, time_id, symbol_id, feature_00, rolling_mean, rolling_mean2, rolling_mean3
      FROM M FULL OUTER JOIN X USING (date_id, time_id, symbol_id))"""
COMPARE_SQL = f"{KEYS}, {sn('feature_00', 'rolling_mean', 'rolling_mean2', 'rolling_mean3')}"
COMPARE_COLS = ["feature_00", "rolling_mean", "rolling_mean2", "rolling_mean3"]


def _compared(spark, sf):
    return rolling.rolling_compare(slot_panel(spark, sf), "feature_00", 5)


@query("edge_rows_or_null_key", COMPARED + f" SELECT {COMPARE_SQL} FROM C WHERE time_id < 5 OR time_id IS NULL")
def _(spark, sf):
    return select.edge_rows_or_null_key(_compared(spark, sf), "time_id", 5).select(*INDEX, *rn(*COMPARE_COLS))


@query("rolling_compare", COMPARED + f" SELECT {COMPARE_SQL} FROM C")
def _(spark, sf):
    return _compared(spark, sf).select(*INDEX, *rn(*COMPARE_COLS))


@query("full_outer_on_key", COMPARED + f" SELECT {KEYS}, {sn('rolling_mean', 'rolling_mean2')} FROM C")
def _(spark, sf):
    df = slot_panel(spark, sf)
    left = rolling.rolling_mean_rows(df, "feature_00", 5).select(*INDEX, "rolling_mean")
    right = rolling.expanding_window(
        df, 5, "time_id", ["date_id", "symbol_id"], named_aggs={"rolling_mean2": F.avg("feature_00")}
    )
    return select.full_outer_on_key(left, right, INDEX).select(*INDEX, *rn("rolling_mean", "rolling_mean2"))


@query("rolling_mean_rows", SLOTS + ROLLING + f" SELECT {KEYS}, {sn('rolling_mean')} FROM M")
def _(spark, sf):
    df = rolling.rolling_mean_rows(slot_panel(spark, sf), "feature_00", 5)
    return df.select(*INDEX, *rn("rolling_mean"))


@query("expanding_window", SLOTS + EXPANDING + f" SELECT {KEYS}, {sn('rolling_mean2', 'top')}, n FROM X")
def _(spark, sf):
    return rolling.expanding_window(
        slot_panel(spark, sf),
        5,
        "time_id",
        ["date_id", "symbol_id"],
        aggs=[F.avg("feature_00").alias("rolling_mean2"), F.max("feature_01").alias("top")],
        named_aggs={"n": F.count(F.lit(1))},
    ).select(*INDEX, *rn("rolling_mean2", "top"), "n")


@query(
    "semi_join_index",
    SLOTS
    + f""" SELECT {KEYS}, {sn('feature_00')} FROM S
    WHERE time_id IN (SELECT time_id FROM S WHERE date_id = 0 AND symbol_id = 1)""",
)
def _(spark, sf):
    df = slot_panel(spark, sf)
    other = df.where((F.col("date_id") == 0) & (F.col("symbol_id") == 1))
    return select.semi_join_index(df, other, "time_id").select(*INDEX, *rn("feature_00"))


@query(
    "rename_family",
    PANEL + f" SELECT {KEYS}, " + ", ".join(f'{s(c)} AS "{c}_lag_1"' for c in RESPONDERS) + " FROM P",
)
def _(spark, sf):
    df = select.rename_family(panel(spark, sf).select(*INDEX, *RESPONDERS), RESPONDERS, "_lag_1")
    return df.select(*INDEX, *rn(*[f"{c}_lag_1" for c in RESPONDERS]))


@query(
    "literal_columns",
    PANEL + " SELECT CAST(99 AS SMALLINT) AS date_id, time_id, symbol_id, true AS is_scored FROM P",
)
def _(spark, sf):
    df = panel(spark, sf, responders=False).select(*INDEX)
    return select.literal_columns(df, date_id=F.lit(99).cast("smallint"), is_scored=True)


@query(
    "row_index_per_batch",
    PANEL + f" SELECT {KEYS}, row_number() OVER (PARTITION BY date_id, time_id ORDER BY symbol_id) - 1 AS row_id FROM P",
)
def _(spark, sf):
    df = panel(spark, sf, responders=False).select(*INDEX)
    return select.row_index(df, ["date_id", "time_id"], "symbol_id")


@query(
    "union_relaxed",
    PANEL
    + """ SELECT CAST(date_id AS INT) AS date_id, time_id, symbol_id, weight + 0.0 AS weight FROM P
    UNION ALL SELECT CAST(date_id AS INT), time_id, symbol_id, CAST(CAST(weight AS INT) AS DOUBLE) FROM P WHERE date_id >= 40""",
)
def _(spark, sf):
    df = panel(spark, sf, responders=False).select(*INDEX, "weight")
    narrow = df.where("date_id >= 40").select(
        F.col("date_id").cast("int").alias("date_id"), "time_id", "symbol_id", F.col("weight").cast("int").alias("weight")
    )
    return select.union_relaxed(df, narrow)


@query("sort_by_index", PANEL + f" SELECT {KEYS}, {FEATURE_SQL} FROM P ORDER BY 1, 2, 3")
def _(spark, sf):
    df = panel(spark, sf, responders=False).select(*INDEX, *rn(*PANEL_FEATURES))
    return select.sort_by_index(df)


MEANS = ", ".join(f"avg({clean(c)}) OVER (PARTITION BY date_id, time_id) AS mean_{c}" for c in PANEL_FEATURES)


@query(
    "online_sample",
    PANEL
    + f""", LATEST AS (SELECT * FROM P WHERE date_id >= 80), TRAIN AS (SELECT * FROM P WHERE date_id < 60),
    TEST AS (SELECT * FROM P WHERE date_id >= 60 AND date_id < 80),
    PARTS AS (SELECT * FROM TRAIN WHERE date_id IN ({SAMPLED.format(t='TRAIN', seed=3407, n=10)})
      UNION ALL SELECT * FROM LATEST
      UNION ALL SELECT * FROM TEST WHERE date_id IN ({SAMPLED.format(t='TEST', seed=3407, n=4)})),
    G AS (SELECT *, {MEANS} FROM PARTS), LG AS (SELECT *, {MEANS} FROM LATEST),
    A AS (SELECT * FROM G UNION ALL SELECT * FROM LG)
    SELECT {KEYS}, {sn('weight', 'responder_6', *['mean_' + c for c in PANEL_FEATURES])} FROM A""",
)
def _(spark, sf):
    df = panel(spark, sf)
    sample = online_sample(
        6,
        train=df.where("date_id < 60"),
        test=df.where("date_id >= 60 AND date_id < 80"),
        latest=df.where("date_id >= 80"),
        n_train=10,
        n_test=4,
        features=PANEL_FEATURES,
        layout=BY_DAY_DENSE,
        dtype="double",
    )
    return sample.select(*INDEX, *rn("weight", "responder_6", *["mean_" + c for c in PANEL_FEATURES]))


@query(
    "flatten_targets",
    PANEL
    + " "
    + " UNION ALL ".join(
        f"SELECT {KEYS}, CAST({i} AS INT) AS responder_num, {s(c)} AS target FROM P" for i, c in enumerate(RESPONDERS)
    ),
)
def _(spark, sf):
    flat = select.flatten_targets(panel(spark, sf), RESPONDERS, INDEX)
    return flat.select(*INDEX, "responder_num", rn("target")[0])


# Previous dates of symbol 1 on S, common slots only.
CORRELATED = (
    SLOTS
    + """, D AS (SELECT date_id FROM (SELECT date_id, row_number() OVER (ORDER BY date_id) - 1 AS p
         FROM (SELECT DISTINCT date_id FROM S)) WHERE p >= 4),
    Z AS (SELECT a.date_id, a.feature_00 AS x0, b.feature_00 AS x1, c.feature_00 AS x2, d.feature_00 AS x3
      FROM S a JOIN S b ON b.date_id = a.date_id - 1 AND b.time_id = a.time_id AND b.symbol_id = a.symbol_id
      JOIN S c ON c.date_id = a.date_id - 2 AND c.time_id = a.time_id AND c.symbol_id = a.symbol_id
      JOIN S d ON d.date_id = a.date_id - 3 AND d.time_id = a.time_id AND d.symbol_id = a.symbol_id
      WHERE a.symbol_id = 1),
    K AS (SELECT date_id, covar_pop(x0, x1) / NULLIF(stddev_pop(x0) * stddev_pop(x1), 0) AS lag_1,
      covar_pop(x0, x2) / NULLIF(stddev_pop(x0) * stddev_pop(x2), 0) AS lag_2,
      covar_pop(x0, x3) / NULLIF(stddev_pop(x0) * stddev_pop(x3), 0) AS lag_3 FROM Z GROUP BY date_id),
    F AS (SELECT date_id, lag_1, lag_2, lag_3 FROM D LEFT JOIN K USING (date_id))"""
)


def _correlations(spark, sf):
    return profiles.lag_correlations(slot_panel(spark, sf), "feature_00", 1, 3)


@query("lag_correlations", CORRELATED + f" SELECT date_id, {sn('lag_1', 'lag_2', 'lag_3')} FROM F")
def _(spark, sf):
    return _correlations(spark, sf).select("date_id", *rn("lag_1", "lag_2", "lag_3"))


@query(
    "unpivot_correlations",
    CORRELATED
    + " "
    + " UNION ALL ".join(f"SELECT date_id, '{c}' AS variable, {s(c)} AS value FROM F" for c in ("lag_1", "lag_2", "lag_3")),
)
def _(spark, sf):
    rows = profiles.lag_correlation_rows(_correlations(spark, sf), ["lag_1", "lag_2", "lag_3"])
    return rows.select("date_id", "variable", rn("value")[0])


@query(
    "self_join_day_lags",
    SLOTS
    + f""" SELECT a.date_id, a.time_id, a.symbol_id, {s('a.feature_00')} AS feature_00_d0, {s('b.feature_00')} AS feature_00_d1,
      {s('c.feature_00')} AS feature_00_d2
      FROM S a JOIN S b ON b.date_id = a.date_id - 1 AND b.time_id = a.time_id AND b.symbol_id = a.symbol_id
      JOIN S c ON c.date_id = a.date_id - 2 AND c.time_id = a.time_id AND c.symbol_id = a.symbol_id""",
)
def _(spark, sf):
    df = lag_ops.self_join_day_lags(slot_panel(spark, sf), "feature_00", 2)
    return df.select(*INDEX, *rn("feature_00_d0", "feature_00_d1", "feature_00_d2"))


for _column, _by, _name in (
    ("responder_6", "time_id", "profile_over_dates"),
    ("responder_6", "date_id", "profile_over_times"),
):

    @query(
        _name,
        PANEL
        + f""" SELECT {_by}, {s(f'avg({_column})')} AS {_column}_mean, {s(f'stddev_samp({_column})')} AS {_column}_std
        FROM P WHERE symbol_id = 2 GROUP BY 1""",
    )
    def _(spark, sf, _column=_column, _name=_name, _by=_by):
        df = getattr(profiles, _name)(panel(spark, sf), _column, 2)
        return df.select(_by, *rn(f"{_column}_mean", f"{_column}_std"))


@query(
    "max_abs_scale",
    PANEL + f" SELECT {s('max(abs(m))')} AS scale FROM (SELECT avg(responder_6) AS m FROM P WHERE symbol_id = 2 GROUP BY date_id)",
)
def _(spark, sf):
    profile = profiles.profile_over_times(panel(spark, sf), "responder_6", 2)
    return profiles.max_abs_scale(profile, "responder_6").select(rn("scale")[0])
