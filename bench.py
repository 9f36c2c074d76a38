"""Time the headline queries and print one JSON line.

``rows_per_sec`` is given for queries over the whole panel only.

The panel is derived from the supplied tables and written once as a date-partitioned table, the
form in which a panel is read in use; that is timed as ``prepare_panel`` and not part of
``value``. Every query then runs three times over the whole panel into a no-op sink; the fastest
run counts, and building the DataFrame is part of it.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.plans import load_all  # noqa: E402
from tickloom.session import build_session, shared_dir  # noqa: E402
from tickloom.sources import fixtures  # noqa: E402

HEADLINE = [
    "mean_features",
    "lagged_features",
    "responder_signed_leads",
    "lag_responder_table",
    "cached_lag_table",
    "write_partitioned_cache",
    "attach_prev_day_lags",
    "forward_sma",
    "expanding_window",
    "lag_correlations",
    "r2_scale_sweep",
    "composite_loss",
    "online_sample",
    "score_batches",
    "fit_weighted_linear",
]
# These do not go over every panel row: two run on the hourly slots of `events`, one on sampled dates.
NOT_WHOLE_PANEL = {"expanding_window", "lag_correlations", "online_sample"}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffle_bytes(spark, first: int) -> tuple[int, int]:
    """Shuffle bytes written by stages from number ``first`` on, and the next stage number."""
    store = spark.sparkContext._jsc.sc().statusStore()
    total, n, missing = 0, first, 0
    while missing < 50:
        try:
            total += store.lastStageAttempt(n).shuffleWriteBytes()
            missing = 0
        except Exception:  # skipped stage or end of list
            missing += 1
        n += 1
    return total, n - missing


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores=cpus, shuffle_partitions=int(cpus))
    queries, _ = load_all()

    t0 = time.time()
    panel = fixtures.stage_panel(spark, sf_dir, shared_dir(spark, "bench-panel"))
    prepare = time.time() - t0
    rows = panel.count()

    seconds, shuffled = {}, {}
    _, stage = shuffle_bytes(spark, 0)
    for name in names:
        best = None
        for _ in range(3):
            t0 = time.time()
            run(queries[name](spark, sf_dir))
            best = min(best or 1e9, time.time() - t0)
            shuffled[name], stage = shuffle_bytes(spark, stage)
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": {n: int(rows / s) for n, s in seconds.items() if n not in NOT_WHOLE_PANEL},
                "shuffle_bytes": shuffled,
                "panel_rows": rows,
                "prepare_panel": round(prepare, 3),
                "cpus": int(cpus),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
