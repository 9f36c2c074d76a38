"""Identities between operators, on the derived panel."""

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from tickloom.operators import features, lags, metrics, models, rolling
from tickloom.operators.sampling import online_sample
from tickloom.operators.series import BY_DAY_DENSE
from tickloom.functions.scalars import zero_fill
from tickloom.schema import INDEX, RESPONDERS
from tickloom.sources.fixtures import PANEL_FEATURES, predictions, slot_panel

R6 = [("pred_6", "responder_6")]


def test_pivot_join_equals_single_joins(small_panel):
    table = lags.lag_responder_table(small_panel).persist()
    wide = lags.attach_prev_day_lags(small_panel.select(*INDEX), table)
    for column, step in (("responder_2", 4), ("responder_0", 7), ("responder_1", 21)):
        one = table.where(F.col("lag_time_id") == step).select(
            "date_id", "symbol_id", F.col(f"{column}_shift_1").alias("want")
        )
        joined = wide.join(one, ["date_id", "symbol_id"], "left")
        assert joined.where(f"NOT ({column}_lag_{step} <=> want)").count() == 0
    assert wide.count() == small_panel.count()


def test_sweep_equals_direct_losses(small_panel):
    q = predictions(small_panel)
    for r in metrics.r2_scale_sweep(q, R6, (0.3, 1.0, 1.5)).collect():
        direct = metrics.weighted_r2_loss(q, [(f"{r.scale}D * pred_6", "responder_6")]).first().loss
        assert r.loss == pytest.approx(direct)


def test_one_batch_equals_pooled(small_panel):
    q = predictions(small_panel)
    pooled = metrics.weighted_r2_loss(q, R6).first().loss
    assert metrics.batch_weighted_loss(q.withColumn("b", F.lit(1)), R6, batch=["b"]).first().loss == pytest.approx(pooled)
    assert metrics.batch_weighted_loss(q, R6).first().loss != pytest.approx(pooled)


def test_rolling_forms_agree_where_rows_exist(spark):
    both = rolling.rolling_compare(slot_panel(spark, SMALL), "feature_00", 5).where("feature_00 IS NOT NULL")
    assert both.where("abs(rolling_mean - rolling_mean2) > 1e-9 OR rolling_mean2 IS NULL").count() == 0


def test_sma_identity(small_panel):
    out = features.sma_reconstruction(small_panel, [("responder_8", "responder_6")], BY_DAY_DENSE)
    assert out.where("abs(responder_6_residual) > 1e-12").count() == 0
    assert out.where("responder_6_residual IS NOT NULL").count() > 0


def test_baseline_beats_scaled_copies(small_panel):
    df = zero_fill(small_panel)
    model = models.linear_models(models.fit_weighted_linear(df, ["feature_03", "feature_01"], ["responder_3"]))["responder_3"]
    best = metrics.weighted_r2_loss(model.predict(df), [("predict", "responder_3")]).first().loss
    for scale in (0.5, 0.99, 1.01, 2.0):
        worse = metrics.weighted_r2_loss(model.predict(df), [(f"{scale}D * predict", "responder_3")]).first().loss
        assert worse > best


def test_sample_counts(small_panel):
    train, latest, test = (small_panel.where(c) for c in ("date_id < 50", "date_id >= 80", "date_id BETWEEN 50 AND 79"))
    out = online_sample(6, train, test, latest, 5, 3, features=PANEL_FEATURES, layout=BY_DAY_DENSE)
    per_date = {r.date_id: r["count"] for r in out.groupBy("date_id").count().collect()}
    full = {r.date_id: r["count"] for r in small_panel.groupBy("date_id").count().collect()}
    assert sum(d < 50 for d in per_date) == 5 and sum(50 <= d < 80 for d in per_date) == 3
    assert all(n == full[d] * (2 if d >= 80 else 1) for d, n in per_date.items())


def test_pooled_loss_is_not_the_mean_of_losses(small_panel):
    q = predictions(small_panel)
    pairs = [(f"pred_{i}", c) for i, c in enumerate(RESPONDERS)]
    pooled = metrics.weighted_r2_loss(q, pairs).first().loss
    mean = sum(metrics.weighted_r2_loss(q, [p]).first().loss for p in pairs) / 9
    assert pooled != pytest.approx(mean)
