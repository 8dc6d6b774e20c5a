import datetime as dt
import random

import numpy as np
import plain
import pytest
from plain import START, days_of, row
from pyspark.sql import functions as F

from daytrace.operators import backtest as ob
from daytrace.operators import episodes as op
from daytrace.operators import expectation as oe
from daytrace.operators import windows as ow
from daytrace.plans import study


def spans(spark, rows, **kw):
    found = ow.stable_windows(days_of(spark, rows), **kw).collect()
    return sorted((r.window_start, r.window_end) for r in found)


def day(n):
    return START + dt.timedelta(days=n)


def test_steady_days_make_one_window_and_nineteen_none(spark):
    assert spans(spark, [row(i) for i in range(40)]) == [(day(0), day(39))]
    assert spans(spark, [row(i) for i in range(19)]) == []


def test_breaks_belong_to_no_segment(spark):
    rows = [row(i, on_stream_hours=30.0 if i == 25 else 24.0) for i in range(50)]
    assert spans(spark, rows) == [(day(0), day(24)), (day(26), day(49))]
    rows = [row(i, well_status="injecting" if i == 25 else "producing") for i in range(50)]
    assert spans(spark, rows) == [(day(0), day(24)), (day(27), day(49))]
    activity = spark.createDataFrame([("W", day(30))], "well string, activity_date date")
    assert spans(spark, [row(i) for i in range(60)], activity=activity) == [(day(0), day(29)), (day(31), day(59))]


def test_control_step_splits_and_small_moves_do_not(spark):
    assert spans(spark, [row(i, choke_size=50.0 if i < 30 else 80.0) for i in range(60)]) == [(day(0), day(29)), (day(30), day(59))]
    assert spans(spark, [row(i, choke_size=50.0 + i % 2) for i in range(60)]) == [(day(0), day(59))]


def test_random_histories_match_the_plain_rules(spark):
    """Windows with control splits, and every field of the episodes, well by well."""
    rng = random.Random(5)
    by_well = {f"W{k}": plain.random_history(rng, well=f"W{k}") for k in range(60)}
    rows = [r for rs in by_well.values() for r in rs]
    days = days_of(spark, rows).cache()
    windows, fits = study.windows_and_fits(days)
    got = {w: [] for w in by_well}
    for r in windows.orderBy("well", "window_start").collect():
        got[r.well].append((r.window_start, r.window_end))
    want = {w: plain.windows(rs) for w, rs in by_well.items()}
    assert got == want and sum(map(len, want.values())) > 60
    found = {w: [] for w in by_well}
    for r in op.sweep(days, windows, fits).orderBy("well", "onset").collect():
        found[r.well].append(
            (r.onset, r.offset, r.valid_producing_days, r.trigger_run_days, round(r.cumulative_rate_shortfall_sm3, 6),
             round(r.deferred_volume_sm3, 6), round(r.gap_fraction, 9), r.open_ended)
        )
    expected = {w: plain.episodes(rs, want[w]) for w, rs in by_well.items()}
    assert found == expected
    assert sum(map(len, expected.values())) > 20


@pytest.mark.parametrize("recovery,merged", [(1, True), (2, True), (3, False)])
def test_short_recoveries_are_absorbed(spark, recovery, merged):
    low = lambda i: 40 <= i < 52 or 52 + recovery <= i < 64 + recovery
    rows = [row(i, oil_volume_sm3=50.0 if low(i) else 100.0) for i in range(100)]
    days = days_of(spark, rows)
    windows = ow.stable_windows(days).withColumn("window_end", F.lit(day(39)).cast("date"))
    fits = oe.fit_models(ow.window_days(days, windows), ("naive-median28",)).drop("model")
    found = op.sweep(days, windows, fits).orderBy("onset").collect()
    assert [e.onset for e in found] == ([day(40)] if merged else [day(40), day(52 + recovery)])
    assert not any(e.open_ended for e in found)


def test_reference_window_is_the_latest_ended_and_longest_on_ties(spark):
    windows = spark.createDataFrame(
        [("W", day(0), day(30), 25), ("W", day(10), day(30), 20), ("W", day(40), day(60), 20)],
        "well string, window_start date, window_end date, valid_producing_days int",
    )
    asked = spark.createDataFrame([("W", day(30)), ("W", day(31)), ("W", day(99))], "well string, before date")
    got = {r.before: r.window_start for r in ow.reference_window(windows, asked).collect()}
    assert got == {day(30): None, day(31): day(0), day(99): day(40)}


def test_fits_and_predictions_of_a_decline(spark):
    rows = [row(i, oil_volume_sm3=100.0 * float(np.exp(-0.01 * i))) for i in range(40)]
    days = days_of(spark, rows)
    windows = ow.stable_windows(days)
    fits = {r.model: r for r in oe.fit_models(ow.window_days(days, windows)).collect()}
    assert set(fits) == set(study.fixed.MODELS)
    assert fits["exponential-decline"].decline_rate == pytest.approx(0.01)
    assert fits["exponential-decline"].q_at_fit == pytest.approx(100 * np.exp(-0.39))
    assert fits["hyperbolic-decline"].hyperbolic_b == 0.5
    assert fits["naive-persistence"].q_at_fit == pytest.approx(100 * np.exp(-0.39))
    assert fits["choke-scaled"].rate_per_choke == pytest.approx(np.median([r["oil_volume_sm3"] / 50 for r in rows]))
    tail = sorted(r["oil_volume_sm3"] for r in rows[-28:])
    centre = float(np.median(tail))
    assert fits["naive-median28"].lower_offset == pytest.approx(tail[2] - centre)
    rising = days_of(spark, [row(i, oil_volume_sm3=100.0 + i) for i in range(40)])
    up = {r.model: r for r in oe.fit_models(ow.window_days(rising, ow.stable_windows(rising))).collect()}
    assert up["exponential-decline"].decline_rate == 0.0 and up["hyperbolic-decline"].hyperbolic_b == 0.0


def test_exact_interval_solves_both_tails():
    from math import comb

    def at_least(k, n, p):
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))

    for k, n in [(0, 10), (3, 20), (10, 10), (30, 150), (90, 300)]:
        low, high = (float(x[0]) for x in ob.exact_interval(np.array([k]), np.array([n])))
        assert k == 0 and low == 0.0 or at_least(k, n, low) == pytest.approx(0.025, abs=1e-6)
        assert k == n and high == 1.0 or 1 - at_least(k + 1, n, high) == pytest.approx(0.025, abs=1e-6)


EVALUATED = """model string, well string, window_start date, window_end date, horizon int, steps_ahead int, available int,
actual double, predicted double, lower double, upper double, below_lower boolean, residual double"""


def evaluated(spark, models, wells=2, below_every=9):
    rows = []
    for model, error in models.items():
        for w in range(wells):
            for window in range(12):
                for h in (7, 14, 28):
                    for step in range(1, h + 1):
                        wobble = error * (1 if step % 2 else -1)
                        low = (window * 28 + step) % below_every == 0
                        rows.append((model, f"w{w}", day(window * 40), day(window * 40 + 30), h, step, 28, 100.0, 100.0 - wobble,
                                     101.0 if low else 90.0, 110.0, low, wobble))
    return spark.createDataFrame(rows, EVALUATED)


def test_gates_pass_and_fail(spark):
    good = evaluated(spark, {"naive-median28": 10.0, "naive-persistence": 12.0, "choke-scaled": 2.0, "exponential-decline": 9.5})
    wape = {r.model: r for r in ob.relative_wape_gate(good).collect()}
    assert wape["choke-scaled"].passed and not wape["exponential-decline"].passed
    assert {r.model: r.passed for r in ob.bias_gate(good).collect()}["choke-scaled"]
    assert {r.model: r.passed for r in ob.lower_tail_gate(good).collect()}["choke-scaled"]
    assert ob.select_model(good).first().selected_model == "choke-scaled"
    often = evaluated(spark, {"naive-median28": 10.0, "naive-persistence": 12.0, "choke-scaled": 2.0}, below_every=2)
    assert not {r.model: r.passed for r in ob.lower_tail_gate(often).collect()}["choke-scaled"]
    assert ob.select_model(often).first().selected_model == "naive-median28"


def test_few_qualifying_producers_are_pooled(spark):
    rows = evaluated(spark, {"choke-scaled": 1.0}, wells=1)
    alone = ob.lower_tail_gate(rows, 1).first()
    pooled = ob.lower_tail_gate(rows, 5).first()
    assert pooled.lines > alone.lines


def test_backtest_rows_repeat_per_horizon(spark):
    rows = [row(i, on_stream_hours=30.0 if i == 40 else 24.0) for i in range(60)]
    days = days_of(spark, rows)
    result = study.evaluated(days).where("model = 'naive-median28'").collect()
    assert sum(r.horizon == 7 for r in result) == 7 and sum(r.horizon == 28 for r in result) == 19
    assert all(r.actual == 100.0 and r.predicted == 100.0 for r in result)


def test_study_runs_to_a_model_and_its_metrics(spark):
    rng = random.Random(3)
    rows = [r for k in range(3) for r in plain.random_history(rng, n=500, well=f"W{k}")]
    found, tested, model = study.select_and_sweep(days_of(spark, rows))
    assert model in study.fixed.MODELS
    keys = {r.key for r in study.metrics(tested, found, model).collect()}
    assert f"wape.{model}.7" in keys and "episodes" in keys and "lower_tail_rate.28" in keys
