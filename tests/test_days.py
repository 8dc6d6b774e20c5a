import datetime as dt

import pytest
from plain import START, days_of, frame, klass, row
from pyspark.sql import functions as F

from daytrace.functions import days as fd
from daytrace.operators import days as od

EDGES = [
    dict(on_stream_hours=-1.0), dict(on_stream_hours=25.0), dict(on_stream_hours=0.0), dict(on_stream_hours=0.0, oil_volume_sm3=0.0),
    dict(on_stream_hours=5.99), dict(on_stream_hours=6.0), dict(on_stream_hours=None), dict(well_status=None),
    dict(well_status="injecting", oil_volume_sm3=None), dict(oil_volume_sm3=0.0, gas_volume_sm3=None, water_volume_sm3=None),
    dict(oil_volume_sm3=0.0), dict(water_volume_sm3=-1.0), dict(oil_volume_sm3=None), dict(),
]


def test_every_day_has_the_class_the_rules_give(spark):
    rows = [row(i, **edge) for i, edge in enumerate(EDGES)]
    got = {r.production_date: r.day_class for r in days_of(spark, rows).collect()}
    assert got == {r["production_date"]: klass(r) for r in rows}


def test_reasons_capacity_and_skipped_checks(spark):
    rows = [row(0, on_stream_hours=25.0, gas_volume_sm3=-1.0), row(1, oil_volume_sm3=500.0), row(2, on_stream_hours=None)]
    judged = od.classify(frame(spark, rows), capacity={"oil_volume_sm3": 400.0}).orderBy("production_date").collect()
    assert judged[0].quarantine_reasons == ["hours_out_of_range", "negative_volume"]
    assert judged[1].quarantine_reasons == ["volume_above_capacity"] and judged[1].checks_not_evaluated == []
    assert judged[2].quarantine_reasons == [] and judged[2].day_class == "missing"
    plain = od.classify(frame(spark, rows[1:2]), gas_and_water_present=False).first()
    assert plain.checks_not_evaluated == ["no_fluids_on_producing_day", "volume_above_capacity"]


def test_without_status_column_a_null_status_is_not_missing(spark):
    judged = od.classify(frame(spark, [row(0, well_status=None)]), status_present=False)
    assert judged.first().day_class == "valid_producing"


def test_volumes(spark):
    rows = [row(0), row(1, on_stream_hours=12.0), row(2, on_stream_hours=0.0, oil_volume_sm3=0.0), row(3, well_status="injecting")]
    q = F.lit(120.0)
    got = days_of(spark, rows).orderBy("production_date").select(
        "q_24h", fd.expected_volume(q), fd.deferred_volume(q), fd.rate_shortfall(q)
    )
    assert [tuple(r) for r in got.collect()] == [
        (100.0, 120.0, 0.0, 20.0), (200.0, 60.0, 60.0, -40.0), (None, 0.0, 120.0, 0.0), (None, None, None, None),
    ]


def test_duplicates_agree_disagree_and_null_against_value(spark):
    rows = [
        row(0, source="b"), row(0, source="a"), row(1), row(1, oil_volume_sm3=None, source="b"),
        row(2, choke_dp_bar=1.0, source="z"), row(2, choke_dp_bar=9.0, source="y"), row(3),
    ]
    df = frame(spark, rows)
    kept = {r.production_date: r.source for r in od.collapse_duplicates(df).collect()}
    day = lambda n: START + dt.timedelta(days=n)
    assert kept == {day(0): "a", day(2): "y", day(3): "a"}
    bad = od.duplicate_conflicts(df).collect()
    assert [(r.production_date, r.rows, r.disagreeing_fields) for r in bad] == [(day(1), 2, ["oil_volume_sm3"])]
    assert od.conflict_rows(df).count() == 2


def test_class_counts_keep_zero_classes_and_coverage_tells_zero_from_missing(spark):
    rows = [row(0, downhole_pressure_bar=0.0), row(1, downhole_pressure_bar=None), row(2, choke_size=0.0)]
    counts = {r.day_class: r.days for r in od.class_counts(days_of(spark, rows)).collect()}
    assert len(counts) == 6 and counts["valid_producing"] == 3 and counts["missing"] == 0
    cover = {r.channel: r for r in od.coverage(days_of(spark, rows)).collect()}
    assert (cover["downhole_pressure_bar"].present, cover["downhole_pressure_bar"].usable) == (2, 1)
    assert cover["downhole_pressure_bar"].sentinel_zeros == 1
    assert (cover["choke_size"].usable, cover["choke_size"].zeros) == (3, 1)


@pytest.mark.parametrize("span,offset", [(6, 4), (10, 8), (100, 75)])
def test_split_rounds_half_to_even(spark, span, offset):
    split = od.derive_split(days_of(spark, [row(0), row(span)])).first()
    assert (split.boundary - START).days == offset
    assert (split.boundary - split.development_end).days == 90


def test_development_and_cold_start(spark):
    rows = [row(i) for i in range(0, 900)] + [row(890, well="late")]
    days = days_of(spark, rows)
    split = od.derive_split(days)
    end = split.first().development_end
    assert od.development_only(days, split).agg(F.max("production_date")).first()[0] < end
    assert [(r.well, r.development_days) for r in od.cold_start_wells(days, split).collect()] == [("late", 0)]


def test_history_and_quality_report_errors(spark):
    days = days_of(spark, [row(0), row(1, on_stream_hours=30.0), row(5, on_stream_hours=None)])
    d = lambda n: START + dt.timedelta(days=n)
    asked = spark.createDataFrame(
        [("W", d(0), d(9)), ("X", d(0), d(9)), ("W", d(9), d(0)), ("W", d(0), d(2000)), ("W", d(20), d(30))],
        "well string, start date, end date",
    )
    got = {(r.well, r.start, r.end): r for r in od.history(days, asked).collect()}
    first = got[("W", d(0), d(9))]
    assert (first.error, first.absent_days, first.valid_producing_days, first.quarantined_days) == (None, 7, 1, 1)
    assert got[("X", d(0), d(9))].error == "unknown_well"
    assert got[("W", d(9), d(0))].error == "invalid_range"
    assert got[("W", d(0), d(2000))].error is None and got[("W", d(0), d(2000))].absent_days == 1998
    assert got[("W", d(20), d(30))].error == "no_data"
    quality = od.data_quality(days, asked.limit(1)).first()
    assert quality.quarantine_reasons == {"hours_out_of_range": 1}
    assert quality.checks_not_evaluated == ["volume_above_capacity"]
    assert round(quality.gap_fraction, 6) == round(2 / 3, 6) and quality.first_valid_day == d(0)
