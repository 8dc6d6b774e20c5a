"""Plans keep the shape that holds for large and uneven tables."""

import datetime as dt
import re

import plain
import pytest
from pyspark.sql import functions as F

from daytrace.bindings import views
from daytrace.operators import days as od
from daytrace.operators import diagnose as og
from daytrace.operators import joins
from daytrace.operators import patterns as opt
from daytrace.operators import recorded_time as ort
from daytrace.operators import sampling as os_
from daytrace.operators import search as osr
from daytrace.operators import windows as ow


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_cut_inside_tasks(spark):
    rows = spark.createDataFrame([("a", "choke", "s")], "chunk_id string, text string, subcategory string")
    hits = osr.search(rows, spark.createDataFrame([("q", "choke")], "query_id string, query string"))
    assert "WindowGroupLimit" in plan(hits)
    drawn = os_.stratified(rows.withColumnRenamed("chunk_id", "event_id"), 5)
    assert plan(drawn).count("WindowGroupLimit") == 2 and "TakeOrdered" in plan(drawn)


def test_duplicates_are_combined_before_the_shuffle(spark):
    text = plan(od.duplicate_groups(plain.frame(spark, [plain.row(0)])))
    assert "partial_min" in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="driver tables are not here")
def test_day_view_reads_only_its_columns_and_hash_aggregates(spark):
    text = plan(views.entity_days(spark, "/root/testdata/sf0.001"))
    assert not any(c in text for c in ("l_tax", "l_discount", "l_extendedprice", "l_returnflag"))
    assert "SortAggregate" not in text and "partial_min_by" in text


def test_unused_columns_do_not_pass_through_an_asof_join(spark):
    days = plain.frame(spark, [plain.row(0)])
    marks = spark.createDataFrame([("W", dt.date(2010, 1, 1))], "well string, start date")
    joined = joins.asof(days, marks, ["well"], "production_date", "start", "m").select("well", "m")
    projected = [line for line in plan(joined).splitlines() if "Project [" in line]
    assert projected and not any("choke_unit" in line or "source" in line for line in projected)


def test_one_key_holding_most_rows_gives_the_same_totals(spark):
    """Nine tenths of the spans lie in one key, many of them copies."""
    base = dt.datetime(2020, 1, 1)
    rows = spark.range(20000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("key"),
        (F.lit(base) + F.make_dt_interval(mins=(F.col("id") % 4000 * 7).cast("int"))).alias("start_time"),
    ).withColumn("end_time", F.col("start_time") + F.expr("interval 5 minutes"))
    got = {r.key: r for r in ort.span_coverage(rows, ["key"]).where("key = 'hot'").collect()}["hot"]
    for crowd in (500, 7):
        again = ort.span_coverage(rows, ["key"], slice_seconds=10**7, cell_rows=crowd).where("key = 'hot'").first()
        assert (again.gap_hours, again.overlap_hours) == (pytest.approx(got.gap_hours), pytest.approx(got.overlap_hours))
    starts = sorted({(i % 4000) * 7 for i in range(20000) if i % 10 < 9})
    gaps = sum(max(0, b - a - 5) for a, b in zip(starts, starts[1:], strict=False)) / 60
    n = sum(i % 10 < 9 for i in range(20000))
    assert got.gap_hours == pytest.approx(gaps)
    assert got.overlap_hours == pytest.approx((n * 5 - len(starts) * 5) / 60)


def test_size_check_stops_at_its_bound(spark):
    assert joins.within(spark.range(10), 10) and not joins.within(spark.range(10**9), 10)


def test_a_crowded_slice_is_cut_into_parts_of_about_the_same_size(spark):
    starts = spark.range(30000).select(F.lit("k").alias("key"), (F.col("id") % 29999 * 3).alias("s"))
    cells = ort._cells(starts, ["key"], 10**9, 1000).groupBy("cell").count().collect()
    assert 25 <= len(cells) <= 31 and max(r["count"] for r in cells) < 2000


def test_no_text_goes_through_the_groups_of_the_register(spark):
    events = spark.createDataFrame([], "event_id string, well string, source_document string, report_date date, duration_hours double, comment string, subcategory string, state_detail string")
    made = opt.register(events)
    text = plan(made)
    grouped = [line for line in text.splitlines() if "HashAggregate" in line and "sum(duration_hours" in line]
    assert grouped and not any("comment" in line for line in grouped)
    assert len(re.findall(r"SortAggregate\(key=\[_subcategory", text)) == text.count("SortAggregate")


def test_days_of_wells_without_an_episode_are_not_numbered(spark):
    days = plain.days_of(spark, [plain.row(i, well=w) for w in ("W", "V") for i in range(80)])
    spans = [("W", plain.START + dt.timedelta(70), plain.START + dt.timedelta(79))]
    found = og.bundle_rows(spark.createDataFrame(spans, "well string, onset date, offset date"), days)
    assert re.search(r"Window \[row_number(?:.|\n)*LeftSemi", plan(found))
    assert [tuple(r) for r in found.groupBy("well").agg(F.count(F.lit(1))).collect()] == [("W", 70)]


def test_cuts_are_made_once_and_only_of_segments_that_can_hold_a_window(spark):
    text = plan(ow.stable_windows(plain.days_of(spark, [plain.row(i) for i in range(30)])))
    assert text.count("ArrowEvalPython") == 1
    assert re.search(r"Filter \(\S+ >= 20\)", text[text.index("ArrowEvalPython") :])
