"""Recorded time per well, gaps and overlaps between the blocks of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.operators.events import HOUR_MICROS, hours_between, is_non_productive

TOLERANCE_HOURS = 0.01
#: Starts that are ordered together, about; a time slice with more is cut again.
CELL_ROWS = 50_000


def _cells(starts: DataFrame, keys: Sequence[str], slice_seconds: int, rows: int) -> DataFrame:
    """`starts` (key, s, ...) with `cell`, an ordered pair of numbers: the time slice and a part of it.

    A slice that holds more than `rows` distinct starts of its key is cut at their approximate quantiles, so
    a busy moment of a key is ordered in several tasks however narrow it is.
    """
    sliced = starts.withColumn("_slice", F.floor(F.col("s") / F.lit(slice_seconds * 1_000_000)))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    crowded = counts.where(F.col("_n") > rows).withColumn("_parts", F.ceil(F.col("_n") / rows))
    grain = 1000
    held = sliced.join(crowded.drop("_n"), [*keys, "_slice"], "left_semi")
    marks = held.groupBy(*keys, "_slice").agg(F.percentile_approx("s", [k / grain for k in range(1, grain)], 10 * grain).alias("_marks"))
    # As many of the marks as the slice needs parts, evenly chosen.
    cuts = crowded.join(marks, [*keys, "_slice"]).select(
        *keys,
        "_slice",
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.least(F.col("_parts"), F.lit(grain)).cast("int") - 1),
                lambda k: F.get("_marks", F.floor(k * (grain - 1) / F.least(F.col("_parts"), F.lit(grain))).cast("int")),
            )
        ).alias("_cuts"),
    )
    part = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col("s"))))
    return sliced.join(cuts, [*keys, "_slice"], "left").withColumn("cell", F.struct(F.col("_slice").alias("slice"), part.alias("part"))).drop("_slice", "_cuts")


def span_coverage(spans: DataFrame, key: Sequence[str], slice_seconds: int = 3600, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Hours of gap between merged spans and of concurrent overlap, per key.

    Works in two levels so that no task ever holds a whole key: spans sharing a start are first
    combined, each key is cut into time slices and crowded slices again, the latest end of every earlier slice is carried
    in, and only the rows of one slice are ordered together.

    A span that ends before it starts counts as it is written (and is flagged for review at
    extraction). Where nothing reaches its start it stands alone, and the gap after it begins at its
    end; elsewhere it only lessens the sum of hours. Both follow from a point at its start.
    """
    keys = list(key)
    timed = spans.where(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
    micros = timed.select(*keys, F.unix_micros("start_time").alias("s"), F.unix_micros("end_time").alias("t"))
    back = F.when(F.col("t") < F.col("s"), F.col("s") - F.col("t"))
    starts = micros.groupBy(*keys, "s").agg(
        F.max(F.greatest("s", "t")).alias("e"),
        F.coalesce(F.sum(F.when(F.col("t") >= F.col("s"), F.col("t") - F.col("s"))), F.lit(0)).alias("summed"),
        F.coalesce(F.sum(back), F.lit(0)).alias("back"),
        F.coalesce(F.min(back), F.lit(0)).alias("least_back"),
        F.count_if(F.col("t") >= F.col("s")).alias("forward"),
    )
    cells = _cells(starts, keys, slice_seconds, cell_rows)
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cells.groupBy(*keys, "cell")
        .agg(F.max("e").alias("_e"), F.max("s").alias("_s"))
        .withColumn("carry", F.max("_e").over(before))
        .withColumn("last", F.max("_s").over(Window.partitionBy(*keys)))
        .drop("_e", "_s")
    )
    inside = Window.partitionBy(*keys, "cell").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("carry"), F.max("e").over(inside))
    alone = F.coalesce(F.col("s") > F.col("reached"), F.lit(True))
    # The very last span of a key has no gap after it.
    ends_key = (F.col("s") == F.col("last")) & (F.col("forward") == 0)
    after = F.col("back") - F.when(ends_key, F.col("least_back")).otherwise(0)
    totals = (
        cells.join(carried, [*keys, "cell"])
        .withColumn("reached", reached)
        .groupBy(*keys)
        .agg(
            F.sum(F.coalesce(F.greatest(F.col("s") - F.col("reached"), F.lit(0)), F.lit(0))).alias("gap"),
            F.sum(F.when(alone, after).otherwise(0)).alias("extra"),
            F.sum(F.col("summed") - F.when(alone, 0).otherwise(F.col("back"))).alias("summed"),
            (F.max("e") - F.min("s")).alias("extent"),
        )
    )
    overlap = F.greatest(F.col("summed") - (F.col("extent") - F.col("gap")), F.lit(0))
    return totals.select(
        *keys,
        ((F.col("gap") + F.col("extra")) / F.lit(HOUR_MICROS)).alias("gap_hours"),
        (overlap / F.lit(HOUR_MICROS)).alias("overlap_hours"),
    )


def per_well(blocks: DataFrame, reports: DataFrame) -> DataFrame:
    """Recorded-time totals per well with at least one block.

    `blocks`: well, source_document, activity_code, state, start_time, end_time.
    `reports`: well, source_document (one row per file, also files without blocks).
    """
    timed = F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    lost = is_non_productive(F.col("activity_code"), F.col("state"))
    hours = hours_between(F.col("start_time"), F.col("end_time"))
    zero = F.lit(0.0)
    totals = blocks.groupBy("well").agg(
        F.coalesce(F.sum(F.when(timed & lost, hours)), zero).alias("npt_hours"),
        F.coalesce(F.sum(F.when(timed & ~lost, hours)), zero).alias("non_npt_recorded_hours"),
        F.coalesce(F.sum(F.when(timed, hours)), zero).alias("summed_block_hours"),
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(timed).alias("timed_blocks"),
        F.count_if(timed & lost).alias("npt_blocks"),
        F.count_if(~timed).alias("untimed_blocks"),
    )
    covered = (
        span_coverage(blocks.where(timed), ["well", "source_document"])
        .groupBy("well")
        .agg(
            F.sum("gap_hours").alias("unclassified_gap_hours"),
            F.sum("overlap_hours").alias("concurrent_overlap_hours"),
        )
    )
    files = reports.select("well", "source_document").distinct().groupBy("well").agg(F.count(F.lit(1)).alias("reports"))
    share = F.when(F.col("summed_block_hours") > 0, F.col("npt_hours") / F.col("summed_block_hours"))
    return (
        totals.join(covered, "well", "left")
        .join(files, "well", "left")
        .withColumn("npt_share", F.coalesce(share, zero))
        .fillna(0.0, ["unclassified_gap_hours", "concurrent_overlap_hours"])
        .fillna(0, ["reports"])
    )


def reconcile(walked: DataFrame, events: DataFrame) -> DataFrame:
    """Per well: do the categories sum up, and do walk and store agree on hours and counts."""
    stored = events.groupBy("well").agg(
        F.sum("duration_hours").alias("store_hours"), F.count(F.lit(1)).alias("store_events")
    )
    joined = walked.join(stored, "well", "left").fillna(0.0, ["store_hours"]).fillna(0, ["store_events"])

    def agree(difference: Column) -> Column:
        # The last bits of a sum depend on the order of its rows.
        return F.round(F.abs(difference), 9) <= TOLERANCE_HOURS

    return joined.select(
        "well",
        "npt_hours",
        "store_hours",
        "npt_blocks",
        "store_events",
        agree(F.col("npt_hours") + F.col("non_npt_recorded_hours") - F.col("summed_block_hours")).alias("categories_sum"),
        agree(F.col("npt_hours") - F.col("store_hours")).alias("hours_agree"),
        (F.col("npt_blocks") == F.col("store_events")).alias("counts_agree"),
    )
