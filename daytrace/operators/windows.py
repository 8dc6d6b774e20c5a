"""Stable reference windows: segments, control splits, selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrace import fixed
from daytrace.functions import days as fd
from daytrace.operators.joins import asof


def flag_activity(days: DataFrame, activity: DataFrame | None) -> DataFrame:
    """Mark days on which the well (all its bores) has an activity report."""
    if activity is None:
        return days.withColumn("on_activity", F.lit(False))
    dates = activity.select(
        F.col("well").alias("_well"), F.col("activity_date").alias("production_date")
    ).distinct()
    keyed = days.withColumn("_well", F.substring_index("well", " ", 1))
    flagged = dates.withColumn("on_activity", F.lit(True))
    return (
        keyed.join(flagged, ["_well", "production_date"], "left")
        .withColumn("on_activity", F.coalesce("on_activity", F.lit(False)))
        .drop("_well")
    )


def segments(days: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """Rows between breaks, with `segment`. The breaking days themselves belong to none.

    A day breaks when it is quarantined, when it is an activity day, or when its status differs
    from the day before (which is forgotten after a quarantined day).
    """
    w = Window.partitionBy("well").orderBy("production_date")
    before = F.lag(F.struct("day_class", "well_status")).over(w)
    changed = (
        before.isNotNull()
        & (before["day_class"] != "quarantined")
        & ~before["well_status"].eqNullSafe(F.col("well_status"))
    )
    breaks = (F.col("day_class") == "quarantined") | F.col("on_activity") | changed
    return (
        flag_activity(days, activity)
        .withColumn("_breaks", F.coalesce(breaks, F.lit(False)))
        .withColumn("segment", F.sum(F.col("_breaks").cast("bigint")).over(w))
        .where(~F.col("_breaks"))
        .drop("_breaks", "on_activity")
    )


def control_reading() -> Column:
    return F.when(fd.is_valid(), F.col("choke_size"))


def _cut_positions(values: np.ndarray, tolerance: float) -> list[int]:
    """Positions at which a run of readings is cut until every piece holds the tolerance."""
    cuts, todo = [], [(0, len(values))]
    while todo:
        low, high = todo.pop()
        piece = values[low:high]
        if len(piece) < 2:
            continue
        centre = float(np.median(piece))
        if centre == 0.0 or np.all(np.abs(piece - centre) / abs(centre) <= tolerance):
            continue
        at = low + 1 + int(np.argmax(np.abs(np.diff(piece))))  # argmax keeps the first largest
        cuts.append(at)
        todo += [(low, at), (at, high)]
    return cuts


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cuts_of(values: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([_cut_positions(np.asarray(v, dtype=float), t) for v, t in zip(values, tolerance, strict=True)])


def _segment_lists(segmented: DataFrame) -> DataFrame:
    """Per segment its days in order, with what windows need of them; at most one entry per calendar day."""
    entry = F.struct("production_date", fd.is_valid().alias("valid"), control_reading().alias("control"))
    listed = F.sort_array(F.collect_list(entry)).alias("_days")
    return segmented.groupBy("well", "segment").agg(listed, F.count_if(fd.is_valid()).alias("_valid"))


def _cut_dates(tolerance: float) -> Column:
    """Dates at which the list `_days` is cut; segments whose extremes are near are not handed to Python."""
    read = F.filter("_days", lambda d: d["control"].isNotNull())
    values = F.transform(read, lambda d: d["control"])
    low, high = F.array_min(values), F.array_max(values)
    near = F.coalesce((low * high > 0) & (high - low <= tolerance * F.least(F.abs(low), F.abs(high))), F.lit(True))
    at = _cuts_of(F.when(near, F.array().cast("array<double>")).otherwise(values), F.lit(float(tolerance)))
    return F.array_sort(F.transform(at, lambda i: F.get(read, i)["production_date"]))


def control_cuts(segmented: DataFrame, tolerance: float = fixed.CONTROL_TOLERANCE) -> DataFrame:
    """Dates that start a new part inside a segment (well, segment, production_date).

    Where to cut depends on medians of the pieces cut so far, so this is the one step that needs
    Python; it gets one list of readings per segment, and only of segments that may fail.
    """
    return _segment_lists(segmented).select("well", "segment", F.explode(_cut_dates(tolerance)).alias("production_date"))


def stable_windows(
    days: DataFrame,
    activity: DataFrame | None = None,
    *,
    min_valid_days: int = fixed.MIN_WINDOW_DAYS,
    tolerance: float | None = fixed.CONTROL_TOLERANCE,
) -> DataFrame:
    """Reference windows (well, window_start, window_end, valid days, median control, tested).

    `tolerance=None` leaves the control test out. A segment is one list, cut and summed up where the
    segments were made: there is one shuffle, by well.
    """
    # The parts of a segment have no more valid days than the segment: too short ones are not cut at all.
    lists = _segment_lists(segments(days, activity)).where(F.col("_valid") >= min_valid_days)
    none = F.array().cast("array<date>")
    lists = lists.withColumn("_cuts", none if tolerance is None else _cut_dates(tolerance))
    starts = lists.withColumn("_starts", F.concat(F.array(F.lit(None).cast("date")), "_cuts"))
    # There is always a part; said as an outer explode, no test of its size runs the cuts a second time.
    parts = starts.select("well", "_days", "_starts", F.posexplode_outer("_starts").alias("_k", "_from"))
    until = F.get("_starts", F.col("_k") + 1)
    inside = lambda d: (F.col("_from").isNull() | (d["production_date"] >= F.col("_from"))) & (until.isNull() | (d["production_date"] < until))
    part = parts.select("well", F.filter("_days", inside).alias("_p"))
    read = F.array_sort(F.transform(F.filter("_p", lambda d: d["control"].isNotNull()), lambda d: d["control"]))
    part = part.withColumns({"_c": read, "valid_producing_days": F.size(F.filter("_p", lambda d: d["valid"])).cast("bigint")})
    n = F.size("_c")
    middle = lambda i: F.get("_c", F.floor(i).cast("int"))
    return part.where(F.col("valid_producing_days") >= min_valid_days).select(
        "well",
        F.element_at("_p", 1)["production_date"].alias("window_start"),
        F.element_at("_p", -1)["production_date"].alias("window_end"),
        "valid_producing_days",
        F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2).alias("median_choke"),
        (n >= 2).alias("choke_test_applied"),
    )


def window_days(days: DataFrame, windows: DataFrame) -> DataFrame:
    """Days inside a window of their well, with that window's bounds.

    Windows of a well do not overlap, so the window of a day is the last one started by then.
    """
    bounds = windows.select("well", "window_start", "window_end")
    held = asof(days, bounds, ["well"], "production_date", "window_start", "_w")
    return held.where(F.col("production_date") <= F.col("_w.window_end")).select(
        *days.columns, F.col("_w.window_start"), F.col("_w.window_end")
    )


def reference_window(windows: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (well, before): the latest window ended before it, ties to the longest."""
    longest = windows.groupBy("well", "window_end").agg(
        F.min(F.struct("window_start", *[c for c in windows.columns if c not in ("well", "window_end", "window_start")])).alias("_w")
    )
    flat = longest.select("well", "window_end", "_w.*").select(*windows.columns)
    picked = asof(requests, flat, ["well"], "before", "window_end", "window", strict=True)
    return picked.select(
        "well", "before", *[F.col(f"window.{c}").alias(c) for c in windows.columns if c != "well"]
    )


