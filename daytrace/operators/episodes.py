"""Sustained underperformance: governed days, detection, totals, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import days as fd
from daytrace.functions import predict as fp
from daytrace.operators.joins import asof
from daytrace.session import stored

GOVERNED = ["well", "window_start", "window_end"]


def governed_days(days: DataFrame, windows: DataFrame, fits: DataFrame) -> DataFrame:
    """Each day with the last window ended before it, that window's fit, and its step number.

    `fits` holds one model. A window without a fit still ends the one before it.
    """
    key = ["well", "window_start", "window_end"]
    known = windows.select(*key).join(
        fits.select(*key, F.struct(*[c for c in fits.columns if c not in key]).alias("fit")), key, "left"
    )
    held = asof(days, known, ["well"], "production_date", "window_end", "_w", strict=True)
    valid = fd.is_valid()
    last = F.max(F.when(valid, F.col("production_date"))).over(Window.partitionBy("well"))
    # Taken before days without a fit are dropped: they still count as the well's last.
    rows = held.withColumn("last_valid_day", last).where(F.col("_w.fit").isNotNull())
    rows = rows.select(
        *days.columns, "last_valid_day", "_w.window_start", "_w.window_end", F.col("_w.fit").alias("fit")
    )
    before = Window.partitionBy(*GOVERNED).orderBy("production_date").rowsBetween(Window.unboundedPreceding, -1)
    step = F.coalesce(F.sum(valid.cast("bigint")).over(before), F.lit(0)) + 1

    def p(name: str) -> Column:
        return F.col(f"fit.{name}")

    q = F.col("q_expected")
    return (
        rows.withColumns({"step": step, "span_valid_days": F.count_if(valid).over(Window.partitionBy(*GOVERNED))})
        .withColumn("q_expected", fp.expected_rate(p, F.col("step"), F.col("choke_size")))
        .withColumns(
            {"lower": fp.lower_bound(p, q, F.col("step")), "upper": fp.upper_bound(p, q, F.col("step"))}
        )
        .withColumn("below", F.coalesce(valid & (F.col("q_24h") < F.col("lower")), F.lit(False)))
    )


def below_runs(governed: DataFrame) -> DataFrame:
    """Add per row: the chain of below days it belongs to, and the chain's onset and offset step.

    Two below days share a chain when at most two inside days lie between them. A chain opens at
    its first run of seven; a chain without one has no onset. Rows before the first below day of
    a span are dropped.
    """
    ordered = Window.partitionBy(*GOVERNED).orderBy("production_date")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    below, step = F.col("below"), F.col("step")
    gap = step - F.max(F.when(below, step)).over(earlier)
    starts_chain = below & (gap.isNull() | (gap > fixed.RECOVERY_RUN))
    # Steps count valid days, so the day after the last inside day is where the current run began.
    run_start = F.coalesce(F.max(F.when(fd.is_valid() & ~below, step)).over(earlier), F.lit(0)) + 1
    run_days = step - F.col("run_start") + 1
    chain = Window.partitionBy(*GOVERNED, "chain")
    # Earliest run of seven or more, and of its rows the one that has run longest.
    opening = F.min(
        F.when(below & (run_days >= fixed.TRIGGER_RUN), F.struct("run_start", (-run_days).alias("minus_days")))
    ).over(chain)
    return (
        governed.withColumns({"run_start": run_start, "chain": F.sum(starts_chain.cast("bigint")).over(ordered)})
        .where(F.col("chain") > 0)
        .withColumns({"_opening": opening, "offset_step": F.max(F.when(below, step)).over(chain)})
        .withColumns({"onset_step": F.col("_opening.run_start"), "trigger_run_days": -F.col("_opening.minus_days")})
        .drop("_opening", "run_start")
    )


def detect(governed: DataFrame) -> DataFrame:
    """Accepted episodes. Every step is a window over one well, so the rows are shuffled once.

    Open-ended: the rate did not recover and the episode ends on the well's last valid day.
    """
    valid = fd.is_valid()
    after_onset = valid | (F.col("step") > F.col("onset_step"))
    inside = F.col("step").between(F.col("onset_step"), F.col("offset_step")) & after_onset
    q = F.col("q_expected")
    found = (
        below_runs(governed)
        .where(F.col("onset_step").isNotNull() & inside)
        .groupBy(*GOVERNED, "chain")
        .agg(
            F.min("production_date").alias("onset"),
            F.max("production_date").alias("offset"),
            F.count_if(valid).alias("valid_producing_days"),
            F.first("trigger_run_days").alias("trigger_run_days"),
            F.sum(fd.rate_shortfall(q)).alias("cumulative_rate_shortfall_sm3"),
            F.sum(fd.deferred_volume(q)).alias("deferred_volume_sm3"),
            F.first("fit.reference_rate").alias("reference_rate_sm3_per_day"),
            F.count_if(F.col("day_class").isin(*fixed.GAP_CLASSES)).alias("_gaps"),
            F.count(F.lit(1)).alias("_rows"),
            F.first(F.col("span_valid_days") - F.col("offset_step")).alias("_after"),
            F.first("last_valid_day").alias("_last"),
        )
    )
    bar = F.lit(fixed.SHORTFALL_FRACTION) * F.col("reference_rate_sm3_per_day") * F.col("valid_producing_days")
    return (
        found.withColumns({"shortfall_threshold_sm3": bar, "gap_fraction": F.col("_gaps") / F.col("_rows")})
        .where(
            (F.col("valid_producing_days") >= fixed.MIN_EPISODE_DAYS)
            & (F.col("cumulative_rate_shortfall_sm3") >= F.col("shortfall_threshold_sm3"))
        )
        .select(
            "well",
            "onset",
            "offset",
            "valid_producing_days",
            "trigger_run_days",
            "cumulative_rate_shortfall_sm3",
            "deferred_volume_sm3",
            "shortfall_threshold_sm3",
            "reference_rate_sm3_per_day",
            "gap_fraction",
            ((F.col("_after") < fixed.RECOVERY_RUN) & (F.col("offset") == F.col("_last"))).alias("open_ended"),
            (F.col("gap_fraction") > fixed.POORLY_EVIDENCED_FRACTION).alias("poorly_evidenced"),
            F.col("window_start").alias("governing_window_start"),
            F.col("window_end").alias("governing_window_end"),
        )
    )


def sweep(days: DataFrame, windows: DataFrame, fits: DataFrame) -> DataFrame:
    """Episodes of every well."""
    return detect(governed_days(days, windows, fits))


def series(days: DataFrame, windows: DataFrame, fits: DataFrame) -> DataFrame:
    """Per-day series with expectation, band and channels; predictions on valid days only."""
    governed = governed_days(days, windows, fits)

    def on_valid(name: str) -> Column:
        return F.when(fd.is_valid(), F.col(name))

    return governed.select(
        "well",
        "production_date",
        "day_class",
        F.col("q_24h").alias("actual_rate_sm3_per_day"),
        on_valid("q_expected").alias("expected"),
        on_valid("lower").alias("lower"),
        on_valid("upper").alias("upper"),
        F.col("below").alias("below_band"),
        "on_stream_hours",
        "choke_size",
        fd.reading("downhole_pressure_bar").alias("downhole_pressure_bar"),
        fd.reading("wellhead_pressure_bar").alias("wellhead_pressure_bar"),
        fd.water_cut_valid_days().alias("water_cut"),
        F.col("window_start").alias("governing_window_start"),
        F.col("window_end").alias("governing_window_end"),
    )


def ranked(episodes: DataFrame, well: str | None = None) -> DataFrame:
    """Episodes, most costly first, with their place among all of them (`place`, from 1).

    The order is made by a range sort; places follow from counts of the ranges, so no task holds all episodes.
    """
    order = [F.desc("cumulative_rate_shortfall_sm3"), F.col("well"), F.col("onset")]
    sorted_ = stored(episodes.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shifts = counts.select("_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    placed = sorted_.join(shifts, part == F.col("_part")).withColumn("place", F.col("_at") + F.col("_shift"))
    chosen = placed if well is None else placed.where(F.col("well") == well)
    return chosen.drop("_at", "_part", "_shift").orderBy("place")


def one(episodes: DataFrame, well: str, onset) -> DataFrame:
    """The episode of a well that starts on a date; no row where there is none."""
    return episodes.where((F.col("well") == well) & (F.col("onset") == F.lit(onset)))


def lookup(episodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (well, onset) with `found`: whether there is such an episode, and its figures."""
    asked = requests.select("well", "onset").distinct()
    return asked.join(episodes.withColumn("_there", F.lit(True)), ["well", "onset"], "left").withColumn(
        "found", F.coalesce("_there", F.lit(False))
    ).drop("_there")
