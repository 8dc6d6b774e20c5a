"""Recurring lost-time patterns across wells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import text as ft

PATTERN = ["subcategory", "detail_state"]
OCCURRENCE = ("event_id", "well", "source_document", "report_date", "duration_hours", "comment")


def _in_scope(events: DataFrame, wells: DataFrame | None) -> DataFrame:
    scoped = events if wells is None else events.join(wells.select("well").distinct(), "well", "left_semi")
    return scoped.withColumnRenamed("state_detail", "detail_state")


def _flagged(events: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
    if ids is None:
        return events.withColumn(name, F.lit(False))
    marks = ids.select("event_id").distinct().withColumn(name, F.lit(True))
    return events.join(marks, "event_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def pattern_wells(events: DataFrame, wells: DataFrame | None = None) -> DataFrame:
    """Wells of each pattern, one row each (the register carries their number)."""
    return _in_scope(events, wells).select(*PATTERN, "well").distinct()


def register(
    events: DataFrame,
    *,
    wells: DataFrame | None = None,
    labelled: DataFrame | None = None,
    miscoded: DataFrame | None = None,
) -> DataFrame:
    """One row per (subcategory, detail state), recurring or not, with its longest event.

    Grouped per well first: a pattern holding a third of all events reaches its final group as
    one row per well. Only numbers and dates are grouped; the event to cite is fetched afterwards, among
    those as long as the longest of their pattern, so no text goes through the groups.
    """
    rows = _flagged(_flagged(_in_scope(events, wells), labelled, "_labelled"), miscoded, "_miscoded")
    per_well = rows.groupBy(*PATTERN, "well").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("duration_hours").alias("hours"),
        F.min("report_date").alias("first_seen"),
        F.max("report_date").alias("last_seen"),
        F.count_if("_labelled").alias("labelled"),
        F.count_if("_miscoded").alias("miscoded"),
        F.max("duration_hours").alias("longest"),
    )
    grouped = per_well.groupBy(*PATTERN).agg(
        F.count(F.lit(1)).alias("wells"),
        F.sum("events").alias("events"),
        F.sum("hours").alias("total_hours"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("longest").alias("longest"),
        F.sum("labelled").alias("labelled_events"),
        F.sum("miscoded").alias("miscoded_events"),
    )
    most = grouped.select(*[F.col(c).alias(f"_{c}") for c in PATTERN], F.col("longest").alias("_longest"))
    same = F.lit(True)
    for c in PATTERN:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    ends = rows.join(most, same & F.col("duration_hours").eqNullSafe(F.col("_longest")))
    cited = ends.groupBy(*[f"_{c}" for c in PATTERN]).agg(
        F.max(F.struct("event_id", *[c for c in OCCURRENCE if c != "event_id"])).alias("r")
    )
    grouped = grouped.join(cited, same).drop(*[f"_{c}" for c in PATTERN])
    recurring = (F.col("wells") >= fixed.PATTERN_MIN_WELLS) & (F.col("total_hours") >= fixed.PATTERN_MIN_HOURS)
    zero = F.lit(0.0)
    return grouped.select(
        *PATTERN,
        "wells",
        "events",
        "total_hours",
        "first_seen",
        "last_seen",
        "labelled_events",
        "miscoded_events",
        (F.col("labelled_events") / F.col("events")).alias("labelled_fraction"),
        F.coalesce(F.col("miscoded_events") / F.nullif(F.col("labelled_events"), F.lit(0)), zero).alias("miscoded_fraction"),
        F.col("r.event_id").alias("cited_event_id"),
        F.col("r.well").alias("cited_well"),
        F.col("r.source_document").alias("cited_document"),
        F.col("r.report_date").alias("cited_date"),
        F.col("r.duration_hours").alias("cited_hours"),
        ft.opening_span(F.col("r.comment")).alias("cited_span"),
        recurring.alias("recurring"),
    )


def ranking() -> list[Column]:
    """Published order; hours are rounded so that summation order cannot move a row."""
    return [F.desc(F.round("total_hours", 6)), F.col("subcategory"), F.col("detail_state")]


def recurring(register_rows: DataFrame) -> DataFrame:
    return register_rows.where("recurring").orderBy(*ranking())


def largest_excluded(register_rows: DataFrame, limit: int = 10) -> DataFrame:
    return register_rows.where("not recurring").orderBy(*ranking()).limit(limit)


def register_totals(register_rows: DataFrame) -> DataFrame:
    """One row: pattern counts, hours, coverage, labelled fraction of the recurring patterns."""
    r = F.col("recurring")

    def hours(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("total_hours"))), F.lit(0.0))

    labelled = F.sum(F.when(r, F.col("labelled_events"))) / F.nullif(F.sum(F.when(r, F.col("events"))), F.lit(0))
    return register_rows.agg(
        F.count_if(r).alias("patterns"),
        F.count_if(~r).alias("excluded_patterns"),
        hours(r).alias("recurring_hours"),
        hours(~r).alias("excluded_hours"),
        F.coalesce(F.sum("total_hours"), F.lit(0.0)).alias("corpus_hours"),
        F.coalesce(labelled, F.lit(0.0)).alias("labelled_fraction"),
    ).withColumn(
        "coverage",
        F.when(F.col("corpus_hours") > 0, F.col("recurring_hours") / F.col("corpus_hours")).otherwise(F.lit(0.0)),
    )


def cost_equivalent(hours: Column, day_rate_usd: float | None) -> tuple[Column, Column]:
    """(amount, assumption): both null without a stated rate."""
    if day_rate_usd is None:
        return F.lit(None).cast("double"), F.lit(None).cast("string")
    stated = (
        f"at a stated assumption of {day_rate_usd:,.0f} USD per rig day, "
        "which is an illustration and not a market rate"
    )
    return hours / F.lit(24.0) * F.lit(float(day_rate_usd)), F.lit(stated)
