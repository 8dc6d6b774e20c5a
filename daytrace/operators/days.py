"""Duplicates, classes, coverage, split, history and quality views over well-days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import days as fd

KEY = ("well", "production_date")


def _disagrees(column: str) -> Column:
    """More than one value among the rows of a group, null counting as a value."""
    c = F.col(column)
    some_null = F.count(c) != F.count(F.lit(1))
    return (F.min(c) != F.max(c)) | (some_null & (F.count(c) > 0))


def duplicate_groups(days: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per key: the row whose source sorts first, the row count, the fields in conflict.

    Only min, max and count are used, so rows are combined before the shuffle and a key holding
    a large share of the input arrives as one partial row per task.
    """
    rest = [c for c in days.columns if c not in key and c != "source"]
    checks = [f for f in fixed.MATERIAL_FIELDS if f in days.columns]
    # The rest of the row breaks ties of source, so that the pick does not depend on file order.
    first = F.min(F.struct("source", *rest))
    grouped = days.groupBy(*key).agg(
        first.alias("_row"),
        F.count(F.lit(1)).alias("rows"),
        *[_disagrees(f).alias(f"_differs_{f}") for f in checks],
    )
    fields = fd.fired(*[(F.col(f"_differs_{f}"), f) for f in checks])
    return grouped.select(*key, "_row", "rows", fields.alias("disagreeing_fields"))


def collapse_duplicates(days: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows kept: unique keys, and repeated keys whose rows agree on every material field."""
    groups = duplicate_groups(days, key).where(F.size("disagreeing_fields") == 0)
    return groups.select(*key, "_row.*").select(*days.columns)


def duplicate_conflicts(days: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys whose rows disagree, with the row count and the fields that differ."""
    return (
        duplicate_groups(days, key)
        .where(F.size("disagreeing_fields") > 0)
        .select(*key, "rows", "disagreeing_fields", F.lit("duplicate_disagreement").alias("reason"))
    )


def conflict_rows(days: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The rows behind each conflict, one row each (never gathered into a list)."""
    return days.join(duplicate_conflicts(days, key).select(*key, "disagreeing_fields"), list(key))


def classify(
    days: DataFrame,
    *,
    capacity: Mapping[str, float] | None = None,
    gas_and_water_present: bool = True,
    status_present: bool = True,
) -> DataFrame:
    """Add quarantine_reasons, checks_not_evaluated, day_class and q_24h."""
    failures = fd.physical_failures(capacity, gas_and_water_present)
    skipped = fd.checks_not_evaluated(capacity, gas_and_water_present)
    none = F.array().cast("array<string>")
    missing = fd.is_missing(status_present)
    return days.withColumns(
        {
            "day_class": fd.day_class(failures, status_present),
            "quarantine_reasons": F.when(missing, none).otherwise(failures),
            "checks_not_evaluated": F.when(missing, none).otherwise(skipped),
        }
    ).withColumn("q_24h", fd.daily_rate())


def class_counts(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Days per class; all six classes appear, also with zero days."""
    counted = days.groupBy(*by).agg(
        *[F.count_if(F.col("day_class") == c).alias(c) for c in fixed.DAY_CLASSES]
    )
    return counted.unpivot(list(by), list(fixed.DAY_CLASSES), "day_class", "days")


def coverage(days: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Per sensor channel: days, present, usable, zeros, usable fraction, sentinel zeros.

    All channels are counted in one pass and only the single result row is turned to long form.
    """
    names = [c for c in (channels or fixed.CHANNEL_UNITS) if c in days.columns]
    counted = days.agg(
        F.count(F.lit(1)).alias("days"),
        *[
            F.struct(
                F.count(c).alias("present"),
                F.count(fd.reading(c)).alias("usable"),
                F.count_if(F.col(c) == 0.0).alias("zeros"),
            ).alias(c)
            for c in names
        ],
    )
    long = counted.unpivot(["days"], names, "channel", "n").select("channel", "days", "n.*")
    units = F.create_map(*[F.lit(x) for p in fixed.CHANNEL_UNITS.items() for x in p])
    return long.select(
        "channel",
        units[F.col("channel")].alias("unit"),
        "days",
        "present",
        "usable",
        "zeros",
        F.when(F.col("days") > 0, F.col("usable") / F.col("days")).otherwise(F.lit(0.0)).alias("fraction"),
        (F.col("present") - F.col("usable")).alias("sentinel_zeros"),
    )


def derive_split(days: DataFrame) -> DataFrame:
    """One row: record span over valid days, hold-out boundary, end of development."""
    ends = days.where(fd.is_valid()).agg(
        F.min("production_date").alias("record_start"), F.max("production_date").alias("record_end")
    )
    span = F.datediff("record_end", "record_start")
    # bround: ties go to the even day, as the protocol's own rounding does
    offset = F.bround(span * (1.0 - fixed.HOLD_OUT_FRACTION)).cast("int")
    return ends.withColumn("boundary", F.date_add("record_start", offset)).withColumn(
        "development_end", F.date_sub("boundary", fixed.BUFFER_DAYS)
    )


def development_only(days: DataFrame, split: DataFrame) -> DataFrame:
    return days.where(F.col("production_date") < split.select("development_end").scalar())


def development_counts(days: DataFrame, split: DataFrame) -> DataFrame:
    """Valid development days per well (zero included) and whether they are too few to model."""
    before = F.col("production_date") < split.select("development_end").scalar()
    counted = days.withColumn("_counts", fd.is_valid() & before)
    return (
        counted.groupBy("well")
        .agg(F.count_if("_counts").alias("development_days"))
        .withColumn("cold_start", F.col("development_days") < fixed.MIN_DEVELOPMENT_DAYS)
    )


def cold_start_wells(days: DataFrame, split: DataFrame) -> DataFrame:
    return development_counts(days, split).where("cold_start").drop("cold_start")


def producers_only(days: DataFrame) -> DataFrame:
    """Days of the wells that have at least one valid producing day."""
    wells = days.where(fd.is_valid()).select("well").distinct()
    return days.join(wells, "well", "left_semi")


def _requested(days: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (well, start, end) with their days attached; a request without days stays."""
    known = days.select(F.col("well").alias("_known")).distinct()
    asked = requests.join(known, requests["well"] == known["_known"], "left")
    body = days.withColumnRenamed("well", "_well")
    held = (F.col("well") == F.col("_well")) & F.col("production_date").between(
        F.col("start"), F.col("end")
    )
    return asked.join(body, held, "left")


def _error(rows: str) -> Column:
    return (
        F.when(F.col("end") < F.col("start"), "invalid_range")
        .when(~F.col("_is_known"), "unknown_well")
        .when(F.col(rows) == 0, "no_data")
    )


def history(days: DataFrame, requests: DataFrame) -> DataFrame:
    """Well history: class counts and absent days per request, or an error code."""
    counted = (
        _requested(days, requests)
        .groupBy("well", "start", "end")
        .agg(
            F.max(F.col("_known").isNotNull()).alias("_is_known"),
            F.count("production_date").alias("rows_present"),
            *[F.count_if(F.col("day_class") == c).alias(f"{c}_days") for c in fixed.DAY_CLASSES],
        )
    )
    absent = F.datediff("end", "start") + 1 - F.col("rows_present")
    return counted.select(
        "well",
        "start",
        "end",
        _error("rows_present").alias("error"),
        "rows_present",
        absent.alias("absent_days"),
        *[f"{c}_days" for c in fixed.DAY_CLASSES],
    )


def data_quality(days: DataFrame, requests: DataFrame) -> DataFrame:
    """Usable and gap fractions, reason counts and unevaluated checks per request."""
    reasons = fixed.QUARANTINE_REASONS
    counted = (
        _requested(days, requests)
        .groupBy("well", "start", "end")
        .agg(
            F.max(F.col("_known").isNotNull()).alias("_is_known"),
            F.count("production_date").alias("rows_present"),
            F.count_if(fd.is_valid()).alias("valid_producing_days"),
            F.count_if(F.col("day_class").isin(*fixed.GAP_CLASSES)).alias("_gaps"),
            F.min(F.when(fd.is_valid(), F.col("production_date"))).alias("first_valid_day"),
            F.max(F.when(fd.is_valid(), F.col("production_date"))).alias("last_valid_day"),
            *[
                F.count_if(F.array_contains("quarantine_reasons", r)).alias(f"_n_{r}")
                for r in reasons
            ],
            *[
                F.count_if(F.array_contains("checks_not_evaluated", r)).alias(f"_s_{r}")
                for r in reasons
            ],
        )
    )
    span = F.datediff("end", "start") + 1
    pairs = F.create_map(*[x for r in reasons for x in (F.lit(r), F.col(f"_n_{r}"))])
    skipped = fd.fired(*[(F.col(f"_s_{r}") > 0, r) for r in sorted(reasons)])
    return counted.select(
        "well",
        "start",
        "end",
        _error("rows_present").alias("error"),
        "rows_present",
        (span - F.col("rows_present")).alias("absent_days"),
        "valid_producing_days",
        (F.col("valid_producing_days") / F.nullif(span, F.lit(0))).alias("usable_fraction"),
        (F.col("_gaps") / F.nullif(F.col("rows_present"), F.lit(0))).alias("gap_fraction"),
        F.map_filter(pairs, lambda _, n: n > 0).alias("quarantine_reasons"),
        skipped.alias("checks_not_evaluated"),
        "first_valid_day",
        "last_valid_day",
    )
