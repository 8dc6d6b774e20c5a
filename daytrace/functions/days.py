"""Expressions over one day row (physical checks, class, rates, volumes, sensors)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from daytrace import fixed

VOLUMES = ("oil_volume_sm3", "gas_volume_sm3", "water_volume_sm3")


def fired(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in the order given; an unknown (null) rule does not fire."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def any_of(tests) -> Column:
    tests = list(tests)
    out = F.coalesce(tests[0], F.lit(False))
    for test in tests[1:]:
        out = out | F.coalesce(test, F.lit(False))
    return out


def physical_failures(
    capacity: Mapping[str, float] | None = None, gas_and_water_present: bool = True
) -> Column:
    hours, oil = F.col("on_stream_hours"), F.col("oil_volume_sm3")
    rules = [
        ((hours < 0.0) | (hours > fixed.HOURS_PER_DAY), "hours_out_of_range"),
        (any_of(F.col(v) < 0.0 for v in VOLUMES), "negative_volume"),
        ((hours == 0.0) & (oil != 0.0), "volume_without_hours"),
    ]
    if gas_and_water_present:
        dry = (F.coalesce(F.col("gas_volume_sm3"), F.lit(0.0)) == 0.0) & (
            F.coalesce(F.col("water_volume_sm3"), F.lit(0.0)) == 0.0
        )
        rules.append(
            (
                (F.col("well_status") == "producing") & (hours > 0.0) & (oil == 0.0) & dry,
                "no_fluids_on_producing_day",
            )
        )
    if capacity:
        over = [F.col(v) > F.lit(float(capacity[v])) for v in VOLUMES if capacity.get(v) is not None]
        if over:
            rules.append((any_of(over), "volume_above_capacity"))
    return fired(*rules)


def checks_not_evaluated(
    capacity: Mapping[str, float] | None = None, gas_and_water_present: bool = True
) -> Column:
    skipped = []
    if not gas_and_water_present:
        skipped.append("no_fluids_on_producing_day")
    if capacity is None:
        skipped.append("volume_above_capacity")
    return F.array(*[F.lit(s) for s in skipped]).cast("array<string>")


def is_missing(status_present: bool = True) -> Column:
    status = F.col("well_status")
    oil_expected = status.isNull() | (status == "producing")
    out = F.col("on_stream_hours").isNull() | (oil_expected & F.col("oil_volume_sm3").isNull())
    return (status.isNull() | out) if status_present else out


def day_class(failures: Column, status_present: bool = True) -> Column:
    """First match wins, so every day has exactly one class."""
    hours, status = F.col("on_stream_hours"), F.col("well_status")
    return (
        F.when(is_missing(status_present), "missing")
        .when(F.size(failures) > 0, "quarantined")
        .when(status.isNotNull() & (status != "producing"), "non_producing")
        .when(hours == 0.0, "downtime")
        .when(hours < fixed.MIN_PRODUCING_HOURS, "partial")
        .otherwise("valid_producing")
    )


def is_valid() -> Column:
    return F.col("day_class") == "valid_producing"


def daily_rate() -> Column:
    """Volume normalised to a full day; null outside the valid class."""
    hours = F.col("on_stream_hours")
    return F.when(
        is_valid() & (hours > 0.0), F.col("oil_volume_sm3") / hours * fixed.HOURS_PER_DAY
    )


def _hours_capped() -> Column:
    return F.least(F.col("on_stream_hours"), F.lit(fixed.HOURS_PER_DAY))


def in_scope() -> Column:
    return F.col("day_class").isin(*fixed.IN_SCOPE_CLASSES) & F.col("on_stream_hours").isNotNull()


def expected_volume(q: Column) -> Column:
    return F.when(in_scope(), q * _hours_capped() / fixed.HOURS_PER_DAY)


def deferred_volume(q: Column) -> Column:
    return F.when(
        in_scope(), q * (F.lit(fixed.HOURS_PER_DAY) - _hours_capped()) / fixed.HOURS_PER_DAY
    )


def rate_shortfall(q: Column) -> Column:
    """Expected minus actual; a surplus day stays negative."""
    return expected_volume(q) - F.col("oil_volume_sm3")


def reading(channel: str) -> Column:
    """A sensor value, with zero read as 'no reading' on the channels where zero means that."""
    value = F.col(channel).cast("double")
    return F.nullif(value, F.lit(0.0)) if channel in fixed.SENTINEL_ZERO_CHANNELS else value


def water_cut() -> Column:
    """Water over total liquid on any day that has both (used in diagnostic bundles)."""
    water, oil = F.col("water_volume_sm3"), F.col("oil_volume_sm3")
    return F.when(water + oil > 0.0, water / (water + oil))


def water_cut_valid_days() -> Column:
    """The series variant: valid producing days only."""
    return F.when(is_valid(), water_cut())


def gas_oil_ratio() -> Column:
    oil = F.col("oil_volume_sm3")
    return F.when(oil > 0.0, F.col("gas_volume_sm3") / oil)
