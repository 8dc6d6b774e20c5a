"""Unit conversion as literal-map lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daytrace import fixed


def _factor(unit: Column, table: dict[str, float]) -> Column:
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), F.lower(F.trim(unit)))


def to_sm3(value: Column, unit: Column, fluid: Column) -> Column:
    """Standard cubic metres; null where the unit has no registered conversion.

    Gas at actual conditions (m3, am3, acf, rm3) has none: it needs pressure and temperature.
    """
    factor = F.when(fluid == "liquid", _factor(unit, fixed.LIQUID_TO_SM3)).when(
        fluid == "gas", _factor(unit, fixed.GAS_TO_SM3)
    )
    return value * factor


def volume_unit_problem(unit: Column, fluid: Column) -> Column:
    refused = (fluid == "gas") & F.lower(F.trim(unit)).isin(*fixed.REFUSED_GAS_UNITS)
    return F.when(refused, "actual_conditions").when(
        to_sm3(F.lit(1.0), unit, fluid).isNull(), "unknown_unit"
    )


def to_hours(value: Column, unit: Column) -> Column:
    return value * _factor(unit, fixed.TIME_TO_HOURS)
