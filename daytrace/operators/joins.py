"""As-of and range joins built from equi joins and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    into: str,
    *,
    strict: bool = False,
) -> DataFrame:
    """Add to each left row the struct `into`: the last right row at or before it.

    With `strict` the right row must lie before it. Both sides are unioned and carried forward
    by one window, so there is one shuffle on `by` and no pair of rows is ever formed.
    """
    keys = list(by)
    types = {f.name: f.dataType for f in left.schema.fields}
    payload = F.struct(*right.columns)
    absent = F.lit(None).cast(right.select(payload.alias("r")).schema["r"].dataType)
    # Left columns stay flat, so the ones a caller does not use are pruned before the shuffle.
    rows = left.select(
        "*", F.col(left_on).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(True).alias("_own"), absent.alias("_right")
    )
    marks = right.select(
        *[(F.col(c) if c in keys else F.lit(None).cast(types[c])).alias(c) for c in left.columns],
        F.col(right_on).alias("_at"),
        F.lit(1 if strict else 0).alias("_side"),
        F.lit(False).alias("_own"),
        payload.alias("_right"),
    )
    back = (
        Window.partitionBy(*keys)
        .orderBy("_at", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = rows.unionByName(marks).withColumn("_right", F.last("_right", ignorenulls=True).over(back))
    return carried.where("_own").select(*left.columns, F.col("_right").alias(into))


def in_range(
    points: DataFrame,
    ranges: DataFrame,
    on: Sequence[str],
    point: Column,
    low: Column,
    high: Column,
    width: int,
) -> DataFrame:
    """Inner join of points with the closed ranges holding them, as an equi join on range cells.

    `point`, `low` and `high` are integer expressions. A point lies in one cell of `width`, a
    range is copied to each cell it touches, so every match appears once and a busy key is spread
    over its cells.
    """
    p = points.withColumn("_point", point.cast("bigint"))
    p = p.withColumn("_cell", F.floor(F.col("_point") / width))
    r = ranges.withColumn("_low", low.cast("bigint")).withColumn("_high", high.cast("bigint"))
    r = r.where("_low <= _high").withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))),
    )
    return (
        p.join(r, [*on, "_cell"])
        .where(F.col("_point").between(F.col("_low"), F.col("_high")))
        .drop("_point", "_cell", "_low", "_high")
    )


def date_number(day: Column) -> Column:
    return F.unix_date(day)


def within(df: DataFrame, max_rows: int = 100_000) -> bool:
    """Whether a table has at most `max_rows` rows; the count stops one past the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """A broadcast hint where a size check allowed it; otherwise the optimizer joins by shuffle."""
    return F.broadcast(df) if small else df
