"""Seeded, reproducible draws. Order comes from SHA-256 of seed and id, the same on any engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace import fixed


def seeded_order(event_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), event_id.cast("string")), 256)


def is_development(boundary: str = fixed.SPLIT_BOUNDARY, hold_out: Sequence[str] = fixed.HOLD_OUT_WELLS) -> Column:
    """Not a hold-out well, and reported before (not on) the boundary."""
    return ~F.col("well").isin(*hold_out) & (F.col("report_date") < F.lit(boundary).cast("date"))


def is_hold_out(hold_out: Sequence[str] = fixed.HOLD_OUT_WELLS) -> Column:
    return F.col("well").isin(*hold_out)


def stratified(eligible: DataFrame, target: int, seed: int = fixed.SAMPLE_SEED, stratum: str = "subcategory") -> DataFrame:
    """Round-robin over the strata, in order of their names, until `target` rows are drawn.

    A row drawn in round r is the r-th of its stratum, so no stratum can contribute more than
    `target` rows and each task keeps only that many per stratum before the shuffle.
    """
    named = eligible.withColumn("stratum", F.coalesce(F.nullif(F.col(stratum), F.lit("")), F.lit("(none)")))
    inside = Window.partitionBy("stratum").orderBy(seeded_order(F.col("event_id"), seed), "event_id")
    return (
        named.withColumn("round", F.row_number().over(inside))
        .where(F.col("round") <= target)
        .orderBy("round", "stratum")
        .limit(target)
    )


def draw(
    events: DataFrame,
    split: str = "development",
    target: int | None = None,
    seed: int = fixed.SAMPLE_SEED,
    boundary: str = fixed.SPLIT_BOUNDARY,
    hold_out: Sequence[str] = fixed.HOLD_OUT_WELLS,
) -> DataFrame:
    """The labelling sample of one split."""
    tests = {
        "development": (is_development(boundary, hold_out), fixed.DEVELOPMENT_TARGET),
        "hold-out": (is_hold_out(hold_out), fixed.HOLD_OUT_TARGET),
    }
    if split not in tests:
        raise ValueError(f"unknown split {split!r}; expected one of {sorted(tests)}")
    test, size = tests[split]
    return stratified(events.where(test), size if target is None else target, seed)


def sample_manifest(drawn: DataFrame) -> DataFrame:
    """Rows drawn per stratum."""
    return drawn.groupBy("stratum").agg(F.count(F.lit(1)).alias("drawn"))


BLIND = (
    "event_id",
    "start_time",
    "end_time",
    "duration_hours",
    "activity_code",
    "state",
    "state_detail",
    "comment",
)


def unplaced_labels(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Labelled ids that are not in the event table (must be empty before a draw)."""
    return labels.select("event_id").join(events, "event_id", "left_anti").distinct()


def adjudication_ids(
    labels: DataFrame,
    size: int = fixed.ADJUDICATION_SIZE,
    seed: int = fixed.SAMPLE_SEED,
    contested: tuple[str, ...] = fixed.CONTESTED_CAUSES,
) -> DataFrame:
    """Half from the contested classes, the rest elsewhere, shortfalls on either side topped up."""
    rows = labels.select("event_id", F.col("cause").isin(*contested).alias("contested"))
    have = rows.agg(F.count_if("contested").alias("c"), F.count_if(~F.col("contested")).alias("r"))
    c, r = have.select("c").scalar(), have.select("r").scalar()
    n = F.lit(size)
    from_rest = F.least(n - F.least(F.lit(size // 2), c), r)
    take = F.when(F.col("contested"), n - from_rest).otherwise(from_rest)
    inside = Window.partitionBy("contested").orderBy(seeded_order(F.col("event_id"), seed), "event_id")
    # At most `size` rows per class survive in each task; the exact share is cut afterwards.
    best = rows.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= size)
    chosen = best.where(F.col("_n") <= take).drop("_n")
    enough = F.when(
        c + r < n, F.raise_error(F.lit(f"cannot draw {size} from the labelled events")).cast("boolean")
    ).otherwise(F.lit(True))
    shuffled = Window.orderBy(seeded_order(F.col("event_id"), seed + 1))  # at most `size` rows
    return chosen.where(enough).withColumn("position", F.row_number().over(shuffled))


def adjudication_sheet(ids: DataFrame, events: DataFrame) -> DataFrame:
    """The drawn events without anything that would give the label away."""
    return ids.select("position", "event_id").join(events.select(*BLIND), "event_id").orderBy("position")
