"""Expectation study: classified days to windows, fits, backtest, selected model, episodes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.operators import backtest as ob
from daytrace.operators import days as od
from daytrace.operators import episodes as op
from daytrace.operators import expectation as oe
from daytrace.operators import windows as ow
from daytrace.session import checkpointed


def classified(rows: DataFrame, capacity: Mapping[str, float] | None = None) -> DataFrame:
    """Loaded day rows, duplicates collapsed, classified."""
    return od.classify(od.collapse_duplicates(rows), capacity=capacity)


def reference_windows(
    days: DataFrame, activity: DataFrame | None = None, *, tolerance: float | None = fixed.CONTROL_TOLERANCE
) -> DataFrame:
    """Stable windows. With control splits they are checkpointed: fits, backtest and sweep all read
    them, and the Python step inside should run once."""
    windows = ow.stable_windows(days, activity, tolerance=tolerance)
    return windows if tolerance is None else checkpointed(windows)


def windows_and_fits(
    days: DataFrame,
    activity: DataFrame | None = None,
    *,
    model: str = fixed.FALLBACK_MODEL,
    tolerance: float | None = fixed.CONTROL_TOLERANCE,
    windows: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(windows, fits of one model)."""
    if windows is None:
        windows = reference_windows(days, activity, tolerance=tolerance)
    return windows, oe.fit_models(ow.window_days(days, windows), (model,))


def evaluated(
    days: DataFrame,
    activity: DataFrame | None = None,
    *,
    tolerance: float | None = fixed.CONTROL_TOLERANCE,
    windows: DataFrame | None = None,
) -> DataFrame:
    """Backtest rows of all models."""
    if windows is None:
        windows = reference_windows(days, activity, tolerance=tolerance)
    return ob.backtest(days, windows, oe.fit_models(ow.window_days(days, windows)))


def development(days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(development days of the producing wells, split)."""
    split = od.derive_split(days)
    return od.producers_only(od.development_only(days, split)), split


def select_and_sweep(
    days: DataFrame, activity: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, str]:
    """(episodes, evaluated rows, model name) on development days.

    The choice of model is one value and decides the rest of the plan, so it is read here.
    """
    usable, _ = development(days)
    windows = reference_windows(usable, activity)
    rows = evaluated(usable, windows=windows)
    producers = usable.where(F.col("day_class") == "valid_producing").agg(F.count_distinct("well")).first()[0]
    model = ob.select_model(rows, int(producers)).first()["selected_model"]
    _, fits = windows_and_fits(usable, model=model, windows=windows)
    return op.sweep(usable, windows, fits), rows, model


def metrics(rows: DataFrame, episodes: DataFrame, model: str) -> DataFrame:
    """The study's figures in long form (manifest, key, value)."""
    pooled = ob.pooled_wape(rows)
    wape = pooled.select(F.concat_ws(".", F.lit("wape"), "model", "horizon").alias("key"), F.col("wape").alias("value"))
    counts = pooled.select(
        F.concat_ws(".", F.lit("evaluated_days"), "model", "horizon").alias("key"), F.col("rows").cast("double").alias("value")
    )
    tails = (
        ob.lower_tail(rows)
        .where(F.col("well").isNull() & (F.col("model") == model))
        .select(F.concat_ws(".", F.lit("lower_tail_rate"), "horizon").alias("key"), F.col("rate").alias("value"))
    )
    found = episodes.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("episodes").alias("key"), "value")
    long = wape.unionByName(counts).unionByName(tails).unionByName(found)
    return long.select(F.lit("expectation").alias("manifest"), "key", "value")
