"""Backtest of fitted models and the gates that select one."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrace import fixed
from daytrace.functions import days as fd
from daytrace.functions import predict as fp
from daytrace.operators.expectation import FIT_FIELDS, WINDOW_KEY
from daytrace.operators.windows import window_days


def valid_ranks(days: DataFrame) -> DataFrame:
    """Valid days of a well numbered from 1, with the well's number of valid days."""
    w = Window.partitionBy("well")
    return (
        days.where(fd.is_valid() & F.col("q_24h").isNotNull())
        .select("well", "production_date", "q_24h", "choke_size")
        .withColumn("rank", F.row_number().over(w.orderBy("production_date")))
        .withColumn("valid_days", F.count(F.lit(1)).over(w))
    )


def targets(days: DataFrame, windows: DataFrame, horizons: Sequence[int] = fixed.HORIZONS) -> DataFrame:
    """Valid days 1..max(horizon) after the last valid day of each window.

    The window's own last valid rank travels with its last day, so targets are found by an equi
    join on (well, rank) and a window is copied at most 28 times.
    """
    ranks = valid_ranks(days)
    last = _last_ranks(ranks, windows)
    ahead = F.least(F.lit(max(horizons)), F.col("valid_days") - F.col("last_rank"))
    wanted = (
        last.withColumn("available", F.col("valid_days") - F.col("last_rank"))
        .where(F.col("available") > 0)
        .withColumn("step", F.explode(F.sequence(F.lit(1), ahead.cast("int"))))
        .withColumn("rank", F.col("last_rank") + F.col("step"))
        .drop("valid_days", "last_rank")
    )
    return wanted.join(ranks.drop("valid_days", "production_date"), ["well", "rank"]).drop("rank")


def _last_ranks(ranks: DataFrame, windows: DataFrame) -> DataFrame:
    return (
        window_days(ranks, windows)
        .groupBy(*WINDOW_KEY)
        .agg(F.max("rank").alias("last_rank"), F.first("valid_days").alias("valid_days"))
    )


def backtest(
    days: DataFrame, windows: DataFrame, fits: DataFrame, horizons: Sequence[int] = fixed.HORIZONS
) -> DataFrame:
    """One row per (model, window, horizon, step): actual, predicted, band, below flag."""

    def p(name: str) -> Column:
        return F.col(name)

    step = F.col("step")
    reached = F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: h >= step)
    return (
        targets(days, windows, horizons)
        .join(fits.select(*WINDOW_KEY, "model", *FIT_FIELDS), WINDOW_KEY)
        .withColumn("predicted", fp.expected_rate(p, step, F.col("choke_size")))
        .withColumn("lower", fp.lower_bound(p, F.col("predicted"), step))
        .withColumn("upper", fp.upper_bound(p, F.col("predicted"), step))
        .select(
            "model",
            *WINDOW_KEY,
            F.explode(reached).alias("horizon"),
            F.col("step").alias("steps_ahead"),
            "available",
            F.col("q_24h").alias("actual"),
            "predicted",
            "lower",
            "upper",
            (F.col("q_24h") < F.col("lower")).alias("below_lower"),
            (F.col("q_24h") - F.col("predicted")).alias("residual"),
        )
    )


def pooled_wape(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("model", "horizon").agg(
        F.count(F.lit(1)).alias("rows"), fp.wape(F.col("actual"), F.col("predicted")).alias("wape")
    )


def relative_wape_gate(evaluated: DataFrame, horizons: Sequence[int] = fixed.HORIZONS) -> DataFrame:
    """Gate 1 per candidate: at least 10 % better than the better baseline at every horizon."""
    pooled = pooled_wape(evaluated).select("model", "horizon", "wape")
    is_baseline = F.col("model").isin(*fixed.BASELINE_MODELS)
    best = pooled.where(is_baseline).groupBy("horizon").agg(F.min("wape").alias("best"))
    gain = (F.col("best") - F.col("wape")) / F.col("best")
    judged = pooled.where(~is_baseline).join(best, "horizon", "left").withColumn("gain", gain)
    known = F.count_if(F.col("wape").isNotNull() & F.col("best").isNotNull())
    return judged.groupBy("model").agg(
        ((known == len(horizons)) & F.every(F.coalesce(F.col("gain") >= fixed.RELATIVE_WAPE_GAIN, F.lit(False)))).alias("passed"),
        (known == len(horizons)).alias("evaluable"),
        F.min("gain").alias("smallest_gain"),
    )


def lower_tail(evaluated: DataFrame) -> DataFrame:
    """Rows below the band per (model, horizon, well), and pooled (well null)."""
    per_well = evaluated.groupBy("model", "horizon", "well").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("below_lower").alias("k")
    )
    pooled = per_well.groupBy("model", "horizon").agg(
        F.sum("n").alias("n"),
        F.sum("k").alias("k"),
        F.count_if(F.col("n") >= fixed.CALIBRATION_MIN_ROWS).alias("qualifying"),
    )
    both = per_well.where(F.col("n") >= fixed.CALIBRATION_MIN_ROWS).unionByName(
        pooled.withColumn("well", F.lit(None).cast("string")), allowMissingColumns=True
    )
    return both.withColumn("rate", F.col("k") / F.col("n"))


def _beta_tail(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by continued fraction, elementwise."""
    swap = x > (a + 1.0) / (a + b + 2.0)
    x, a, b = np.where(swap, 1.0 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    lg = np.vectorize(math.lgamma, otypes=[float])
    safe = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(safe) + b * np.log1p(-safe)) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 100_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            break
    return np.where(swap, 1.0 - front * h, front * h)


def exact_interval(k: np.ndarray, n: np.ndarray, confidence: float = 0.95):
    """Exact binomial interval: where each tail probability equals half the rest of confidence."""
    half = (1.0 - confidence) / 2.0

    def solve(a: np.ndarray, b: np.ndarray, target: float) -> np.ndarray:
        low, high = np.zeros_like(a), np.ones_like(a)
        for _ in range(60):
            mid = (low + high) / 2.0
            short = _beta_tail(mid, a, b) < target
            low, high = np.where(short, mid, low), np.where(short, high, mid)
        return (low + high) / 2.0

    k, n = k.astype(float), n.astype(float)
    lower = np.where(k > 0, solve(np.maximum(k, 1.0), n - np.maximum(k, 1.0) + 1.0, half), 0.0)
    inner = np.minimum(k, n - 1.0)
    upper = np.where(k < n, solve(inner + 1.0, n - inner, 1.0 - half), 1.0)
    return lower, upper


INTERVAL = T.StructType([T.StructField(n, T.DoubleType()) for n in ("low", "high")])


@F.pandas_udf(INTERVAL)
def binomial_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """95 % exact interval; runs on grouped counts, never on raw rows."""
    low, high = exact_interval(k.to_numpy(), n.to_numpy())
    return pd.DataFrame({"low": low, "high": high})


def lower_tail_gate(evaluated: DataFrame, producer_count: Column | int | None = None) -> DataFrame:
    """Gate 2 per model: every qualifying well's interval inside the band; pooled if few qualify."""
    low, high = fixed.LOWER_TAIL_BAND
    wells = evaluated.groupBy("model").agg(F.count_distinct("well").alias("_wells"))
    counted = F.lit(producer_count) if isinstance(producer_count, int) else producer_count
    rows = (
        lower_tail(evaluated)
        .withColumn("interval", binomial_interval(F.col("k"), F.col("n")))
        .join(wells, "model")
    )
    producers = F.col("_wells") if counted is None else counted
    pooled = F.col("well").isNull()
    judged = ~pooled | (F.col("qualifying") < producers / 2)
    inside = (F.col("interval.low") >= low) & (F.col("interval.high") <= high)
    return (
        rows.where(judged)
        .groupBy("model")
        .agg(F.every(inside).alias("passed"), F.count(F.lit(1)).alias("lines"))
        .withColumn("evaluable", F.col("lines") > 0)
    )


def bias(evaluated: DataFrame) -> DataFrame:
    """Per (model, horizon, well) with enough rows: mean bias ratio and failing half windows."""
    halves = (
        evaluated.withColumn("rows", F.least(F.col("horizon"), F.col("available")))
        .withColumn("second", F.col("steps_ahead") > F.floor(F.col("rows") / 2))
        .groupBy("model", "horizon", "well", "window_start", "rows", "second")
        .agg(F.sum("residual").alias("r"), F.sum("actual").alias("a"), F.count(F.lit(1)).alias("n"))
    )
    drifts = (
        (F.col("rows") >= fixed.HALF_WINDOW_MIN_ROWS)
        & (F.col("a") != 0.0)
        & (F.abs(F.col("r") / F.col("a")) > fixed.BIAS_TOLERANCE)
    )
    return (
        halves.groupBy("model", "horizon", "well")
        .agg(
            F.sum("n").alias("n"),
            (F.sum("r") / F.nullif(F.sum("a"), F.lit(0.0))).alias("ratio"),
            F.count_if(drifts).alias("drifting_halves"),
        )
        .where(F.col("n") >= fixed.BIAS_MIN_ROWS)
    )


def bias_gate(evaluated: DataFrame) -> DataFrame:
    """Gate 3 per model. A well whose actuals sum to zero is passed over, drift included."""
    ok = F.col("ratio").isNull() | (
        (F.abs("ratio") <= fixed.BIAS_TOLERANCE) & (F.col("drifting_halves") == 0)
    )
    models = evaluated.select("model").distinct()
    judged = bias(evaluated).groupBy("model").agg(F.every(ok).alias("ok"), F.count(F.lit(1)).alias("wells"))
    return models.join(judged, "model", "left").select(
        "model",
        F.coalesce("ok", F.lit(False)).alias("passed"),
        F.col("wells").isNotNull().alias("evaluable"),
    )


def select_model(evaluated: DataFrame, producer_count: Column | int | None = None) -> DataFrame:
    """One row: the first candidate passing all gates, else the fallback baseline."""
    gates = (
        relative_wape_gate(evaluated)
        .select("model", "passed")
        .unionByName(lower_tail_gate(evaluated, producer_count).select("model", "passed"))
        .unionByName(bias_gate(evaluated).select("model", "passed"))
        .where(~F.col("model").isin(*fixed.BASELINE_MODELS))
    )
    place = F.array_position(F.array(*[F.lit(m) for m in fixed.MODELS]), F.col("model"))
    passing = gates.groupBy("model").agg(F.every("passed").alias("ok"), F.count(F.lit(1)).alias("gates"))
    return passing.where("ok and gates = 3").agg(
        F.coalesce(F.min_by("model", place), F.lit(fixed.FALLBACK_MODEL)).alias("selected_model")
    )
