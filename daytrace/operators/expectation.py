"""Expectation models fitted per reference window, all in one pass over the window rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import days as fd

WINDOW_KEY = ["well", "window_start", "window_end"]
FIT_FIELDS = (
    "q_at_fit",
    "decline_rate",
    "hyperbolic_b",
    "lower_offset",
    "upper_offset",
    "rate_per_choke",
    "widens",
)


def _median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def _nearest_rank(column: str, q: float) -> Column:
    """Nearest-rank quantile (no interpolation); nulls are left out."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def _band(column: str, name: str) -> list[Column]:
    return [
        _nearest_rank(column, fixed.LOWER_QUANTILE).alias(f"{name}_low"),
        _nearest_rank(column, fixed.UPPER_QUANTILE).alias(f"{name}_high"),
    ]


def _rate_rows(rows: DataFrame) -> DataFrame:
    """Valid rates of each window in order, with log-linear trend and both decline residuals."""
    ordered = Window.partitionBy(*WINDOW_KEY).orderBy("production_date")
    whole = Window.partitionBy(*WINDOW_KEY)
    positive = F.col("q_24h") > 0.0
    log_rate = F.when(positive, F.ln("q_24h"))
    at = F.when(positive, F.col("i").cast("double"))
    trend = (
        rows.where(fd.is_valid() & F.col("q_24h").isNotNull())
        .select(*WINDOW_KEY, "production_date", "q_24h", "choke_size")
        .withColumns({"i": F.row_number().over(ordered) - 1, "n": F.count(F.lit(1)).over(whole)})
        .withColumns(
            {
                "newest": F.col("n") - F.col("i"),
                "n_positive": F.count_if(positive).over(whole),
                "slope": F.regr_slope(log_rate, at).over(whole),
                "intercept": F.regr_intercept(log_rate, at).over(whole),
            }
        )
    )
    q_end = F.exp(F.col("intercept") + F.col("slope") * (F.col("n") - 1))
    decline = F.greatest(-F.col("slope"), F.lit(0.0))
    base = F.lit(1.0) + F.lit(fixed.HYPERBOLIC_B) * F.col("decline") * (F.col("i") - (F.col("n") - 1))
    curve = F.when(
        F.col("base") > 0.0, F.col("q_end") / F.pow(F.col("base"), F.lit(1.0 / fixed.HYPERBOLIC_B))
    )
    has_control = F.col("choke_size") > 0.0
    return (
        trend.withColumns({"q_end": q_end, "decline": decline})
        .withColumn("base", base)
        .withColumns(
            {
                "trailing": F.when(F.col("newest") <= fixed.TRAILING_RATES, F.col("q_24h")),
                "off_exp": F.col("q_24h") - F.exp(F.col("intercept") + F.col("slope") * F.col("i")),
                "off_hyp": F.col("q_24h") - curve,
                "ratio": F.when(has_control, F.col("q_24h") / F.col("choke_size")),
                "controlled": F.when(has_control, F.col("q_24h")),
            }
        )
    )


def fit_summaries(rows: DataFrame) -> DataFrame:
    """One row per window with every statistic the five models need."""
    return (
        _rate_rows(rows)
        .groupBy(*WINDOW_KEY)
        .agg(
            F.first("n").alias("n"),
            F.first("n_positive").alias("n_positive"),
            F.first("q_end").alias("q_end"),
            F.first("decline").alias("decline"),
            F.min("base").alias("min_base"),
            F.max_by("q_24h", "production_date").alias("last_rate"),
            _median(F.col("q_24h")).alias("reference_rate"),
            _median(F.col("trailing")).alias("trailing_median"),
            *_band("trailing", "trailing"),
            *_band("off_exp", "exp"),
            *_band("off_hyp", "hyp"),
            F.count("ratio").alias("n_control"),
            _median(F.col("ratio")).alias("ratio_median"),
            _median(F.col("controlled")).alias("control_level"),
            *_band("controlled", "control"),
        )
    )


def _fit(model: str, possible: Column, q: Column, low: Column, high: Column, **more: Column) -> Column:
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    body = F.struct(
        F.lit(model).alias("model"),
        q.alias("q_at_fit"),
        more.get("decline", zero).alias("decline_rate"),
        more.get("b", zero).alias("hyperbolic_b"),
        low.alias("lower_offset"),
        high.alias("upper_offset"),
        more.get("per_choke", none).alias("rate_per_choke"),
        more.get("widens", F.lit(True)).alias("widens"),
    )
    return F.when(possible, body)


def fit_models(rows: DataFrame, models=fixed.MODELS) -> DataFrame:
    """Parameters per (window, model); a window a model cannot be fitted on has no row for it.

    `rows` are classified days with their window bounds (`windows.window_days`).
    """
    c = F.col
    flat = F.lit(False)
    trended = (c("n_positive") >= fixed.MIN_FIT_POINTS) & c("decline").isNotNull()
    falling = c("decline") > 0.0
    fits = {
        "naive-median28": _fit(
            "naive-median28",
            c("n") > 0,
            c("trailing_median"),
            c("trailing_low") - c("trailing_median"),
            c("trailing_high") - c("trailing_median"),
            widens=flat,
        ),
        "naive-persistence": _fit(
            "naive-persistence",
            c("n") > 0,
            c("last_rate"),
            c("trailing_low") - c("last_rate"),
            c("trailing_high") - c("last_rate"),
            widens=flat,
        ),
        "exponential-decline": _fit(
            "exponential-decline", trended, c("q_end"), c("exp_low"), c("exp_high"), decline=c("decline")
        ),
        "hyperbolic-decline": _fit(
            "hyperbolic-decline",
            trended & (~falling | (c("min_base") > 0.0)),
            c("q_end"),
            F.when(falling, c("hyp_low")).otherwise(c("exp_low")),
            F.when(falling, c("hyp_high")).otherwise(c("exp_high")),
            decline=F.when(falling, c("decline")).otherwise(F.lit(0.0)),
            b=F.when(falling, F.lit(fixed.HYPERBOLIC_B)).otherwise(F.lit(0.0)),
        ),
        "choke-scaled": _fit(
            "choke-scaled",
            c("n_control") >= fixed.MIN_FIT_POINTS,
            c("control_level"),
            c("control_low") - c("control_level"),
            c("control_high") - c("control_level"),
            per_choke=c("ratio_median"),
        ),
    }
    chosen = F.array_compact(F.array(*[fits[m] for m in models]))
    return (
        fit_summaries(rows)
        .select(*WINDOW_KEY, "reference_rate", F.explode(chosen).alias("f"))
        .select(*WINDOW_KEY, "reference_rate", "f.*")
    )
