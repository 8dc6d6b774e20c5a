"""Model prediction and evidence-free statistics as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_rate(fit, step: Column, choke: Column) -> Column:
    """Rate expected `step` days after the fit. `fit(name)` gives a parameter column."""
    t = step.cast("double")
    b, d, q0 = fit("hyperbolic_b"), fit("decline_rate"), fit("q_at_fit")
    base = F.greatest(F.lit(1.0) + b * d * t, F.lit(1e-9))
    q = (
        F.when(fit("rate_per_choke").isNotNull() & choke.isNotNull(), fit("rate_per_choke") * choke)
        .when(b > 0.0, q0 / F.pow(base, F.lit(1.0) / b))
        .when(d != 0.0, q0 * F.exp(-d * t))
        .otherwise(q0)
    )
    return F.greatest(q, F.lit(0.0))


def spread(fit, step: Column) -> Column:
    widened = F.sqrt(F.greatest(step.cast("double"), F.lit(1.0)))
    return F.when(fit("widens"), widened).otherwise(F.lit(1.0))


def lower_bound(fit, q: Column, step: Column) -> Column:
    return F.greatest(q + fit("lower_offset") * spread(fit, step), F.lit(0.0))


def upper_bound(fit, q: Column, step: Column) -> Column:
    return F.greatest(q + fit("upper_offset") * spread(fit, step), q)


def wape(actual: Column, predicted: Column) -> Column:
    """Aggregate: absolute error over absolute actual; null when the actuals sum to zero."""
    return F.sum(F.abs(actual - predicted)) / F.nullif(F.sum(F.abs(actual)), F.lit(0.0))
