"""Label joins, agreement, class scores, bootstrap margin, selection conditions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions.days import fired
from daytrace.operators.events import echo_state_detail, echo_subcategory

NOT_STATED = "not_stated"


def join_to_events(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Labels with their event's comment and `problems` (empty when the label is sound)."""
    known = events.select("event_id", F.col("comment").alias("_comment"), F.lit(True).alias("_known"))
    stated = F.col("cause") != NOT_STATED
    span = F.col("evidence_span")
    problems = fired(
        (F.col("_known").isNull(), "event_not_in_store"),
        (~F.col("cause").isin(*fixed.CAUSES), "unknown_cause"),
        (
            F.col("label_source").isNull() | ~F.col("label_source").isin(*fixed.LABEL_SOURCES),
            "unknown_label_source",
        ),
        (~stated & span.isNotNull(), "span_without_cause"),
        (stated & span.isNull(), "cause_without_span"),
        (F.col("_known") & span.isNotNull() & ~F.contains(F.col("_comment"), span), "span_not_verbatim"),
    )
    return (
        labels.join(known, "event_id", "left")
        .withColumn("problems", problems)
        .withColumnRenamed("_comment", "comment")
        .drop("_known")
    )


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: shared events and how many carry the same cause."""
    other = second.select("event_id", F.col("cause").alias("_other"))
    return first.join(other, "event_id").agg(
        F.count_if(F.col("cause") == F.col("_other")).alias("agreeing"), F.count(F.lit(1)).alias("shared")
    )


def class_scores(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Support, precision, recall and F1 per class that occurs in `gold`.

    Everything after the first count works on the confusion table.
    """
    n = F.col("n")
    cells = pairs.groupBy(*by, F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("g").alias("label"),
            n.alias("support"),
            F.when(F.col("g") == F.col("p"), n).otherwise(zero).alias("hits"),
            zero.alias("claimed"),
        ),
        F.struct(F.col("p").alias("label"), zero.alias("support"), zero.alias("hits"), n.alias("claimed")),
    )
    counts = (
        cells.select(*by, F.explode(sides).alias("s"))
        .groupBy(*by, F.col("s.label").alias("label"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "hits", "claimed")])
        .where("support > 0")
    )
    p, r = F.col("precision"), F.col("recall")
    return (
        counts.withColumn(
            "precision", F.coalesce(F.col("hits") / F.nullif(F.col("claimed"), F.lit(0)), F.lit(0.0))
        )
        .withColumn("recall", F.col("hits") / F.col("support"))
        .withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
        .withColumn("in_macro_average", F.col("support") >= fixed.MIN_CLASS_SUPPORT)
        .drop("hits", "claimed")
    )


def macro_f1(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counted = F.when(F.col("in_macro_average"), F.col("f1"))
    return scores.groupBy(*by).agg(
        F.coalesce(F.avg(counted), F.lit(0.0)).alias("macro_f1"), F.count(counted).alias("classes_in_average")
    )


def _macro_from_counts(draws: np.ndarray, gold: np.ndarray, said: np.ndarray, classes: int) -> np.ndarray:
    """Macro-F1 per row of `draws` (samples x cells)."""
    eye = np.eye(classes)
    support = draws @ eye[gold]
    claimed = draws @ eye[said]
    hits = draws @ (eye[gold] * (gold == said)[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        f1 = np.where(support + claimed > 0, 2 * hits / (support + claimed), 0.0)
    counted = support >= fixed.MIN_CLASS_SUPPORT
    total = counted.sum(axis=1)
    return np.where(total > 0, (f1 * counted).sum(axis=1) / np.maximum(total, 1), 0.0)


def bootstrap_margin(
    spark: SparkSession,
    pairs: DataFrame,
    *,
    gold: str = "gold",
    candidate: str = "candidate",
    baseline: str = "baseline",
    samples: int = fixed.BOOTSTRAP_SAMPLES,
    seed: int = fixed.SAMPLE_SEED,
) -> DataFrame:
    """One row: 95 % bootstrap interval of the macro-F1 advantage of candidate over baseline.

    Drawing n rows with replacement is a multinomial draw over the distinct (gold, candidate,
    baseline) cells, of which there are at most 12 cubed. So the events are only counted once and
    each resample costs the same whether there are a hundred events or a trillion.
    """
    causes = F.array(*[F.lit(c) for c in fixed.CAUSES])

    def code(name: str) -> Column:
        return F.array_position(causes, F.col(name)) - 1

    cells = pairs.groupBy(code(gold).alias("g"), code(candidate).alias("c"), code(baseline).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    packed = cells.agg(F.array_sort(F.collect_list(F.struct("g", "c", "b", "n"))).alias("cells"))
    classes = len(fixed.CAUSES)

    @F.pandas_udf("double")
    def advantage(sample: pd.Series, table: pd.Series) -> pd.Series:
        rows = table.iloc[0]
        g, c, b, n = (np.array([row[k] for row in rows], dtype=np.int64) for k in ("g", "c", "b", "n"))
        draws = np.stack(
            [np.random.default_rng([seed, int(s)]).multinomial(n.sum(), n / n.sum()) for s in sample]
        )
        return pd.Series(_macro_from_counts(draws, g, c, classes) - _macro_from_counts(draws, g, b, classes))

    drawn = spark.range(samples).select(
        advantage(F.col("id"), packed.select("cells").scalar()).alias("difference")
    )
    ordered = F.array_sort(F.collect_list("difference"))
    low, high = int(0.025 * samples), min(samples - 1, int(0.975 * samples))
    return drawn.agg(ordered.alias("d")).select(
        F.get("d", F.lit(low)).alias("low"), F.get("d", F.lit(high)).alias("high")
    )


def selection_permitted(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.coalesce(F.every(F.col("label_source") == "expert"), F.lit(True)).alias("permitted"))


def selection_conditions(
    spark: SparkSession,
    labelled: DataFrame,
    baselines: Sequence[str],
    *,
    candidate: str = "candidate",
    forced: str = "forced",
) -> DataFrame:
    """The four conditions as rows (name, passed, gates, value).

    `labelled` holds cause, label_source, evidence_span, comment and one prediction column per
    candidate, forced choice and baseline. The first two conditions do not gate while any label
    is not an expert's.
    """
    long = labelled.select(
        F.col("cause").alias("gold"),
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("who"), F.col(n).alias("said")) for n in (candidate, *baselines)])
        ).alias("x"),
    ).select("gold", "x.who", "x.said")
    macro = macro_f1(class_scores(long, "gold", "said", ["who"]), ["who"])
    own = F.max(F.when(F.col("who") == candidate, F.col("macro_f1")))
    best = F.max(F.when(F.col("who") != candidate, F.col("macro_f1")))
    order = F.array_position(F.array(*[F.lit(b) for b in baselines]), F.col("who"))
    first_best = F.max_by(
        F.when(F.col("who") != candidate, F.col("who")),
        F.when(F.col("who") != candidate, F.struct("macro_f1", (-order).alias("o"))),
    )
    margin = macro.agg(own.alias("own"), best.alias("best"), first_best.alias("best_name"))
    gain = (
        F.when(F.col("best") > 0, (F.col("own") - F.col("best")) / F.col("best"))
        .when(F.col("own") > 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )
    permitted = selection_permitted(labelled).select("permitted").scalar()
    one = margin.select(
        F.lit("relative macro-F1 margin").alias("name"),
        (gain >= fixed.RELATIVE_MARGIN).alias("passed"),
        permitted.alias("gates"),
        gain.alias("value"),
    )
    named = margin.select("best_name").scalar()
    rival = F.coalesce(*[F.when(named == b, F.col(b)) for b in baselines])
    resampled = bootstrap_margin(
        spark,
        labelled.select(
            F.col("cause").alias("gold"), F.col(candidate).alias("candidate"), rival.alias("baseline")
        ),
    )
    two = resampled.select(
        F.lit("margin survives resampling").alias("name"),
        (F.col("low") > 0).alias("passed"),
        permitted.alias("gates"),
        F.col("low").alias("value"),
    )
    named_cause = F.col(candidate) != NOT_STATED
    sound = F.coalesce(F.contains(F.col("comment"), F.col("evidence_span")), F.lit(False))
    three = labelled.where(named_cause).agg(
        F.lit("evidence spans verbatim").alias("name"),
        (F.coalesce(F.every(sound), F.lit(False))).alias("passed"),
        F.lit(True).alias("gates"),
        F.count_if(~sound).cast("double").alias("value"),
    )

    def precision(who: str) -> Column:
        said = F.col(who) != NOT_STATED
        right = F.count_if(said & (F.col(who) == F.col("cause")))
        return F.coalesce(right / F.nullif(F.count_if(said), F.lit(0)), F.lit(0.0))

    stated = F.col("cause") != NOT_STATED
    four = labelled.agg(
        F.count_if(stated).alias("s"),
        F.count_if(stated & named_cause).alias("a"),
        (precision(candidate) - precision(forced)).alias("margin"),
    ).select(
        F.lit("abstention").alias("name"),
        F.coalesce(
            (F.col("a") / F.nullif(F.col("s"), F.lit(0)) >= fixed.MIN_COVERAGE)
            & (F.col("margin") >= fixed.PRECISION_MARGIN),
            F.lit(False),
        ).alias("passed"),
        F.lit(True).alias("gates"),
        F.col("margin").alias("value"),
    )
    return one.unionByName(two).unionByName(three).unionByName(four)


def approach_selected(conditions: DataFrame) -> DataFrame:
    """Selected only if there are conditions, all of them gate, and all pass."""
    return conditions.agg(F.coalesce(F.every(F.col("gates") & F.col("passed")), F.lit(False)).alias("selected"))


def distribution(labels: DataFrame, column: str = "cause", values: Sequence[str] = fixed.CAUSES) -> DataFrame:
    """Rows per value, zero for values that never occur."""
    counted = labels.agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return counted.unpivot([], list(values), column, "rows")


def baseline_report(labelled: DataFrame) -> DataFrame:
    """One row: agreement of the labels with both echo baselines, and of these with each other.

    `labelled` holds cause, subcategory, state_detail and source_coding_looks_wrong.
    """
    rows = labelled.withColumn("_one", echo_subcategory(F.col("subcategory"))).withColumn(
        "_two", echo_state_detail(F.col("state_detail"))
    )
    same, cause = F.col("_one") == F.col("_two"), F.col("cause")
    abstains, asserts = same & (F.col("_one") == NOT_STATED), same & (F.col("_one") != NOT_STATED)
    return rows.agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if(cause != NOT_STATED).alias("stated_cause_events"),
        F.count_if(cause == F.col("_one")).alias("exact_subcategory"),
        F.count_if(cause == F.col("_two")).alias("exact_state_detail"),
        F.count_if(same).alias("consensus"),
        F.count_if(same & (cause == F.col("_one"))).alias("labels_match_consensus"),
        F.count_if(abstains).alias("consensus_abstained"),
        F.count_if(abstains & (cause != NOT_STATED)).alias("abstained_labels_name_a_cause"),
        F.count_if(asserts).alias("consensus_asserted"),
        F.count_if(asserts & (cause == F.col("_one"))).alias("asserted_labels_agree"),
        F.count_if(asserts & (cause == NOT_STATED)).alias("asserted_labels_not_stated"),
        F.count_if((F.col("_one") != NOT_STATED) & (F.col("_one") != cause)).alias("subcategory_contradicts"),
        F.count_if(F.coalesce("source_coding_looks_wrong", F.lit(False))).alias("source_coding_flagged"),
    )


def rule_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.coalesce("applied_rule", F.lit("None")).alias("applied_rule")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def note_counts(labels: DataFrame) -> DataFrame:
    """One row: labels with a note, and notes that name another class than the one assigned."""
    noted = F.coalesce("cause_notes", F.lit("")) != ""
    other = F.exists(
        F.array(*[F.lit(c) for c in fixed.CAUSES]),
        lambda c: F.contains(F.col("cause_notes"), c) & (c != F.col("cause")),
    )
    return labels.agg(
        F.count_if(noted).alias("rows_with_a_note"),
        F.count_if(noted & F.coalesce(other, F.lit(False))).alias("rows_naming_another_label"),
        F.count("evidence_span").alias("spans_cited"),
    )
