"""Corrections, review log, priority queue, coverage and evidence matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import names
from daytrace.functions import text as ft
from daytrace.functions.days import fired
from daytrace.operators.diagnose import EPISODE

# ---- corrections ------------------------------------------------------------------------


def recorded_value(field: Column) -> Column:
    """What the event says now in the field a correction names."""
    return (
        F.when(field == "category", F.col("activity_code"))
        .when(field == "duration", F.col("duration_hours").cast("string"))
        .when(field == "equipment", F.coalesce("equipment", F.lit("")))
        .when(field == "cause_text", F.col("comment"))
    )


def propose(events: DataFrame, proposals: DataFrame) -> DataFrame:
    """Corrections for (event_id, field, new_value, corrected_by, note), old values as recorded."""
    return proposals.join(events, "event_id").select(
        "event_id",
        "well",
        "field",
        recorded_value(F.col("field")).alias("old_value"),
        "new_value",
        "corrected_by",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("corrected_at"),
        "extractor_version",
        "note",
    )


def correction_reasons(corrections: DataFrame, events: DataFrame) -> DataFrame:
    """Corrections with the reasons each would be refused for (none: admissible)."""
    known = events.select(
        "event_id",
        F.col("well").alias("_event_well"),
        *[F.col(c).alias(c) for c in ("activity_code", "duration_hours", "equipment", "comment")],
    )
    joined = corrections.join(known, "event_id", "left")
    placed = F.col("_event_well").isNotNull()
    text = F.concat_ws(
        " ", *[F.nullif(F.col(c), F.lit("")) for c in ("old_value", "new_value", "note", "corrected_by")]
    )
    reasons = fired(
        (~placed, "unknown_event"),
        (placed & (F.col("_event_well") != F.col("well")), "well_mismatch"),
        (names.is_hold_out(F.col("well")) | (placed & names.is_hold_out(F.col("_event_well"))), "hold_out_well"),
        (placed & ~F.col("old_value").eqNullSafe(recorded_value(F.col("field"))), "stale_old_value"),
        (names.hold_out_mentioned(text).isNotNull(), "hold_out_text"),
    )
    return joined.withColumn("reasons", reasons).select(*corrections.columns, "reasons")


def admit_corrections(corrections: DataFrame, events: DataFrame) -> DataFrame:
    """All or nothing: the batch when no row has a reason, otherwise a failed job naming one."""
    judged = correction_reasons(corrections, events)
    first = judged.where(F.size("reasons") > 0).agg(
        F.min(F.concat_ws(": ", "event_id", F.get("reasons", F.lit(0)))).alias("refusal")
    )
    refusal = first.select("refusal").scalar()
    allowed = F.when(
        refusal.isNotNull(), F.raise_error(F.concat(F.lit("correction batch refused, "), refusal)).cast("string")
    ).otherwise(F.col("event_id"))
    return corrections.withColumn("event_id", allowed)


def batch_outcomes(corrections: DataFrame, events: DataFrame) -> DataFrame:
    """Per batch: rows, refused_rows, the first refusal, and whether it is admitted; one bad row refuses all."""
    judged = correction_reasons(corrections, events)
    bad = F.size("reasons") > 0
    return judged.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("refused_rows"),
        F.min(F.when(bad, F.concat_ws(": ", "event_id", F.get("reasons", F.lit(0))))).alias("first_refusal"),
    ).withColumn("admitted", F.col("refused_rows") == 0)


def admitted_batches(corrections: DataFrame, events: DataFrame) -> DataFrame:
    """The corrections of the batches without a refused row; the others leave nothing behind."""
    refused = correction_reasons(corrections, events).where(F.size("reasons") > 0).select("batch").distinct()
    return corrections.join(refused, "batch", "left_anti")


def usable_corrections(corrections: DataFrame, extractor_version: str | Column) -> DataFrame:
    """Corrections made against an earlier version; an unreadable version is withheld."""
    asking = extractor_version if isinstance(extractor_version, Column) else F.lit(extractor_version)
    return corrections.where(
        names.version_number(F.col("extractor_version")) < names.version_number(asking)
    )


# ---- review log -------------------------------------------------------------------------


def review_states(log: DataFrame, order: str = "recorded_at") -> DataFrame:
    """State per investigation: the first settling action decides."""
    settles = F.col("action").isin(*fixed.SETTLING_ACTIONS)
    first = F.min_by("action", F.when(settles, F.col(order)))
    return log.groupBy("investigation_id").agg(
        first.alias("_first"),
        F.bool_or(F.col("action") == "request_more_evidence").alias("_rerun"),
        F.count_if(F.col("action") == "add_correction").alias("revision"),
    ).select(
        "investigation_id",
        F.when(F.col("_first") == "confirm", "confirmed")
        .when(F.col("_first") == "dismiss", "dismissed")
        .when(F.col("_rerun"), "rerun_requested")
        .otherwise("awaiting_review")
        .alias("review_state"),
        "revision",
    )


def review_reasons(log: DataFrame, new: DataFrame, order: str = "recorded_at") -> DataFrame:
    """New review rows with their revision number and the reasons each would be refused for.

    A row is settled against by the log or by an earlier row of the batch; the first settling row
    is found by aggregation. Only corrections are numbered in order.
    """
    states = review_states(log).select("investigation_id", F.col("review_state").alias("_state"), F.col("revision").alias("_had"))
    settles, corrects = F.col("action").isin(*fixed.SETTLING_ACTIONS), F.col("action") == "add_correction"
    firsts = new.groupBy("investigation_id").agg(F.min(F.when(settles, F.col(order))).alias("_settled_at"))
    ordered = Window.partitionBy("investigation_id").orderBy(order)
    settled = F.col("_state").isin("confirmed", "dismissed") | (F.col(order) > F.col("_settled_at"))
    reasons = fired(
        (~F.col("action").isin(*fixed.REVIEW_ACTIONS), "unknown_action"),
        (F.coalesce(F.trim("actor"), F.lit("")) == "", "no_actor"),
        (settled, "already_settled"),
        (corrects & (F.coalesce(F.trim("note"), F.lit("")) == ""), "correction_without_note"),
    )
    number = F.coalesce("_had", F.lit(0)) + F.sum(corrects.cast("bigint")).over(ordered)
    return (
        new.join(states, "investigation_id", "left")
        .join(firsts, "investigation_id")
        .withColumns({"reasons": reasons, "revision": number})
        .drop("_state", "_had", "_settled_at")
    )


# ---- priority ---------------------------------------------------------------------------


def shortfall_points(shortfall: Column) -> Column:
    return F.when(shortfall >= fixed.LARGE_SHORTFALL, 3).when(shortfall >= fixed.MODERATE_SHORTFALL, 2).otherwise(1)


def scored(rows: DataFrame) -> DataFrame:
    """Add shortfall_points, terms_fired, score and priority.

    Needs cumulative_rate_shortfall_sm3, episode_days, verdict, evidence_band and review_state.
    """
    _, long_term, pending, unresolved = fixed.PRIORITY_TERMS
    terms = fired(
        (F.col("episode_days") >= fixed.LONG_EPISODE_DAYS, long_term),
        (F.col("review_state").isin(*fixed.PENDING_STATES), pending),
        (
            (F.col("verdict") != "supported_explanation") & F.col("evidence_band").isin(*fixed.ATTENTION_BANDS),
            unresolved,
        ),
    )
    return (
        rows.withColumn("shortfall_points", shortfall_points(F.col("cumulative_rate_shortfall_sm3")))
        .withColumn("terms_fired", terms)
        .withColumn("score", F.col("shortfall_points") + F.size("terms_fired"))
        .withColumn(
            "priority",
            F.when(F.col("score") >= fixed.PRIORITY_HIGH, "HIGH")
            .when(F.col("score") >= fixed.PRIORITY_MEDIUM, "MEDIUM")
            .otherwise("LOW"),
        )
    )


def investigation_id(well: Column, onset: Column) -> Column:
    return F.concat_ws("_", F.translate(well, "/ ", "__"), onset)


def queue(episodes: DataFrame, findings: DataFrame, scores: DataFrame, log: DataFrame) -> DataFrame:
    """Episodes with verdict, evidence band, review state and priority, in queue order."""
    keyed = episodes.withColumn("investigation_id", investigation_id(F.col("well"), F.col("onset"))).withColumn(
        "episode_days", F.datediff("offset", "onset") + 1
    )
    rows = (
        keyed.join(findings.select(*EPISODE, "verdict", "highest_level"), EPISODE, "left")
        .join(scores.select(*EPISODE, F.col("band").alias("evidence_band")), EPISODE, "left")
        .join(review_states(log).select("investigation_id", "review_state"), "investigation_id", "left")
        .fillna("unknown", ["evidence_band"])
        .fillna("none", ["review_state"])
        .withColumn("data_quality", F.when(F.col("poorly_evidenced"), "Degraded").otherwise("Complete"))
    )
    return in_queue_order(scored(rows))


def in_queue_order(rows: DataFrame) -> DataFrame:
    place = F.array_position(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), F.col("priority"))
    return rows.orderBy(place, F.desc("cumulative_rate_shortfall_sm3"), "well", "onset")


def term_counts(queued: DataFrame) -> DataFrame:
    """How often each term fired; the shortfall term counts every row."""
    names_ = {f"t{i}": t for i, t in enumerate(fixed.PRIORITY_TERMS)}
    one = queued.agg(
        F.count(F.lit(1)).alias("t0"),
        *[
            F.count_if(F.array_contains("terms_fired", t)).alias(k)
            for k, t in list(names_.items())[1:]
        ],
    )
    lookup = F.create_map(*[F.lit(x) for p in names_.items() for x in p])
    return one.unpivot([], list(names_), "k", "episodes").select(lookup[F.col("k")].alias("term"), "episodes")


def queue_kpis(queued: DataFrame) -> DataFrame:
    """One row of headline figures. No currency figure appears without a stated price."""
    settled = F.col("review_state").isin("confirmed", "dismissed")
    return queued.agg(
        F.count(F.lit(1)).alias("open_investigations"),
        F.count_if(~settled).alias("awaiting_review"),
        F.count_if(F.col("review_state") != "none").alias("reviews_recorded"),
        F.coalesce(F.sum(F.round("cumulative_rate_shortfall_sm3", 2)), F.lit(0.0)).alias("cumulative_rate_shortfall_sm3"),
        F.coalesce(F.sum(F.round("deferred_volume_sm3", 2)), F.lit(0.0)).alias("deferred_volume_sm3"),
        F.count_if(F.col("verdict") == "insufficient_evidence").alias("no_conclusion_issued"),
        F.count_distinct("well").alias("wells_with_an_episode"),
    )


# ---- coverage and matrix ----------------------------------------------------------------


def coverage_lines(findings: DataFrame, bundle: DataFrame) -> DataFrame:
    """Per finding: lines on what was available and on what was missing."""

    def line(c: Column) -> Column:
        return ft.filled("usable_days", c["channel"], c["readings"], c["days"])

    available = F.transform(F.filter("channels", lambda c: c["readings"] > 0), line)
    gone = F.transform(F.filter("channels", lambda c: c["readings"] == 0), line)
    missing = F.concat(gone, F.col("missing_evidence"))
    undecided = (F.size(missing) == 0) & (F.col("verdict") == "insufficient_evidence")
    reason = F.when(F.col("stop_reason") == "evidence_exhausted", ft.filled("nothing_missing")).otherwise(
        ft.filled("stopped_on", F.col("stop_reason"))
    )
    return findings.join(bundle, EPISODE).select(
        "finding_id",
        *EPISODE,
        "verdict",
        available.alias("available"),
        F.when(undecided, F.array(reason)).otherwise(missing).alias("missing"),
    )


def matrix_cells(hypotheses: DataFrame, passes: DataFrame) -> DataFrame:
    """One cell per hypothesis and evidence family, absence recorded as what kind of absence."""
    made = passes.select(*EPISODE, "hypothesis_id", F.lit(True).alias("_searched")).distinct()
    home = F.create_map(*[F.lit(x) for k, v in fixed.HYPOTHESIS_HOME.items() for x in (k, v[0])])
    feature = F.create_map(*[F.lit(x) for k, v in fixed.HYPOTHESIS_HOME.items() for x in (k, v[1])])
    key = F.col("hypothesis_id")
    has_value = F.try_element_at("strength_features", feature[key]).isNotNull()
    own = (
        F.when(has_value & (F.col("status") == "supported"), "supports")
        .when(has_value & (F.col("status") == "contradicted"), "contradicts")
        .otherwise("neutral")
    )
    report = (
        F.when(F.size("supporting") > 0, "supports")
        .when(F.col("_searched"), "none_found")
        .otherwise("not_searched")
    )
    cell = (
        F.when(F.col("family") == "Report", report)
        .when(F.col("family") == home[key], own)
        .otherwise("not_applicable")
    )
    families = F.array(*[F.lit(f) for f in fixed.EVIDENCE_FAMILIES])
    return (
        hypotheses.join(made, [*EPISODE, "hypothesis_id"], "left")
        .withColumn("family", F.explode(families))
        .select(*EPISODE, "position", "hypothesis_id", "status", "family", cell.alias("cell"))
    )


def matrix(hypotheses: DataFrame, passes: DataFrame) -> DataFrame:
    """The same, one row per hypothesis and one column per family."""
    return (
        matrix_cells(hypotheses, passes)
        .groupBy(*EPISODE, "position", "hypothesis_id", "status")
        .pivot("family", list(fixed.EVIDENCE_FAMILIES))
        .agg(F.first("cell"))
    )
