"""Audits. Each gives outcome rows (check, examined, problems, passed, vacuous) or the problems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import names
from daytrace.functions import text as ft
from daytrace.functions.days import fired
from daytrace.operators.diagnose import EPISODE
from daytrace.operators.facts import lineage_problems


def outcome(rows: DataFrame, check: str, problem: Column) -> DataFrame:
    """One outcome row: rows examined and rows with a problem (a null test is a problem)."""
    bad = F.count_if(F.coalesce(problem, F.lit(True)))
    return rows.agg(F.count(F.lit(1)).alias("examined"), bad.alias("problems")).select(
        F.lit(check).alias("check"),
        "examined",
        "problems",
        (F.col("problems") == 0).alias("passed"),
        ((F.col("problems") == 0) & (F.col("examined") == 0)).alias("vacuous"),
    )


def all_outcomes(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- leakage ----------------------------------------------------------------------------


def labels_from_hold_out(labelled_wells: DataFrame) -> DataFrame:
    return outcome(labelled_wells, "hold_out_well_in_a_label", names.is_hold_out_label(F.col("well")))


def labels_after_boundary(labelled: DataFrame, boundary: str = fixed.SPLIT_BOUNDARY) -> DataFrame:
    late = F.col("report_date") > F.lit(boundary).cast("date")
    return outcome(labelled, "labelled_report_after_the_boundary", late)


def fitted_dates(*runs: DataFrame) -> DataFrame:
    """The dates that any of several runs was fitted on, each well and date once."""
    every = runs[0].select("well", "production_date")
    for run in runs[1:]:
        every = every.unionByName(run.select("well", "production_date"))
    return every.distinct()


def fitted_outside_development(fitted: DataFrame, split: DataFrame) -> DataFrame:
    """Fitted dates at or after the end of development; no dates at all is a problem itself."""
    end = split.select("development_end").scalar()
    found = outcome(fitted, "fitted_day_outside_development", F.col("production_date") >= end)
    none = F.col("examined") == 0
    return found.select(
        "check",
        "examined",
        F.when(none, F.lit(1)).otherwise(F.col("problems")).cast("bigint").alias("problems"),
        (F.col("passed") & ~none).alias("passed"),
        F.lit(False).alias("vacuous"),
    )


def fitted_outside_by_well(fitted: DataFrame, split: DataFrame) -> DataFrame:
    end = split.select("development_end").scalar()
    return (
        fitted.where(F.col("production_date") >= end)
        .groupBy("well")
        .agg(F.count(F.lit(1)).alias("dates_outside"), F.min("production_date").alias("first_outside"))
    )


def corrections_from_hold_out(corrections: DataFrame) -> DataFrame:
    return outcome(corrections, "correction_from_the_hold_out", names.is_hold_out_label(F.coalesce("well", F.lit(""))))


def hold_out_investigated(wells: DataFrame) -> DataFrame:
    return outcome(
        wells.select("well").distinct(), "hold_out_well_reaches_an_investigation", names.is_hold_out_label(F.col("well"))
    )


def hold_out_label_file(files: DataFrame) -> DataFrame:
    return outcome(files, "hold_out_label_file_exists", F.lower("file_name").rlike("hold.*out"))


# ---- register ---------------------------------------------------------------------------


def corpus_not_empty(walked: DataFrame, events: DataFrame, register: DataFrame) -> DataFrame:
    """Wells walked, events stored, recurring patterns found: none of the three may be zero."""
    sizes = (
        walked.agg(F.count(F.lit(1)).alias("n"))
        .unionAll(events.agg(F.count(F.lit(1)).alias("n")))
        .unionAll(register.where("recurring").agg(F.count(F.lit(1)).alias("n")))
    )
    return sizes.agg(F.sum("n").alias("examined"), F.count_if(F.col("n") == 0).alias("problems")).select(
        F.lit("corpus_not_empty").alias("check"),
        "examined",
        "problems",
        (F.col("problems") == 0).alias("passed"),
        F.lit(False).alias("vacuous"),
    )


def citation_problems(register: DataFrame, events: DataFrame, pattern_wells: DataFrame) -> DataFrame:
    """Register rows with the reasons their citation does not hold."""
    cited = events.select(
        F.col("event_id").alias("cited_event_id"),
        F.col("well").alias("_well"),
        F.col("source_document").alias("_document"),
        F.col("comment").alias("_comment"),
    )
    members = pattern_wells.select(
        "subcategory", "detail_state", F.col("well").alias("cited_well"), F.lit(True).alias("_member")
    )
    joined = register.join(cited, "cited_event_id", "left").join(
        members, ["subcategory", "detail_state", "cited_well"], "left"
    )
    known = F.col("_document").isNotNull()
    blank = F.trim("cited_span") == ""
    reasons = fired(
        (~known, "event_not_in_store"),
        (known & blank, "empty_span"),
        (known & ~blank & ~F.contains(F.col("_comment"), F.col("cited_span")), "span_not_verbatim"),
        (known & (F.col("_document") != F.col("cited_document")), "wrong_document"),
        (known & ((F.col("_well") != F.col("cited_well")) | F.col("_member").isNull()), "wrong_well"),
    )
    return joined.select("subcategory", "detail_state", "recurring", "cited_event_id", reasons.alias("reasons"))


def citations_resolve(register: DataFrame, events: DataFrame, pattern_wells: DataFrame) -> DataFrame:
    judged = citation_problems(register, events, pattern_wells)
    return outcome(judged, "citations_resolve", F.size("reasons") > 0)


def hold_out_contained(*wells: DataFrame) -> DataFrame:
    """No held-out name in any of the given well columns."""
    names_ = wells[0].select("well")
    for more in wells[1:]:
        names_ = names_.unionByName(more.select("well"))
    return outcome(names_, "hold_out_contained", names.is_hold_out(F.col("well")))


def currency_disclosed(rows: DataFrame) -> DataFrame:
    """A money figure needs a finite value, a positive rate and a stated assumption.

    Columns cost_equivalent_usd, cost_assumption and day_rate_usd; only rows with a figure count
    as examined, but a lone assumption is a problem too.
    """
    amount, assumption, rate = (F.col(c) for c in ("cost_equivalent_usd", "cost_assumption", "day_rate_usd"))
    unsound = (
        F.isnan(amount)
        | (F.abs(amount) == float("inf"))
        | ~F.coalesce(rate > 0, F.lit(False))
        | ~F.coalesce(F.contains(assumption, F.lit("stated assumption")), F.lit(False))
    )
    bad = (amount.isNull() != assumption.isNull()) | (amount.isNotNull() & unsound)
    return rows.agg(
        F.count_if(amount.isNotNull()).alias("examined"), F.count_if(F.coalesce(bad, F.lit(True))).alias("problems")
    ).select(
        F.lit("currency_disclosed").alias("check"),
        "examined",
        "problems",
        (F.col("problems") == 0).alias("passed"),
        ((F.col("problems") == 0) & (F.col("examined") == 0)).alias("vacuous"),
    )


def same_rows(check: str, first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables hold the same rows, copies counted: one grouping over their union."""
    both = (
        first.select(*columns, F.lit(1).alias("_n"))
        .unionByName(second.select(*columns, F.lit(-1).alias("_n")))
        .groupBy(*columns)
        .agg(F.sum("_n").alias("_n"))
    )
    return outcome(both, check, F.col("_n") != 0)


def register_reproducible(register: DataFrame, rebuilt: DataFrame) -> DataFrame:
    columns = [c for c in register.columns if c not in ("labelled_fraction", "miscoded_fraction")]

    def stable(rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: F.round(c, 6) for c in ("total_hours", "cited_hours")})

    return same_rows("register_reproducible", stable(register), stable(rebuilt), columns)


def reconciles(reconciled: DataFrame) -> DataFrame:
    sound = F.col("categories_sum") & F.col("hours_agree") & F.col("counts_agree")
    return outcome(reconciled, "categories_reconcile", ~sound)


# ---- findings ---------------------------------------------------------------------------


def provenance_violations(
    findings: DataFrame,
    hypotheses: DataFrame,
    citations: DataFrame,
    facts: DataFrame,
    inputs: DataFrame,
    documents: DataFrame,
    window_days: int = fixed.EVIDENCE_WINDOW_DAYS,
) -> DataFrame:
    """(finding_id, rule, detail) for every rule a finding breaks.

    `citations` (well, onset, field, fact_id) are the facts a finding quotes; `documents`
    (event_id, source_document, well, report_date, text) are the texts it may quote.
    """
    ids = findings.select("finding_id", *EPISODE)
    quoted = citations.join(ids.select("finding_id", "well", "onset"), ["well", "onset"])
    problems = lineage_problems(quoted, facts, inputs)
    lineage_rows = quoted.join(problems, "fact_id").select(
        "finding_id",
        F.when(F.col("problem") == "no_such_fact", "fact_not_in_ledger").otherwise("broken_lineage").alias("rule"),
        F.concat_ws(" ", "field", "fact_id", "problem").alias("detail"),
    )
    refs = (
        hypotheses.join(ids, EPISODE)
        .select("finding_id", *EPISODE, "hypothesis_id", F.explode("supporting").alias("r"))
        .select("finding_id", *EPISODE, "hypothesis_id", F.col("r.document").alias("document"), F.col("r.event_id").alias("event_id"), F.col("r.span").alias("span"))
    )
    texts = documents.select(
        "event_id",
        F.col("source_document").alias("_document"),
        F.col("well").alias("_well"),
        F.col("report_date").alias("_date"),
        F.col("text").alias("_text"),
        F.lit(True).alias("_known"),
    )
    complete = F.col("span").isNotNull() & F.col("event_id").isNotNull()
    held = F.col("_known").isNotNull()
    short = F.regexp_replace("well", r" [^ ]{0,3}$", "")
    outside = ~F.col("_date").between(F.date_sub("onset", window_days), F.date_add("offset", window_days))
    rules = fired(
        (~complete, "incomplete_citation"),
        (complete & ~held, "document_not_available"),
        (complete & held & ~F.contains(F.col("_text"), F.col("span")), "span_not_verbatim"),
        (complete & held & (F.col("document") != F.col("_document")), "document_name_wrong"),
        (complete & held & (F.col("_well") != F.col("well")) & (F.col("_well") != short), "citation_from_another_well"),
        (complete & held & outside, "citation_outside_the_window"),
    )
    citation_rows = (
        refs.join(texts, "event_id", "left")
        .select("finding_id", F.explode(rules).alias("rule"), F.concat_ws(" ", "hypothesis_id", "event_id").alias("detail"))
    )
    unbacked = (
        hypotheses.join(ids, EPISODE)
        .where((F.col("status") == "supported") & F.array_contains("unavailable_channels", F.col("required_channel")))
        .select(
            "finding_id",
            F.lit("supported_without_mandatory_channel").alias("rule"),
            F.concat_ws(" ", "hypothesis_id", "required_channel").alias("detail"),
        )
    )
    disclaims = (F.col("highest_level") == "documented_root_cause") & F.contains(
        F.lower("narrative"), F.lit("root cause unresolved")
    )
    own_rules = fired(
        (disclaims, "documented_level_disclaims_itself"),
        (F.size(ft.wording_above_level(F.col("narrative"), F.col("highest_level"))) > 0, "root_cause_wording_above_level"),
        (F.col("curtailed") != F.col("stop_reason").isin(*fixed.CURTAILED), "stop_reason_not_declared"),
    )
    own = findings.select("finding_id", F.explode(own_rules).alias("rule"), F.lit("").alias("detail"))
    prose = findings.select(
        "finding_id",
        F.explode(
            F.concat(
                F.array("narrative", "recommended_next_check"), F.col("what_would_change_the_conclusion"), F.col("missing_evidence")
            )
        ).alias("text"),
    )
    stray = (
        prose.withColumn("n", ft.stray_numbers(F.col("text")))
        .where(F.size("n") > 0)
        .select("finding_id", F.lit("unsourced_number_in_prose").alias("rule"), F.array_join("n", ", ").alias("detail"))
    )
    return lineage_rows.unionByName(citation_rows).unionByName(unbacked).unionByName(own).unionByName(stray)


def provenance_gate(findings: DataFrame, violations: DataFrame) -> DataFrame:
    """Per finding: number of violations and whether the gate lets it pass."""
    found = violations.groupBy("finding_id").agg(F.count(F.lit(1)).alias("violations"))
    return (
        findings.select("finding_id")
        .join(found, "finding_id", "left")
        .fillna(0, ["violations"])
        .withColumn("gate_passed", F.col("violations") == 0)
    )


def safety(findings: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One row: documented claims, incidents of two kinds, abstentions, weighted cost."""
    documented = (F.col("status") == "supported") & (F.col("causal_level") == "documented_root_cause")
    claims = (
        hypotheses.where(documented)
        .groupBy(*EPISODE)
        .agg(F.bool_or(F.exists("supporting", lambda s: ft.states_a_reason(s["span"]))).alias("_reason"))
    )
    rows = findings.join(claims, EPISODE, "left")
    unreasoned = F.count_if(~F.col("_reason"))
    above = F.count_if(F.size(ft.wording_above_level(F.col("narrative"), F.col("highest_level"))) > 0)
    return rows.agg(
        F.count(F.lit(1)).alias("findings_examined"),
        F.count("_reason").alias("documented_claims"),
        unreasoned.alias("documented_claim_without_a_stated_reason"),
        above.alias("root_cause_claimed_above_its_level"),
        F.count_if(F.col("verdict") == "insufficient_evidence").alias("abstentions"),
        (F.lit(fixed.FALSE_CLAIM_WEIGHT) * (unreasoned + above)).alias("weighted_cost"),
    )


def abstentions_explained(coverage: DataFrame) -> DataFrame:
    """A finding without conclusion lists both what it had and what it lacked, no blank lines."""
    blank = F.exists("missing", lambda line: F.trim(line) == "")
    bad = (F.size("available") == 0) | (F.size("missing") == 0) | blank
    return outcome(coverage.where("verdict = 'insufficient_evidence'"), "abstentions_explained", bad)


def money_sound(tiles: DataFrame) -> DataFrame:
    """Tiles (amount, assumption, reason): a figure is finite, not negative and has its assumption;
    a missing figure has its reason."""
    amount = F.col("amount")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unsound = F.isnan(amount) | (F.abs(amount) == float("inf")) | (amount < 0) | blank("assumption")
    return outcome(tiles, "money_sound", F.when(amount.isNull(), blank("reason")).otherwise(unsound))


def no_hold_out_in_text(texts: DataFrame, column: str = "text", hold_out: Sequence[str] = fixed.HOLD_OUT_WELLS) -> DataFrame:
    """No served text names a held-out well, in full or by its part after the block."""
    bad = F.lit(False)
    for well in hold_out:
        short = well.split("-", 1)[1]
        bad = bad | F.contains(F.col(column), F.lit(well)) | F.col(column).rlike(rf"\b{short}\b")
    return outcome(texts, "no_hold_out_in_text", bad)


def priority_as_printed(queued: DataFrame) -> DataFrame:
    """The stored score equals the rule written out again by hand."""
    loss = F.col("cumulative_rate_shortfall_sm3")
    longhand = (
        1
        + (loss >= 10000).cast("int")
        + (loss >= 30000).cast("int")
        + (F.col("episode_days") >= 40).cast("int")
        + F.col("review_state").isin("awaiting_review", "rerun_requested").cast("int")
        + ((F.col("verdict") != "supported_explanation") & F.col("evidence_band").isin("high", "moderate")).cast("int")
    )
    return outcome(queued, "priority_as_printed", longhand != F.col("score"))


# ---- recorded steps ---------------------------------------------------------------------


def stage_order_problems(
    steps: DataFrame,
    run: Sequence[str] = ("run",),
    stages: Sequence[str] = fixed.STAGES,
    loop: Sequence[str] = fixed.LOOP_STAGES,
    opens: str = "form_hypotheses",
    closes: str = "compose_finding",
) -> DataFrame:
    """Runs whose recorded stages repeat, swap, or loop outside their bounds.

    First and last positions per stage are all that is needed, so a run is never ordered or
    gathered, only aggregated.
    """
    once = [s for s in stages if s not in loop]
    stage, at = F.col("stage"), F.col("index")
    looping = stage.isin(*loop)
    firsts = steps.groupBy(*run).agg(
        *[F.min(F.when(stage == s, at)).alias(f"_f_{i}") for i, s in enumerate(once)],
        *[F.count_if(stage == s).alias(f"_n_{i}") for i, s in enumerate(once)],
        F.min(F.when(looping, at)).alias("_loop_first"),
        F.max(F.when(looping, at)).alias("_loop_last"),
    )
    repeats = F.lit(False)
    for i in range(len(once)):
        repeats = repeats | (F.col(f"_n_{i}") > 1)
    placed = F.array_compact(F.array(*[F.col(f"_f_{i}") for i in range(len(once))]))
    opened, closed = F.col(f"_f_{once.index(opens)}"), F.col(f"_f_{once.index(closes)}")
    problems = fired(
        (repeats, "stage_repeats"),
        (placed != F.array_sort(placed), "stages_out_of_order"),
        (F.col("_loop_first").isNotNull() & (opened.isNull() | (F.col("_loop_first") < opened)), "loop_before_hypotheses"),
        (F.col("_loop_last") > closed, "loop_after_composing"),
    )
    return firsts.select(*run, problems.alias("problems"))


def trajectory(steps: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """One row: runs, step counts, retrieval passes, repeated queries, tokens and cost.

    `steps` has stage, query (null outside retrieval), tokens and cost_usd.
    """
    asked = (F.col("stage") == "retrieve_evidence") & F.col("query").isNotNull()
    per_query = steps.groupBy(*run, F.when(asked, F.col("query")).alias("q")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd")
    )
    per_run = per_query.groupBy(*run).agg(
        F.sum("n").alias("steps"),
        F.coalesce(F.sum(F.when(F.col("q").isNotNull(), F.col("n"))), F.lit(0)).alias("passes"),
        F.count_if(F.col("q").isNotNull() & (F.col("n") > 1)).alias("repeated"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    return per_run.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("steps").alias("steps_total"),
        F.min("steps").alias("steps_min"),
        F.max("steps").alias("steps_max"),
        F.avg("steps").alias("steps_mean"),
        F.sum("passes").alias("passes_total"),
        F.sum("repeated").alias("repeated_queries"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def repeated_queries(steps: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    return (
        steps.where((F.col("stage") == "retrieve_evidence") & F.col("query").isNotNull())
        .groupBy(*run, "query")
        .agg(F.count(F.lit(1)).alias("times"))
        .where("times > 1")
    )


def pass_counts(steps: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """How many runs made how many retrieval passes."""
    asked = (F.col("stage") == "retrieve_evidence") & F.col("query").isNotNull()
    per_run = steps.groupBy(*run).agg(F.count_if(asked).alias("passes"))
    return per_run.groupBy("passes").agg(F.count(F.lit(1)).alias("runs"))


def stop_matches_steps(findings: DataFrame, steps: DataFrame) -> DataFrame:
    """Does each finding's stop reason follow from its steps (finding_id, stage, summary, cost_usd)."""
    seen = steps.groupBy("finding_id").agg(
        F.count(F.lit(1)).alias("_steps"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_cost"),
        F.bool_or(F.contains("summary", F.lit("unavailable"))).alias("_named"),
        F.bool_or(F.col("stage") == "decide_continue").alias("_decided"),
    )
    stop, curtailed = F.col("stop_reason"), F.col("curtailed")
    holds = (
        F.when(stop == "step_budget_reached", curtailed & (F.col("_steps") >= 1))
        .when(stop == "cost_budget_reached", curtailed & (F.col("_cost") > 0.0))
        .when(
            stop == "mandatory_evidence_unavailable",
            curtailed & (F.size("unavailable_channels") > 0) & F.col("_named"),
        )
        .otherwise(~curtailed & F.col("_decided"))
    )
    return findings.join(seen, "finding_id", "left").select(
        "finding_id", "stop_reason", F.coalesce(holds, F.lit(False)).alias("matches")
    )


# ---- metric coverage --------------------------------------------------------------------


def json_depth(text: Column) -> Column:
    """How many objects and arrays of a JSON text lie inside each other at most; brackets in strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    step = lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walked = F.aggregate(
        F.split(bare, ""),
        start,
        lambda s, c: F.struct((s["now"] + step(c)).alias("now"), F.greatest(s["most"], s["now"] + step(c)).alias("most")),
    )
    return walked["most"]


def json_leaves(manifests: DataFrame) -> DataFrame:
    """Long form of JSON documents: (manifest, key, value text, is_number), keys joined by dots.

    `manifests` holds (manifest, json). The greatest depth of nesting is read first, as one number; the
    plan then opens as many levels and needs no job for any of them.
    """
    spark = manifests.sparkSession
    depth = manifests.agg(F.max(json_depth(F.col("json")))).first()[0] or 0
    level = manifests.select("manifest", F.lit("").alias("key"), F.parse_json("json").alias("v"))
    out = None
    for below in range(depth, -1, -1):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = level.where(~nested).select(
            "manifest",
            "key",
            F.try_variant_get("v", "$", "string").alias("value"),
            kind.rlike("^(BIGINT|DOUBLE|DECIMAL|BOOLEAN|FLOAT)").alias("is_number"),
        )
        out = leaves if out is None else out.unionByName(leaves)
        if not below:
            break
        entries = level.where(nested).lateralJoin(
            spark.tvf.variant_explode(F.col("v").outer()).withColumnsRenamed({"key": "_key", "value": "_value"})
        )
        name = F.coalesce("_key", F.col("pos").cast("string"))
        level = entries.select(
            "manifest",
            F.when(F.col("key") == "", name).otherwise(F.concat_ws(".", "key", name)).alias("key"),
            F.col("_value").alias("v"),
        )
    return out


def fill_metrics(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Metric rows (manifest, key) with the value their key points at."""
    return rows.join(leaves.select("manifest", "key", "value"), ["manifest", "key"], "left")


def unresolved_metrics(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows whose key is in no manifest. A key may also name an inner node."""
    asked = rows.where(F.col("manifest").isNotNull() & F.col("key").isNotNull()).select("manifest", "key").distinct()
    parts = F.split("key", r"\.")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )
    nodes = leaves.select("manifest", F.explode(ancestors).alias("key")).distinct()
    return asked.join(nodes, ["manifest", "key"], "left_anti")


def uncovered_metrics(rows: DataFrame, leaves: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Numeric leaves with no row, apart from the excluded prefixes."""
    path = F.concat_ws(".", "manifest", "key")
    left_out = F.lit(False)
    for prefix in excluded:
        left_out = left_out | (path == prefix) | path.startswith(prefix + ".")
    return (
        leaves.where("is_number")
        .where(~left_out)
        .join(rows.select("manifest", "key"), ["manifest", "key"], "left_anti")
        .select("manifest", "key")
    )


# ---- data quality -----------------------------------------------------------------------


def data_quality_set(days: DataFrame, raw: DataFrame, volumes: DataFrame | None, refused: DataFrame | None) -> DataFrame:
    """One frame of count rows: names, sentinel zeros, duplicates, date order, units, parse failures."""
    from daytrace.operators.days import duplicate_groups

    sentinel = F.lit(False)
    for channel in fixed.SENTINEL_ZERO_CHANNELS:
        if channel in days.columns:
            sentinel = sentinel | F.coalesce(F.col(channel) == 0.0, F.lit(False))
    groups = duplicate_groups(raw)
    parts = [
        outcome(days.select("well").distinct(), "names_resolve", names.canonical(F.col("well")).isNull()),
        outcome(days, "zero_is_not_a_reading", sentinel),
        outcome(groups, "duplicates_agree", F.size("disagreeing_fields") > 0),
        outcome(days, "dates_present", F.col("production_date").isNull()),
    ]
    if volumes is not None:
        from daytrace.functions.units import volume_unit_problem

        bad = volume_unit_problem(F.col("unit"), F.col("fluid")).isNotNull()
        parts.append(outcome(volumes, "units_convert", bad))
    if refused is not None:
        parts.append(outcome(refused, "parse_failures_kept", F.col("reason").isNull()))
    return all_outcomes(*parts)
