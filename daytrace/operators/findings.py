"""Hypotheses, evidence passes, stop reasons, verdicts and finding rows, for all episodes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import text as ft
from daytrace.operators.diagnose import EPISODE
from daytrace.operators.search import search

HYPOTHESIS = [*EPISODE, "hypothesis_id"]
OPEN = ("supported", "plausible")


def status_of(signal: Column, relative: Column, available: Column) -> Column:
    """Status of a signal, rounded first: the last bits of a deviation depend on the order of its rows."""
    signal = F.round(signal, fixed.SHIFT_DIGITS)
    material = relative.isNull() | (F.abs(relative) >= fixed.MIN_RELATIVE_SHIFT)
    return (
        F.when(~available | signal.isNull(), "unresolved")
        .when((signal >= fixed.STRONG_SHIFT) & material, "supported")
        .when(signal >= fixed.WEAK_SHIFT, "plausible")
        .when(signal <= -fixed.STRONG_SHIFT, "contradicted")
        .otherwise("weak")
    )


def _channel(name: str) -> Column:
    return F.get(F.filter("channels", lambda c: c["channel"] == name), F.lit(0))


def form_hypotheses(bundle: DataFrame, offsets: DataFrame) -> DataFrame:
    """Five hypotheses per episode, in fixed order."""
    rows = bundle.join(offsets, EPISODE)

    def falling(name: str) -> tuple[Column, Column]:
        """Status and signal of a fall in one channel."""
        c = _channel(name)
        relative = F.when(c["standardised_shift"].isNotNull(), -c["relative_shift"])
        return status_of(-c["standardised_shift"], relative, c["available"]), -c["standardised_shift"]

    rise = F.col("episode_water_cut") - F.col("baseline_water_cut")
    water = (
        F.when(rise.isNull(), "unresolved")
        .when(rise >= fixed.WATER_CUT_RISE, "supported")
        .when(rise > 0.0, "plausible")
        .otherwise("contradicted")
    )
    field = (
        F.when(F.col("other_wells") == 0, "unresolved")
        .when(F.col("field_wide"), "supported")
        .when(F.col("wells_also_down") > 0, "plausible")
        .otherwise("contradicted")
    )
    judged = {
        "H-choke": falling("choke_size"),
        "H-uptime": falling("on_stream_hours"),
        "H-water": (water, rise),
        "H-pressure": falling("downhole_pressure_bar"),
        "H-field": (field, F.col("median_rate_change")),
    }
    features = {
        "H-choke": "choke_standardised_shift",
        "H-uptime": "uptime_standardised_shift",
        "H-water": "water_cut_rise",
        "H-pressure": "pressure_standardised_shift",
        "H-field": "offset_median_rate_change",
    }
    structs = []
    for key, (order, description, level, channel, _) in fixed.HYPOTHESES.items():
        status, signal = judged[key]
        pressure_gone = F.lit(key == "H-pressure") & ~_channel("downhole_pressure_bar")["available"]
        pairs = [(features[key], signal)]
        if key == "H-field":
            pairs.append(("wells_also_down", F.col("wells_also_down").cast("double")))
        strength = F.map_filter(
            F.create_map(*[x for n, v in pairs for x in (F.lit(n), v)]), lambda _, v: v.isNotNull()
        )
        structs.append(
            F.struct(
                F.lit(order).alias("position"),
                F.lit(key).alias("hypothesis_id"),
                F.lit(description).alias("description"),
                F.lit(level).alias("causal_level"),
                status.alias("status"),
                F.lit(channel).cast("string").alias("required_channel"),
                F.when(pressure_gone, F.lit(fixed.MISSING_PRESSURE)).alias("missing_evidence"),
                strength.alias("strength_features"),
            )
        )
    missing = F.transform(F.filter("channels", lambda c: ~c["available"]), lambda c: c["channel"])
    return rows.select(*EPISODE, missing.alias("unavailable_channels"), F.explode(F.array(*structs)).alias("h")).select(
        *EPISODE, "unavailable_channels", "h.*"
    )


def _first_pass_stop(statuses: DataFrame) -> DataFrame:
    """Per episode: does a missing channel end the search after its first pass."""
    return statuses.groupBy(*EPISODE).agg(
        (
            F.first(F.size("unavailable_channels") > 0)
            & F.bool_or((F.col("status") == "unresolved") & F.col("required_channel").isNotNull())
            & ~F.bool_or(F.col("status") == "supported")
        ).alias("stops_early")
    )


def evidence_passes(hypotheses: DataFrame, max_passes: int | None = None) -> DataFrame:
    """Retrieval passes (episode, pass, hypothesis, query): the testable hypotheses in order.

    All of them (five at most), or the first `max_passes`; one generic pass aimed at the choke hypothesis where none is testable; only the
    first where a missing channel stops the search.
    """
    early = _first_pass_stop(hypotheses)
    w = Window.partitionBy(*EPISODE).orderBy("position")
    queries = F.create_map(*[F.lit(x) for k, v in fixed.HYPOTHESES.items() for x in (k, v[4])])
    testable = (
        hypotheses.where(F.col("status").isin(*OPEN))
        .withColumn("pass", F.row_number().over(w) - 1)
        .where(F.lit(True) if max_passes is None else F.col("pass") < max_passes)
        .select(*EPISODE, "pass", "hypothesis_id", queries[F.col("hypothesis_id")].alias("query"))
    )
    idle = hypotheses.groupBy(*EPISODE).agg(F.bool_or(F.col("status").isin(*OPEN)).alias("any")).where("not any")
    generic = idle.select(
        *EPISODE,
        F.lit(0).alias("pass"),
        F.lit("H-choke").alias("hypothesis_id"),
        F.lit(fixed.GENERIC_QUERY).alias("query"),
    )
    return (
        testable.unionByName(generic)
        .join(early, EPISODE)
        .where((F.col("pass") == 0) | ~F.col("stops_early"))
        .drop("stops_early")
    )


def retrieve(
    passes: DataFrame, chunks: DataFrame, days_around: int = fixed.EVIDENCE_WINDOW_DAYS, hits: int = fixed.HITS_PER_PASS
) -> DataFrame:
    """Citable spans per pass: top chunks of the well near the episode, verbatim sentence each."""
    keyed = passes.withColumn(
        "query_id", F.concat_ws("|", "well", F.col("onset"), F.col("offset"), "pass")
    )
    found = search(
        chunks,
        keyed.select(
            "query_id",
            "query",
            F.substring_index("well", " ", 1).alias("well"),
            F.date_sub("onset", days_around).alias("on_or_after"),
            F.date_add("offset", days_around).alias("on_or_before"),
        ),
        hits,
    )
    cited = found.join(chunks.select("chunk_id", "text", "source_document", "report_date"), "chunk_id")
    span = ft.sentence_with(F.col("text"), F.col("matched_terms"))
    spans = cited.withColumn("span", span).where(F.col("span").isNotNull() & F.contains("text", "span"))
    return keyed.drop("query").join(spans, "query_id").select(
        *HYPOTHESIS,
        "pass",
        "rank",
        "score",
        F.col("source_document").alias("document"),
        F.col("chunk_id").alias("event_id"),
        "report_date",
        "span",
    )


def attach(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hypotheses after their pass: evidence attached, status and level raised where it allows."""
    refs = evidence.groupBy(*HYPOTHESIS).agg(
        # five hits per pass and one pass per hypothesis bound this list
        F.array_sort(F.collect_list(F.struct("rank", "document", "event_id", "report_date", "span"))).alias("supporting"),
        F.bool_or(ft.states_a_reason(F.col("span"))).alias("_reason"),
    )
    with_refs = hypotheses.join(refs, HYPOTHESIS, "left")
    cited = F.col("supporting").isNotNull()
    raised = cited & F.col("status").isin("unresolved", "weak")
    documented = cited & (F.col("status") == "supported") & F.col("_reason")
    empty = F.array().cast(with_refs.schema["supporting"].dataType)
    return (
        with_refs.withColumn("causal_level", F.when(documented, "documented_root_cause").otherwise(F.col("causal_level")))
        .withColumn("status", F.when(raised, "plausible").otherwise(F.col("status")))
        .withColumn("supporting", F.coalesce("supporting", empty))
        .drop("_reason")
    )


def verdict(supported: Column, plausible: Column) -> Column:
    return (
        F.when(supported == 1, "supported_explanation")
        .when((supported > 1) | (plausible >= 2), "multiple_plausible_explanations")
        .otherwise("insufficient_evidence")
    )


def _named(test: Column) -> Column:
    """Hypotheses of an episode that satisfy a test, in order (five at most)."""
    listed = F.collect_list(F.when(test, F.struct("position", "hypothesis_id", "description", "required_channel", "causal_level")))
    return F.array_sort(listed)


def _ids(c: str) -> Column:
    return F.transform(c, lambda h: h["hypothesis_id"])


def conclude(before: DataFrame, after: DataFrame, max_passes: int | None = None) -> DataFrame:
    """One finding row per episode; `max_passes` is what `evidence_passes` was given.

    `before` are the hypotheses as formed, `after` those with evidence attached. The early stop is
    judged on the statuses the first pass leaves behind.
    """
    status = F.col("status")
    open_before = before.groupBy(*EPISODE).agg(
        F.count_if(status.isin(*OPEN)).alias("_testable_before"),
    )
    level_order = F.array(*[F.lit(v) for v in fixed.CAUSAL_LEVELS])
    rank = F.array_position(level_order, F.col("causal_level"))
    spans = F.flatten(
        F.collect_list(
            F.when(
                (status == "supported") & (F.col("causal_level") == "documented_root_cause"),
                F.transform("supporting", lambda s: F.concat(F.lit("'"), s["span"], F.lit("' in "), s["document"])),
            )
        )
    )
    grouped = after.groupBy(*EPISODE).agg(
        F.first("unavailable_channels").alias("unavailable_channels"),
        _named(status == "supported").alias("_supported"),
        _named(status == "contradicted").alias("_contradicted"),
        _named(status == "unresolved").alias("_unresolved"),
        F.count_if(status == "plausible").alias("plausible"),
        F.max(F.when(status == "supported", rank)).alias("_level"),
        F.sum(F.size("supporting")).alias("citations"),
        spans.alias("_spans"),
        F.array_sort(F.collect_set("missing_evidence")).alias("missing_evidence"),
        F.bool_or((status == "unresolved") & F.col("required_channel").isNotNull()).alias("_waiting"),
    )
    supported = F.size("_supported")
    early = (F.size("unavailable_channels") > 0) & F.col("_waiting") & (supported == 0)
    stop = (
        F.when(early, "mandatory_evidence_unavailable")
        .when(F.lit(False) if max_passes is None else F.col("_testable_before") > max_passes, "evidence_exhausted")
        .when(F.col("plausible") > 0, "evidence_exhausted")
        .otherwise("evidence_threshold_met")
    )
    rows = (
        grouped.join(open_before, EPISODE)
        .withColumn("verdict", verdict(supported, F.col("plausible")))
        .withColumn("stop_reason", stop)
        .withColumn("curtailed", F.col("stop_reason").isin(*fixed.CURTAILED))
        .withColumn("highest_level", F.get(level_order, F.col("_level").cast("int") - 1))
    )
    return rows.select(
        finding_id(F.col("well"), F.col("onset")).alias("finding_id"),
        *EPISODE,
        "verdict",
        "stop_reason",
        "curtailed",
        "highest_level",
        F.when(supported == 1, F.get(_ids("_supported"), F.lit(0))).alias("leading_hypothesis"),
        _ids("_supported").alias("supported"),
        "plausible",
        "citations",
        "unavailable_channels",
        "missing_evidence",
        narrative().alias("narrative"),
        falsifiers().alias("what_would_change_the_conclusion"),
        next_check().alias("recommended_next_check"),
    )


def finding_id(well: Column, onset: Column) -> Column:
    return F.concat_ws("_", F.lit("finding"), F.translate(well, "/ ", "__"), onset)


def _described(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda h: h["description"]), "; ")


def narrative() -> Column:
    """Finding text from the statuses gathered in `conclude`."""
    documented = F.filter("_supported", lambda h: h["causal_level"] == "documented_root_cause")
    proximate = F.forall("_supported", lambda h: h["causal_level"] == "proximate_driver")
    cited = F.when(F.size("_spans") > 0, ft.filled("stated_in", F.array_join("_spans", "; ")))
    body = (
        F.when(F.size(documented) > 0, F.concat_ws(" ", ft.filled("documented", _described(documented)), cited))
        .when((F.size("_supported") > 0) & proximate, ft.filled("proximate", _described("_supported")))
        .when(F.size("_supported") > 0, ft.filled("mechanism", _described("_supported")))
        .otherwise(ft.filled("no_support"))
    )

    def listed(name: str, c: str) -> Column:
        return F.when(F.size(c) > 0, ft.filled(name, F.array_join(_ids(c), "; ")))

    return F.concat_ws(
        " ",
        ft.filled("below_expectation", F.col("well")),
        body,
        listed("ruled_out", "_contradicted"),
        listed("left_open", "_unresolved"),
        F.when(F.col("curtailed"), ft.filled("curtailed", F.col("stop_reason"))),
    )


def falsifiers() -> Column:
    """What would change the conclusion, one line per supported or untestable hypothesis."""

    def lines(source: Column | str, line) -> Column:
        return F.transform(source, lambda h: F.struct(h["position"].alias("position"), line(h).alias("line")))

    untested = F.filter("_unresolved", lambda h: h["required_channel"].isNotNull())
    both = F.concat(
        lines("_supported", lambda h: ft.filled("would_move", h["hypothesis_id"])),
        lines(untested, lambda h: ft.filled("would_test", h["hypothesis_id"], h["required_channel"])),
    )
    ordered = F.transform(F.array_sort(both), lambda x: x["line"])
    return F.when(F.size(ordered) > 0, ordered).otherwise(F.array(ft.filled("nothing_moves")))


def next_check() -> Column:
    first = F.get(_ids("_supported"), F.lit(0))
    return (
        F.when(
            F.size("unavailable_channels") > 0,
            ft.filled("check_channels", F.array_join("unavailable_channels", ", ")),
        )
        .when(first.isNotNull(), ft.filled("read_log", F.col("onset"), first))
        .otherwise(ft.filled("review_reports", F.col("well"), F.col("onset")))
    )


def evidence_score(findings: DataFrame, bundle: DataFrame) -> DataFrame:
    """Mean of five features per finding, rounded, with its band."""
    shifts = F.transform("channels", lambda c: F.abs(c["standardised_shift"]))
    strongest = F.coalesce(F.array_max(shifts), F.lit(0.0))
    days = F.coalesce(F.array_max(F.transform("channels", lambda c: c["days"])), F.lit(0))
    gaps = F.col("quarantined_days") + F.col("missing_days")
    complete = F.when(days > 0, F.greatest(F.lit(0.0), (days - gaps) / days)).otherwise(F.lit(0.0))
    available = F.size(F.filter("channels", lambda c: c["available"])) / F.size("channels")
    documented = F.col("highest_level").eqNullSafe(F.lit("documented_root_cause"))
    features = {
        "deviation_strength": F.least(strongest, F.lit(fixed.DEVIATION_CAP)) / fixed.DEVIATION_CAP,
        "channel_availability": available,
        "documentary_cause": documented.cast("double"),
        "window_completeness": complete,
        "ran_to_completion": (~F.col("curtailed")).cast("double"),
    }
    scored = findings.join(bundle, EPISODE).select(
        "finding_id", *EPISODE, *[v.alias(n) for n, v in features.items()]
    )
    total = sum((F.col(n) for n in features), F.lit(0.0))
    return scored.withColumn("score", F.round(total / len(features), 6)).withColumn(
        "band",
        F.when(F.col("score") >= fixed.EVIDENCE_HIGH, "high")
        .when(F.col("score") >= fixed.EVIDENCE_MODERATE, "moderate")
        .otherwise("low"),
    )


def baseline_agreement(findings: DataFrame, calls: DataFrame) -> DataFrame:
    """Per finding: does the baseline's driver family occur among the supported hypotheses.

    Null where either side named nothing.
    """
    families = F.create_map(*[F.lit(x) for p in fixed.HYPOTHESIS_FAMILY.items() for x in p])
    named = F.array_compact(F.transform("supported", lambda h: F.try_element_at(families, h)))
    agrees = F.when(
        F.col("family").isNotNull() & (F.size("supported") > 0), F.array_contains(named, F.col("family"))
    )
    return findings.join(calls.select(*EPISODE, "family", "proximate_driver"), EPISODE).select(
        "finding_id", *EPISODE, "proximate_driver", F.array_sort(F.array_distinct(named)).alias("supported_families"), agrees.alias("agrees_with_baseline")
    )


def counts(findings: DataFrame) -> DataFrame:
    """Verdict, stop-reason and level counts, with the values nothing reached as zero."""
    lists = {
        "verdict": fixed.VERDICTS,
        "stop_reason": fixed.STOP_REASONS,
        "highest_level": (*fixed.CAUSAL_LEVELS, "None"),
    }
    named = {f"{kind}|{v}": (kind, v) for kind, values in lists.items() for v in values}
    one = findings.agg(
        *[F.count_if(F.coalesce(F.col(k), F.lit("None")) == v).alias(n) for n, (k, v) in named.items()]
    )
    long = one.unpivot([], list(named), "key", "findings")
    return long.select(
        F.substring_index("key", "|", 1).alias("kind"), F.substring_index("key", "|", -1).alias("value"), "findings"
    )
