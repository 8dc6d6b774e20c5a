import datetime as dt
import random
import statistics

import plain
import pytest
from plain import START, days_of, row
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.operators import audits as oa
from daytrace.operators import diagnose as og
from daytrace.operators import facts as of
from daytrace.operators import findings as on
from daytrace.operators import review as orv
from daytrace.plans import investigation


def day(n):
    return START + dt.timedelta(days=n)


EPISODE = """well string, onset date, offset date, cumulative_rate_shortfall_sm3 double, deferred_volume_sm3 double,
reference_rate_sm3_per_day double, poorly_evidenced boolean"""
CHUNK = "chunk_id string, text string, well string, wellbore string, source_document string, report_date date"


def history(well, **during):
    rows = [row(i, well=well, choke_size=50.0 + i % 2, downhole_pressure_bar=200.0 + i % 3, on_stream_hours=24.0 - i % 2) for i in range(80)]
    return rows + [row(i, well=well, oil_volume_sm3=60.0, downhole_pressure_bar=200.0 + i % 3, on_stream_hours=24.0 - i % 2, **during) for i in range(80, 100)]


@pytest.fixture(scope="module")
def done(spark):
    rows = history("15/9-F-12", choke_size=30.0, water_volume_sm3=0.6)
    rows += [r | {"choke_size": 50.0 + i % 2, "downhole_pressure_bar": None} for i, r in enumerate(history("15/9-F-14"))]
    days = days_of(spark, rows)
    episodes = spark.createDataFrame(
        [("15/9-F-12", day(80), day(99), 40000.0, 10.0, 100.0, False), ("15/9-F-14", day(80), day(99), 900.0, 5.0, 100.0, True)], EPISODE
    )
    chunks = spark.createDataFrame(
        [
            ("n1", "Quiet. Choke reduced due to sand. End", "15/9-F-12", "15/9-F-12", "a.xml", day(90)),
            ("n2", "Choke reduced long ago", "15/9-F-12", "15/9-F-12", "b.xml", day(0)),
            ("n3", "Choke reduced elsewhere", "15/9-F-11", "15/9-F-11", "c.xml", day(90)),
        ],
        CHUNK,
    )
    return investigation.investigate(episodes, days.withColumn("field", F.lit("one")), chunks, "field"), chunks


def test_bundle_compares_the_sixty_rows_before(done):
    rows = {(r.well, r.channel): r for r in og.channel_rows(done[0].bundle).collect()}
    choke = rows[("15/9-F-12", "choke_size")]
    assert choke.baseline_readings == 60 and choke.readings == 20
    assert choke.shift == -20.5 and choke.standardised_shift == pytest.approx(-41.0)
    lost = rows[("15/9-F-14", "downhole_pressure_bar")]
    assert lost.standardised_shift is None and not lost.available


def test_hypotheses_evidence_and_verdict(done):
    h = {(r.well, r.hypothesis_id): r for r in done[0].hypotheses.collect()}
    first = h[("15/9-F-12", "H-choke")]
    assert (first.status, first.causal_level) == ("supported", "documented_root_cause")
    assert [(s.event_id, s.span) for s in first.supporting] == [("n1", "Choke reduced due to sand")]
    assert h[("15/9-F-12", "H-water")].status in ("plausible", "contradicted")
    assert h[("15/9-F-14", "H-pressure")].missing_evidence == fixed.MISSING_PRESSURE
    f = {r.well: r for r in done[0].findings.collect()}
    one = f["15/9-F-12"]
    assert one.highest_level == "documented_root_cause" and not one.curtailed and one.citations >= 1
    assert "A report gives the reason: A smaller choke opening" in one.narrative and "'Choke reduced due to sand' in a.xml" in one.narrative
    assert f["15/9-F-14"].recommended_next_check == "Look for downhole_pressure_bar in other sources."
    assert any("H-pressure: needs data of" in line for line in f["15/9-F-14"].what_would_change_the_conclusion)


def test_offsets_judge_a_field_wide_fall(done):
    rows = {r.well: r for r in done[0].formed.where("hypothesis_id = 'H-field'").collect()}
    assert all(r.status == "supported" for r in rows.values())


@pytest.mark.parametrize(
    "signal,relative,available,want",
    [(1.2, 0.5, True, "supported"), (1.2, 0.05, True, "plausible"), (1.2, None, True, "supported"), (0.6, 0.5, True, "plausible"),
     (-1.0, -0.5, True, "contradicted"), (0.1, 0.5, True, "weak"), (1.2, 0.5, False, "unresolved"), (None, None, True, "unresolved")],
)
def test_status(spark, signal, relative, available, want):
    c = lambda x: F.lit(x).cast("double")
    assert spark.range(1).select(on.status_of(c(signal), c(relative), F.lit(available))).first()[0] == want


FORMED = "well string, onset date, offset date, unavailable_channels array<string>, position int, hypothesis_id string, description string, causal_level string, status string, required_channel string, missing_evidence string, strength_features map<string,double>"


def formed(spark, statuses, unavailable=()):
    rows = []
    for key, status in zip(fixed.HYPOTHESES, statuses, strict=True):
        order, text, level, channel, _ = fixed.HYPOTHESES[key]
        rows.append(("W", day(0), day(9), list(unavailable), order, key, text, level, status, channel, None, {}))
    return spark.createDataFrame(rows, FORMED)


@pytest.mark.parametrize(
    "statuses,gone,passes,stop,verdict",
    [
        (["supported", "weak", "contradicted", "weak", "weak"], (), 1, "evidence_threshold_met", "supported_explanation"),
        (["supported", "supported", "plausible", "plausible", "weak"], (), 4, "evidence_exhausted", "multiple_plausible_explanations"),
        (["plausible", "plausible", "weak", "unresolved", "weak"], ("downhole_pressure_bar",), 1, "mandatory_evidence_unavailable", "multiple_plausible_explanations"),
        (["weak", "weak", "weak", "weak", "weak"], (), 1, "evidence_threshold_met", "insufficient_evidence"),
        (["weak", "plausible", "weak", "weak", "weak"], (), 1, "evidence_exhausted", "insufficient_evidence"),
    ],
)
def test_passes_stop_and_verdict(spark, statuses, gone, passes, stop, verdict):
    before = formed(spark, statuses, gone)
    made = on.evidence_passes(before)
    assert made.count() == passes and on.evidence_passes(before, max_passes=3).count() == min(passes, 3)
    none = spark.createDataFrame([], "well string, onset date, offset date, hypothesis_id string, pass int, rank int, score double, document string, event_id string, report_date date, span string")
    found = on.conclude(before, on.attach(before, none)).first()
    assert (found.stop_reason, found.verdict) == (stop, verdict)
    assert found.curtailed == (stop == "mandatory_evidence_unavailable")


def test_strongest_deviation_ties_go_to_the_first_channel(spark):
    shape = "well string, onset date, offset date, channels array<struct<channel:string,standardised_shift:double>>"
    rows = [
        ("a", day(0), day(9), [("on_stream_hours", -2.0), ("choke_size", -2.0), ("choke_dp_bar", None)]),
        ("b", day(0), day(9), [("choke_dp_bar", 3.0), ("choke_size", -1.0)]),
        ("c", day(0), day(9), [("choke_size", 2.0), ("choke_dp_bar", -2.0)]),
    ]
    got = {r.well: r for r in og.strongest_deviation(spark.createDataFrame(rows, shape)).collect()}
    assert (got["a"].channel, got["a"].skipped_channels) == ("on_stream_hours", ["choke_dp_bar"])
    assert (got["b"].channel, got["b"].family) == ("choke_dp_bar", "choke")
    assert got["c"].abstained


def test_scores_counts_agreement_and_safety(done):
    result = done[0]
    scores = {r.well: r for r in result.scores.collect()}
    assert scores["15/9-F-12"].band == "high" and scores["15/9-F-14"].channel_availability == 0.8
    counts = {(r.kind, r.value): r.findings for r in on.counts(result.findings).collect()}
    assert len(counts) == 12 and sum(v for (k, _), v in counts.items() if k == "verdict") == 2
    calls = og.strongest_deviation(result.bundle)
    agree = {r.well: r.agrees_with_baseline for r in on.baseline_agreement(result.findings, calls).collect()}
    assert agree["15/9-F-12"] is True
    safe = oa.safety(result.findings, result.hypotheses).first()
    assert (safe.documented_claims, safe.weighted_cost) == (1, 0)
    loud = result.findings.withColumn("highest_level", F.lit("proximate_driver")).withColumn("narrative", F.lit("caused by rust"))
    assert oa.safety(loud, result.hypotheses).first().root_cause_claimed_above_its_level == 2


def test_provenance_gate_passes_and_every_rule_can_fail(spark, done):
    result, chunks = done
    facts, inputs, cited = of.episode_facts(result.episodes, oil_price=100.0)
    facts, inputs, cited = facts.cache(), inputs.cache(), cited.cache()
    documents = chunks.withColumnRenamed("chunk_id", "event_id")

    def rules(findings=result.findings, hypotheses=result.hypotheses, cites=cited, known=facts, edges=inputs, docs=documents):
        found = oa.provenance_violations(findings, hypotheses, cites, known, edges, docs)
        return {r.rule for r in found.select("rule").collect()}

    assert rules() == set()
    assert {r.gate_passed for r in oa.provenance_gate(result.findings, spark.createDataFrame([], "finding_id string")).collect()} == {True}
    assert rules(known=facts.where("metric <> 'episode_reference_rate'")) == {"fact_not_in_ledger"}
    assert "broken_lineage" in rules(known=facts.where("metric <> 'assumed_oil_price'"))
    assert rules(docs=documents.where("event_id <> 'n1'")) == {"document_not_available"}
    assert rules(docs=documents.withColumn("text", F.lit("other"))) == {"span_not_verbatim"}
    assert rules(docs=documents.withColumn("source_document", F.lit("z.xml"))) == {"document_name_wrong"}
    assert rules(docs=documents.withColumn("well", F.lit("15/9-19"))) == {"citation_from_another_well"}
    assert rules(docs=documents.withColumn("report_date", F.lit("1999-01-01").cast("date"))) == {"citation_outside_the_window"}
    nameless = result.hypotheses.withColumn("supporting", F.transform("supporting", lambda s: s.withField("span", F.lit(None).cast("string"))))
    assert rules(hypotheses=nameless) == {"incomplete_citation"}
    gone = result.hypotheses.withColumn("unavailable_channels", F.array(F.lit("choke_size")))
    assert rules(hypotheses=gone) == {"supported_without_mandatory_channel"}
    assert "unsourced_number_in_prose" in rules(findings=result.findings.withColumn("recommended_next_check", F.lit("look at 17 logs")))
    assert "stop_reason_not_declared" in rules(findings=result.findings.withColumn("curtailed", ~F.col("curtailed")))
    unresolved = result.findings.withColumn("narrative", F.lit("Root cause unresolved"))
    assert "documented_level_disclaims_itself" in rules(findings=unresolved)
    loud = result.findings.withColumns({"narrative": F.lit("caused by rust"), "highest_level": F.lit(None).cast("string")})
    assert "root_cause_wording_above_level" in rules(findings=loud)


def test_facts_lineage_units_and_digest(spark, done):
    episodes = done[0].episodes
    facts, inputs, _ = of.episode_facts(episodes, oil_price=100.0)
    value = facts.where("kind = 'derived'")
    assert sorted(r.value for r in value.collect()) == [90000.0, 4000000.0]
    walked = of.lineage(value.select("fact_id"), inputs)
    assert walked.count() == 6 and of.roots(walked, facts).count() == 4
    assert of.lineage_problems(value.select("fact_id"), facts, inputs).count() == 0
    mixed = facts.withColumn("combines_units", F.lit(False))
    assert {r.problem for r in of.lineage_problems(value.select("fact_id"), mixed, inputs).collect()} == {"mixed_units"}
    base = of.digest(facts, inputs).first()
    rename = lambda c: F.concat(F.lit("new_"), c)
    moved = facts.withColumn("fact_id", rename(F.col("fact_id")))
    edges = inputs.select(rename(F.col("fact_id")).alias("fact_id"), rename(F.col("input_id")).alias("input_id"))
    assert of.digest(moved, edges).first() == base
    assert of.digest(facts.withColumn("value", F.col("value") + 1), inputs).first().content_hash != base.content_hash
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "fact_id string, input_id string")
    assert of.lineage(spark.createDataFrame([("a",)], "fact_id string"), loop).count() == 2
    with pytest.raises(PySparkException, match="no such input"):
        links = spark.createDataFrame([("d", 0, "nowhere")], "derivation string, position int, input_id string")
        of.derive(facts, links, "m", "u", "f", lambda v: v[0])[0].collect()


REVIEW = "investigation_id string, action string, actor string, recorded_at string, note string"


def test_review_states_and_refusals(spark):
    log = spark.createDataFrame(
        [("a", "add_correction", "p", "1", "n"), ("a", "confirm", "p", "2", None), ("a", "dismiss", "p", "3", None),
         ("b", "request_more_evidence", "p", "1", None), ("c", "add_correction", "p", "1", "n")], REVIEW,
    )
    states = {r.investigation_id: (r.review_state, r.revision) for r in orv.review_states(log).collect()}
    assert states == {"a": ("confirmed", 1), "b": ("rerun_requested", 0), "c": ("awaiting_review", 1)}
    new = spark.createDataFrame(
        [("a", "add_correction", "p", "9", "n"), ("c", "add_correction", "p", "8", " "), ("c", "add_correction", "p", "9", "n"),
         ("d", "confirm", " ", "1", None), ("d", "dismiss", "p", "2", None), ("e", "shrug", "p", "1", None)], REVIEW,
    )
    got = {(r.investigation_id, r.recorded_at): (r.reasons, r.revision) for r in orv.review_reasons(log, new).collect()}
    assert got[("a", "9")][0] == ["already_settled"] and got[("c", "8")][0] == ["correction_without_note"]
    assert got[("c", "9")] == ([], 3) and got[("d", "1")][0] == ["no_actor"]
    assert got[("d", "2")][0] == ["already_settled"] and got[("e", "1")][0] == ["unknown_action"]


EVENT = "event_id string, well string, activity_code string, duration_hours double, equipment string, comment string, extractor_version string"


def test_corrections_are_admitted_all_or_nothing(spark):
    events = spark.createDataFrame(
        [("e1", "15/9-F-12", "a -- b", 2.5, None, "text", "extractor-v0"), ("e2", "15/9-F-4", "a -- b", 1.0, "pump", "t", "extractor-v0")], EVENT
    )
    asked = spark.createDataFrame(
        [("e1", f, "new", "me", None) for f in ("category", "duration", "equipment", "cause_text")],
        "event_id string, field string, new_value string, corrected_by string, note string",
    )
    good = orv.propose(events, asked)
    assert sorted(r.old_value for r in good.collect()) == ["", "2.5", "a -- b", "text"]
    assert orv.admit_corrections(good, events).count() == 4
    for change, reason in [
        ({"event_id": F.lit("zz")}, "unknown_event"), ({"well": F.lit("15/9-F-14")}, "well_mismatch"), ({"event_id": F.lit("e2"), "well": F.lit("15/9-F-4")}, "hold_out_well"),
        ({"old_value": F.lit("stale")}, "stale_old_value"), ({"note": F.lit("see 15/9-F-4")}, "hold_out_text"),
    ]:
        bad = good.unionByName(good.limit(1).withColumns(change))
        assert reason in {x for r in orv.correction_reasons(bad, events).collect() for x in r.reasons}
        with pytest.raises(PySparkException, match="refused"):
            orv.admit_corrections(bad, events).collect()
    versions = good.limit(1).withColumn("extractor_version", F.explode(F.array(*[F.lit(v) for v in ("x-v0", "x-v1", "odd")])))
    assert [r.extractor_version for r in orv.usable_corrections(versions, "x-v1").collect()] == ["x-v0"]
    assert orv.usable_corrections(versions, "odd").count() == 0


def test_queue_priority_terms_and_figures(spark, done):
    result = done[0]
    log = spark.createDataFrame([("15_9-F-12_" + str(day(80)), "request_more_evidence", "p", "1", None)], REVIEW)
    queued = orv.queue(result.episodes, result.findings, result.scores, log)
    rows = queued.collect()
    assert rows[0].well == "15/9-F-12" and rows[0].review_state == "rerun_requested" and rows[0].shortfall_points == 3
    assert rows[1].data_quality == "Degraded" and rows[1].review_state == "none"
    assert oa.priority_as_printed(queued).first().passed
    assert not oa.priority_as_printed(queued.withColumn("score", F.col("score") + 1)).first().passed
    counts = {r.term: r.episodes for r in orv.term_counts(queued).collect()}
    assert len(counts) == 4 and counts["size of the shortfall"] == 2 and counts["review is pending"] == 1
    figures = orv.queue_kpis(queued).first()
    assert (figures.open_investigations, figures.awaiting_review, figures.reviews_recorded) == (2, 2, 1)
    cells = {(r.well, r.hypothesis_id, r.family): r.cell for r in orv.matrix_cells(result.hypotheses, result.passes).collect()}
    assert cells[("15/9-F-12", "H-choke", "Control")] == "supports" and cells[("15/9-F-12", "H-choke", "Report")] == "supports"
    assert cells[("15/9-F-12", "H-choke", "Fluids")] == "not_applicable"
    assert orv.matrix(result.hypotheses, result.passes).count() == 10
    lines = {r.well: r for r in orv.coverage_lines(result.findings, result.bundle).collect()}
    assert "downhole_pressure_bar: 0 of 20 days usable" in lines["15/9-F-14"].missing


def test_audits_can_fail_and_can_be_vacuous(spark):
    wells = lambda *w: spark.createDataFrame([(x,) for x in w], "well string")
    assert oa.labels_from_hold_out(wells("15/9-F-12")).first().passed
    assert oa.labels_from_hold_out(wells("15/9-F-4 A")).first().problems == 1
    assert oa.labels_from_hold_out(wells("x").limit(0)).first().vacuous
    dated = spark.createDataFrame([("W", day(0)), ("W", day(100))], "well string, production_date date")
    split = spark.createDataFrame([(day(50),)], "development_end date")
    assert oa.fitted_outside_development(dated, split).first().problems == 1
    assert not oa.fitted_outside_development(dated.limit(0), split).first().passed
    assert oa.fitted_outside_by_well(dated, split).first().dates_outside == 1
    late = spark.createDataFrame([(dt.date(2014, 7, 25),), (dt.date(2014, 7, 26),)], "report_date date")
    assert oa.labels_after_boundary(late).first().problems == 1
    assert oa.hold_out_contained(wells("15/9-F-12"), wells("15/9-F-9")).first().problems == 1
    assert oa.hold_out_label_file(spark.createDataFrame([("labels_hold_out.jsonl",)], "file_name string")).first().problems == 1
    money = "cost_equivalent_usd double, cost_assumption string, day_rate_usd double"
    good = spark.createDataFrame([(5.0, "at a stated assumption of", 1.0)], money)
    assert oa.currency_disclosed(good).first().passed
    for bad in [(5.0, None, 1.0), (float("nan"), "at a stated assumption of", 1.0), (5.0, "guess", 1.0), (5.0, "at a stated assumption of", None), (None, "x", None)]:
        assert not oa.currency_disclosed(spark.createDataFrame([bad], money)).first().passed
    tiles = spark.createDataFrame([(None, None, "no price"), (1.0, "stated", None)], "amount double, assumption string, reason string")
    assert oa.money_sound(tiles).first().passed and not oa.money_sound(tiles.withColumn("amount", F.lit(-1.0))).first().passed
    texts = spark.createDataFrame([("15/9-F-12 fine",), ("well F-4 here",), ("F-41 fine",)], "text string")
    assert oa.no_hold_out_in_text(texts).first().problems == 1
    rows = spark.createDataFrame([(1,), (1,)], "n int")
    assert not oa.same_rows("x", rows, rows.limit(1), ["n"]).first().passed


def test_steps_of_a_log(spark):
    whole = list(fixed.STAGES)
    runs = {
        "good": whole[:7] + whole[4:7] + whole[7:], "repeat": whole + ["compose_finding"], "swap": [whole[1], whole[0], *whole[2:]],
        "early": [whole[4], *whole], "late": whole + ["retrieve_evidence"],
    }
    steps = spark.createDataFrame(
        [(k, i, s, "q" if s == "retrieve_evidence" else None, 1, 0.0) for k, v in runs.items() for i, s in enumerate(v)],
        "run string, index int, stage string, query string, tokens long, cost_usd double",
    )
    got = {r.run: r.problems for r in oa.stage_order_problems(steps).collect()}
    assert got == {"good": [], "repeat": ["stage_repeats"], "swap": ["stages_out_of_order"], "early": ["loop_before_hypotheses"], "late": ["loop_after_composing"]}
    report = oa.trajectory(steps).first()
    assert (report.runs, report.steps_min, report.steps_max, report.repeated_queries) == (5, 9, 12, 3)
    assert {r.run for r in oa.repeated_queries(steps).collect()} == {"good", "early", "late"}
    assert {r.passes: r.runs for r in oa.pass_counts(steps).collect()} == {1: 2, 2: 3}
    findings = spark.createDataFrame(
        [("a", "evidence_exhausted", False, []), ("b", "mandatory_evidence_unavailable", True, ["x"]), ("c", "evidence_exhausted", True, [])],
        "finding_id string, stop_reason string, curtailed boolean, unavailable_channels array<string>",
    )
    taken = spark.createDataFrame(
        [("a", "decide_continue", "go", 0.0), ("b", "decide_continue", "a channel is unavailable", 0.0), ("c", "decide_continue", "go", 0.0)],
        "finding_id string, stage string, summary string, cost_usd double",
    )
    assert {r.finding_id: r.matches for r in oa.stop_matches_steps(findings, taken).collect()} == {"a": True, "b": True, "c": False}


def test_metric_coverage_both_ways(spark):
    text = '{"a": 1, "b": {"c": 2.5, "d": "x", "e": [true, {"f": 3}]}, "skip": {"n": 1}}'
    leaves = oa.json_leaves(spark.createDataFrame([("m", text)], "manifest string, json string")).cache()
    assert {r.key: r.is_number for r in leaves.collect()} == {"a": True, "b.c": True, "b.d": False, "b.e.0": True, "b.e.1.f": True, "skip.n": True}
    rows = spark.createDataFrame([("m", "a"), ("m", "b.c"), ("m", "b.e"), ("m", "gone"), (None, None)], "manifest string, key string")
    assert {r.key for r in oa.uncovered_metrics(rows, leaves, ["m.skip"]).collect()} == {"b.e.0", "b.e.1.f"}
    assert {r.key for r in oa.unresolved_metrics(rows, leaves).collect()} == {"gone"}
    assert {r.key: r.value for r in oa.fill_metrics(rows, leaves).collect()}["b.c"] == "2.5"


def test_data_quality_set_counts(spark):
    rows = [row(0, well="15/9-F-12", downhole_pressure_bar=0.0), row(0, well="15/9-F-12", oil_volume_sm3=1.0), row(1, well="odd")]
    raw = plain.frame(spark, rows)
    volumes = spark.createDataFrame([("m3", "gas"), ("bbl", "liquid")], "unit string, fluid string")
    got = {r.check: (r.examined, r.problems) for r in oa.data_quality_set(days_of(spark, rows), raw, volumes, None).collect()}
    assert got["names_resolve"] == (2, 1) and got["zero_is_not_a_reading"] == (3, 1)
    assert got["duplicates_agree"] == (2, 1) and got["units_convert"] == (2, 1)
    assert random.Random(0)


def plain_offsets(episodes, days, fields):
    """Offsets by plain loops; days: {well: [(n, rate or None)]} in order, fields: {well: field}."""
    out = {}
    for well, a, z in episodes:
        changes = []
        others = [w for w in fields if fields[w] == fields[well] and w != well]
        for w in others:
            rows = days[w]
            inside = [i for i, (n, _) in enumerate(rows) if a <= n <= z]
            during = [rows[i][1] for i in inside if rows[i][1] is not None]
            if not during or inside[0] < fixed.MIN_CHANNEL_READINGS:
                continue
            before = [q for _, q in rows[max(0, inside[0] - fixed.BASELINE_ROWS) : inside[0]] if q is not None]
            if before and statistics.median(before) > 0:
                changes.append((statistics.median(during) - statistics.median(before)) / statistics.median(before))
        down = sum(c <= fixed.OFFSET_DOWN for c in changes)
        wide = bool(others) and down >= max(1, len(others) // 2)
        out[well, a, z] = (len(others), len(changes), down, statistics.median(changes) if changes else None, wide)
    return out


def test_offsets_against_plain_loops(spark):
    draw = random.Random(8)
    fields = {f"w{i}": "north" if i < 7 else "south" if i < 9 else "alone" for i in range(10)}
    days = {w: [(n, draw.choice([None, 0.0, 50.0, 80.0, 100.0, 120.0])) for n in range(draw.choice([0, 4, 90]), 160) if draw.random() < 0.8] for w in fields}
    days["w6"] = [(n, q) for n, q in days["w6"] if n > 130]
    spans = [(100, 120), (100, 120), (60, 75), (140, 158), (3, 9)]
    episodes = [(w, *draw.choice(spans)) for w in ("w0", "w0", "w1", "w2", "w3", "w7", "w8", "w9")] + [("w4", 100, 120), ("w5", 100, 120)]
    episodes = sorted(set(episodes))
    rows = [(w, fields[w], day(n), q) for w, held in days.items() for n, q in held]
    table = spark.createDataFrame(rows, "well string, field string, production_date date, q_24h double")
    asked = spark.createDataFrame([(w, day(a), day(z)) for w, a, z in episodes], "well string, onset date, offset date")
    want = plain_offsets(episodes, days, fields)
    got = og.offsets(asked, table, "field").collect()
    assert len(got) == len(want)
    for r in got:
        others, compared, down, middle, wide = want[r.well, (r.onset - START).days, (r.offset - START).days]
        assert (r.other_wells, r.wells_compared, r.wells_also_down, r.field_wide) == (others, compared, down, wide)
        assert (r.median_rate_change is None) == (middle is None) and (middle is None or r.median_rate_change == pytest.approx(middle))


def test_offsets_pair_no_day_with_a_range(spark):
    """A range of dates is worked once for a bucket of wells, and its changes are one row."""
    table = spark.createDataFrame([(f"w{i}", "north", day(n), 100.0 + i) for i in range(6) for n in range(90)], "well string, field string, production_date date, q_24h double")
    asked = spark.createDataFrame([(f"w{i}", day(80), day(89)) for i in range(6)], "well string, onset date, offset date")
    plan = og.offsets(asked, table, "field")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "_cell" not in plan
    placed = table.withColumnRenamed("field", "_group")
    sizes = spark.createDataFrame([("north", 6)], "_group string, wells bigint")
    found = og.offset_changes(asked.withColumn("_group", F.lit("north")), placed, sizes).collect()
    assert len(found) == 1 and len(found[0].changes) == 6 and len(found[0].own) == 6


def test_offsets_in_several_buckets_and_parts(spark, monkeypatch):
    monkeypatch.setattr(og, "WELLS_AT_ONCE", 2)
    monkeypatch.setattr(og, "RANGES_AT_ONCE", 2)
    monkeypatch.setattr(og, "MEDIAN_CELLS", 16)
    test_offsets_against_plain_loops(spark)


@pytest.mark.parametrize("name, times", [("finding_audits", 1), ("hypotheses", 0), ("evidence_passes", 0), ("evidence", 0), ("episode_facts", 0)])
def test_queries_investigate_no_more_than_they_need(spark, monkeypatch, name, times):
    from daytrace.bindings import episode_queries as eq

    calls = []
    whole = investigation.investigate
    monkeypatch.setattr(investigation, "investigate", lambda *a, **k: calls.append(1) or whole(*a, **k))
    getattr(eq, name)(spark, "/root/testdata/sf0.001")
    assert len(calls) == times


@pytest.mark.parametrize("noise", [-1e-15, 0.0, 1e-15])
def test_limits_of_a_shift_hold_to_nine_digits(spark, noise):
    """A shift of one deviation that differs in its last bits counts as one deviation."""
    c = F.lit
    judge = lambda signal: spark.range(1).select(on.status_of(c(signal), c(None).cast("double"), c(True))).first()[0]
    assert [judge(1.0 + noise), judge(0.5 + noise), judge(-1.0 - noise)] == ["supported", "plausible", "contradicted"]
    shape = "well string, onset date, offset date, channels array<struct<channel:string,standardised_shift:double>>"
    bundle = spark.createDataFrame([("w", day(0), day(9), [("choke_size", -1.0 + noise)])], shape)
    assert og.strongest_deviation(bundle).first().channel == "choke_size"
