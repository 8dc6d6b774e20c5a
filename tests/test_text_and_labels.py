import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace import fixed
from daytrace.functions import names
from daytrace.functions import text as ft
from daytrace.functions import units as fu
from daytrace.operators import labels as ol
from daytrace.operators import patterns as opt
from daytrace.operators import recorded_time as ort
from daytrace.operators import sampling as os_
from daytrace.operators import search as osr


def evaluate(spark, values, column, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in rows.select("i", column.alias("x")).orderBy("i").select("x").collect()]




def test_names(spark):
    tokens = ["15_9_F_1_C", "15_9_19_A", "15_9_F_12", "15_9_F_12_T2", "nope", "15_9_19"]
    assert evaluate(spark, tokens, names.name_from_token(F.col("v"))) == ["15/9-F-1 C", "15/9-19 A", "15/9-F-12", "15/9-F-12 T2", None, "15/9-19"]
    mixed = ["15/9-F-1 C", "15_9_F_1_C", " 15/9-19 ", "well 5"]
    assert evaluate(spark, mixed, names.well_of(F.col("v"))) == ["15/9-F-1", "15/9-F-1", "15/9-19", None]
    assert evaluate(spark, mixed, names.is_canonical(F.col("v"))) == [True, False, True, False]


def test_hold_out_test_fails_closed(spark):
    yes = ["15/9-F-4", "15_9_F_5", "15/9-F-7 A", "NO 15/9-F-9", "15/9-f-4", "15/9-F-04", "15/9-F-٤", "somewhere", ""]
    no = ["15/9-F-12", "15/9-F-14", "15_9_F_1_C", "15/9-19 A", "no 15/9-f-12"]
    assert evaluate(spark, yes, names.is_hold_out(F.col("v"))) == [True] * len(yes)
    assert evaluate(spark, no, names.is_hold_out(F.col("v"))) == [False] * len(no)
    label = ["15/9-F-4", "15/9-F-5 A", "15/9-F-4 and more", "15/9-F-12", "unknown"]
    assert evaluate(spark, label, names.is_hold_out_label(F.col("v"))) == [True, True, True, False, False]


def test_hold_out_mentions_and_versions(spark):
    text = ["see 15/9-F-4 log", "15_9_F_4_2008_01_01.xml", "15/9-F-41 only", "nothing", "15.9.F.7 too"]
    assert evaluate(spark, text, names.hold_out_mentioned(F.col("v"))) == ["15/9-F-4", "15/9-F-4", None, None, "15/9-F-7"]
    assert evaluate(spark, ["extractor-v0", "v12", "extractor-v02", "v", "av3", "x-V3 "], names.version_number(F.col("v"))) == [0, 12, None, None, None, 3]


def test_units(spark):
    rows = [(1, 1.0, "BBL ", "liquid"), (2, 1.0, "m3", "gas"), (3, 1.0, "mscf", "gas"), (4, 1.0, "pint", "liquid")]
    df = spark.createDataFrame(rows, "i int, n double, u string, f string")
    got = df.orderBy("i").select(fu.to_sm3(F.col("n"), F.col("u"), F.col("f")), fu.volume_unit_problem(F.col("u"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [(0.158987294928, None), (None, "actual_conditions"), (28.316846592, None), (None, "unknown_unit")]
    assert evaluate(spark, ["min", "Day", "week"], fu.to_hours(F.lit(2.0), F.col("v"))) == [2.0 * (1 / 60), 48.0, None]


def test_spans_sentences_reasons(spark):
    long = "word " * 60
    texts = ["Pump failed at once. Then more.", "Short. And then a longer part; end", long, "  ", "A part that ends; and more. x"]
    assert evaluate(spark, texts, ft.opening_span(F.col("v"))) == ["Pump failed at once.", "Short. And then a longer part;", long[:160].rstrip(), "", "A part that ends; and more."]
    find = ft.sentence_with(F.col("v"), F.array(F.lit("choke"), F.lit("valve")))
    got = evaluate(spark, ["All well. Choke closed now. End", "no hit", "line one\nthe valve\nend", "chokeline"], find)
    assert got == ["Choke closed now", None, "the valve", "chokeline"]
    assert evaluate(spark, ["Stopped DUE TO weather", "stopped", None], ft.states_a_reason(F.col("v"))) == [True, False, False]
    assert evaluate(spark, ["", "a", " "], ft.is_verbatim(F.col("v"), F.lit("abc"))) == [False, True, False]


def test_stray_numbers_and_wording(spark):
    texts = ["In 2012 well 15/9-F-12 A fell 12% on 2010-01-02", "lost 1,200.5 and 7 units", "20 percent or 5 per cent", "F12 x3 v1.2"]
    assert evaluate(spark, texts, ft.stray_numbers(F.col("v"))) == [[], ["1,200.5", "7"], [], []]
    rows = spark.createDataFrame(
        [(1, "Root cause unresolved", None), (2, "It was caused by wear, a root-cause", "proximate_driver"), (3, "caused by x", "documented_root_cause")],
        "i int, t string, l string",
    )
    got = rows.orderBy("i").select(ft.wording_above_level(F.col("t"), F.col("l"))).collect()
    assert [sorted(r[0]) for r in got] == [[], ["caused by", "root-cause"], []]


def plain_search(chunks, query, limit=5, keep=lambda c: True):
    token = re.compile(r"[a-z0-9][a-z0-9/'\-]*")
    bags = {c["chunk_id"]: Counter(token.findall(c["text"].lower())) for c in chunks}
    average = sum(sum(b.values()) for b in bags.values()) / len(bags)
    scored = []
    for c in chunks:
        bag, total = bags[c["chunk_id"]], 0.0
        for t in sorted(set(token.findall(query.lower()))):
            if bag[t]:
                df = sum(1 for b in bags.values() if b[t])
                weight = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
                total += weight * bag[t] * 2.5 / (bag[t] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / average))
        if total > 0 and keep(c):
            scored.append((-total, c["chunk_id"]))
    return [i for _, i in sorted(scored)[:limit]]


def test_search_matches_a_plain_scan(spark):
    rng = random.Random(1)
    words = "choke valve 15/9-f-12 pump mud well's shut-in casing drill wait".split()
    chunks = [
        {"chunk_id": f"c{i:03}", "text": " ".join(rng.choices(words, k=rng.randint(1, 30))), "well": rng.choice("AB"), "report_date": f"2010-01-{rng.randint(1, 28):02}"}
        for i in range(120)
    ]
    table = spark.createDataFrame([tuple(c.values()) for c in chunks], "chunk_id string, text string, well string, d string")
    table = table.withColumn("report_date", F.to_date("d"))
    asked = [("q0", "Choke valve", None, None), ("q1", "pump pump WAIT", "A", "2010-01-05"), ("q2", "15/9-F-12 shut-in", "B", None), ("q3", "absent", None, None)]
    queries = spark.createDataFrame(asked, "query_id string, query string, well string, a string")
    queries = queries.withColumn("on_or_after", F.to_date("a")).withColumn("on_or_before", F.when(F.col("a").isNotNull(), F.to_date(F.lit("2010-01-20"))))
    got = {q: [] for q, *_ in asked}
    for r in osr.search(table, queries).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    for q, text, well, after in asked:
        ok = lambda c, w=well, a=after: (w is None or c["well"] == w) and (a is None or a <= c["report_date"] <= "2010-01-20")
        assert got[q] == plain_search(chunks, text, keep=ok)
    built = osr.search_index(osr.build_index(table), queries.where("well is null").select("query_id", "query"))
    assert [r.chunk_id for r in built.orderBy("rank").collect()] == plain_search(chunks, "Choke valve")


def test_pruned_search_over_rare_and_common_terms(spark):
    """Common words in most chunks, rare ones in few, and queries that mix them; ties go to the smaller id."""
    rng = random.Random(2)
    common, rare = [f"w{i}" for i in range(8)], [f"r{i}" for i in range(200)]
    chunks = [{"chunk_id": f"c{i:04}", "text": " ".join(rng.choices(common, k=rng.randint(1, 12)) + rng.sample(rare, rng.randint(0, 2)))} for i in range(700)]
    chunks += [{"chunk_id": f"d{i:04}", "text": "w0 w1 r0"} for i in range(30)] + [{"chunk_id": "e", "text": ""}]
    table = spark.createDataFrame([tuple(c.values()) for c in chunks], "chunk_id string, text string")
    asked = {"a": "w0 w1 w2 r5", "b": "r0 w1", "c": "w0", "d": "w3 w4 w5 w6 w7", "e": "r1 r2 r3 r4", "f": "nothing", "g": " ".join(common + rare[:20])}
    index = osr.build_index(table)
    got = {q: [] for q in asked}
    for r in osr.search_index(index, spark.createDataFrame(list(asked.items()), "query_id string, query string")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    assert got == {q: plain_search(chunks, text) for q, text in asked.items()}


def test_term_counts_stay_in_their_row(spark):
    table = spark.createDataFrame([("a", "b a b c b"), ("e", ""), ("n", None)], "chunk_id string, text string")
    counts = osr.term_counts(table)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = {r.chunk_id: (r.length, [tuple(t) for t in r.terms or []]) for r in counts.collect()}
    assert got["a"] == (5, [("a", 1), ("b", 3), ("c", 1)]) and got["e"] == (0, []) and got["n"][1] == []


def test_gaps_and_overlaps_match_a_plain_union(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for key in range(40):
        spans = []
        for _ in range(rng.randint(1, 25)):
            start = rng.randint(0, 3000)
            spans.append((start, start + rng.choice([0, 5, 30, 90, 600])))
        rows += [(key, s, e) for s, e in spans]
        covered, reached, gap = 0, None, 0
        for s, e in sorted(spans):
            if reached is not None and s > reached:
                gap += s - reached
            covered += max(0, e - max(s, reached if reached is not None else s))
            reached = e if reached is None else max(reached, e)
        want[key] = (gap / 60, (sum(e - s for s, e in spans) - covered) / 60)
    df = spark.createDataFrame(rows, "key int, s int, e int")
    df = df.select("key", F.timestamp_seconds(F.col("s") * 60).alias("start_time"), F.timestamp_seconds(F.col("e") * 60).alias("end_time"))
    for slice_seconds in (3600, 300, 10**7):
        got = {r.key: (r.gap_hours, r.overlap_hours) for r in ort.span_coverage(df, ["key"], slice_seconds).collect()}
        assert all(got[k] == pytest.approx(want[k]) for k in want)


EVENTS = "event_id string, well string, subcategory string, state_detail string, duration_hours double, source_document string, report_date date, comment string"


def test_patterns_recur_by_wells_and_hours(spark):
    import datetime as dt

    day = dt.date(2010, 1, 1)
    rows = [(f"e{i}", f"w{i % 3}", "wait", "x", 10.0, "d", day, "Waiting for parts. Then more.") for i in range(6)]
    rows += [("f1", "w0", "fish", "x", 99.0, "d", day, ""), ("f2", "w1", "fish", "x", 99.0, "d", day, "text")]
    events = spark.createDataFrame(rows, EVENTS)
    built = opt.register(events, labelled=events.where("event_id in ('e1', 'f1')"), miscoded=events.where("event_id = 'e1'"))
    got = {r.subcategory: r for r in built.collect()}
    assert got["wait"].recurring and not got["fish"].recurring
    assert got["wait"].cited_event_id == "e5" and got["wait"].cited_span == "Waiting for parts."
    assert (got["wait"].labelled_events, got["wait"].miscoded_fraction) == (1, 1.0)
    totals = opt.register_totals(built).first()
    assert (totals.patterns, totals.excluded_hours, totals.corpus_hours) == (1, 198.0, 258.0)
    assert opt.register(events, wells=events.where("well = 'w0'").select("well")).agg(F.sum("events")).first()[0] == 3
    amount, stated = opt.cost_equivalent(F.lit(48.0), None)
    assert spark.range(1).select(amount, stated).first() == (None, None)


def test_scores_and_bootstrap(spark):
    rng = random.Random(4)
    causes = ["hole_problem", "rig_service", "not_stated", "well_control"]
    gold = [rng.choices(causes, [5, 4, 3, 0.1])[0] for _ in range(300)]
    good = [g if rng.random() < 0.8 else rng.choice(causes) for g in gold]
    weak = [g if rng.random() < 0.4 else rng.choice(causes) for g in gold]

    def macro(g, p):
        out = []
        for c in set(g):
            n, claimed, hits = g.count(c), p.count(c), sum(a == b == c for a, b in zip(g, p, strict=True))
            if n >= 5:
                out.append(2 * hits / (n + claimed))
        return sum(out) / len(out)

    pairs = spark.createDataFrame(list(zip(gold, good, weak, strict=True)), "gold string, candidate string, baseline string")
    got = ol.macro_f1(ol.class_scores(pairs, "gold", "candidate")).first().macro_f1
    assert got == pytest.approx(macro(gold, good))
    draws = []
    for s in range(1500):
        picks = np.random.default_rng(s).integers(0, 300, 300)
        g, a, b = ([x[i] for i in picks] for x in (gold, good, weak))
        draws.append(macro(g, a) - macro(g, b))
    interval = ol.bootstrap_margin(spark, pairs).first()
    assert interval.low == pytest.approx(np.quantile(draws, 0.025), abs=0.03)
    assert interval.high == pytest.approx(np.quantile(draws, 0.975), abs=0.03)
    assert ol.bootstrap_margin(spark, pairs.repartition(3)).first() == interval


LABELLED = "cause string, label_source string, evidence_span string, comment string, candidate string, forced string, base string"


def test_selection_conditions_gate_only_with_expert_labels(spark):
    rows = [("hole_problem", "expert", "stuck", "it got stuck", "hole_problem", "rig_service", "rig_service")] * 20
    rows += [("rig_service", "expert", "service", "rig service", "rig_service", "hole_problem", "hole_problem")] * 20
    frame = spark.createDataFrame(rows, LABELLED)
    found = ol.selection_conditions(spark, frame, ("base",))
    assert all(r.passed and r.gates for r in found.collect())
    assert ol.approach_selected(found).first().selected
    machine = ol.selection_conditions(spark, frame.withColumn("label_source", F.lit("machine_assisted")), ("base",))
    assert [r.gates for r in machine.collect()] == [False, False, True, True]
    assert not ol.approach_selected(machine).first().selected
    bad = frame.withColumn("evidence_span", F.lit("made up"))
    assert not {r.name: r.passed for r in ol.selection_conditions(spark, bad, ("base",)).collect()}["evidence spans verbatim"]


def test_label_rules(spark):
    events = spark.createDataFrame([("e", "the pump broke")], "event_id string, comment string")
    rows = [
        ("e", "other", "expert", "pump"), ("x", "other", "expert", "pump"), ("e", "odd", "expert", "pump"), ("e", "other", "hearsay", "pump"),
        ("e", "not_stated", "expert", "pump"), ("e", "other", "expert", None), ("e", "other", "expert", "motor"), ("e", "not_stated", "expert", None),
    ]
    labels = spark.createDataFrame(rows, "event_id string, cause string, label_source string, evidence_span string")
    got = sorted(tuple(r.problems) for r in ol.join_to_events(labels, events).collect())
    assert got == sorted([(), (), ("event_not_in_store",), ("unknown_cause",), ("unknown_label_source",), ("span_without_cause",), ("cause_without_span",), ("span_not_verbatim",)])
    extra = labels.withColumns({"applied_rule": F.lit(None).cast("string"), "cause_notes": F.lit("could be rig_service")})
    assert ol.rule_counts(extra).first().rows == 8
    assert ol.note_counts(extra).first().rows_naming_another_label == 8


def test_draws_are_round_robin_and_reproducible(spark):
    import datetime as dt

    rows = [(f"a{i}", "wait", "15/9-F-12", dt.date(2010, 1, 1)) for i in range(50)] + [(f"b{i}", "fish", "15/9-F-12", dt.date(2010, 1, 1)) for i in range(3)]
    rows += [(f"c{i}", "", "15/9-F-12", dt.date(2010, 1, 1)) for i in range(9)] + [("late", "fish", "15/9-F-12", dt.date(2014, 7, 25)), ("held", "fish", "15/9-F-4", dt.date(2010, 1, 1))]
    events = spark.createDataFrame(rows, "event_id string, subcategory string, well string, report_date date")
    drawn = os_.draw(events, target=20)
    counts = {r.stratum: r.drawn for r in os_.sample_manifest(drawn).collect()}
    assert counts == {"(none)": 9, "fish": 3, "wait": 8}
    assert {r.event_id for r in drawn.collect()} == {r.event_id for r in os_.draw(events.repartition(4), target=20).collect()}
    assert [r.event_id for r in os_.draw(events, "hold-out").collect()] == ["held"]
    with pytest.raises(ValueError):
        os_.draw(events, "other")
    for contested, rest, expect in [(30, 30, (10, 10)), (4, 30, (4, 16)), (30, 5, (15, 5))]:
        labels = spark.createDataFrame(
            [(f"x{i}", "rig_service") for i in range(contested)] + [(f"y{i}", "other") for i in range(rest)], "event_id string, cause string"
        )
        ids = os_.adjudication_ids(labels, 20).collect()
        assert (sum(r.contested for r in ids), sum(not r.contested for r in ids)) == expect
        assert sorted(r.position for r in ids) == list(range(1, 21))
    assert os_.unplaced_labels(labels, events.where("event_id like 'x%'")).count() == 35
    assert fixed.CONTESTED_CAUSES


def test_hours_agree_up_to_the_limit_whatever_the_order(spark):
    from daytrace.operators import recorded_time as ort

    # 0.1 + 0.2 - 0.29 is 0.01 and a rounding error more.
    walked = spark.createDataFrame([("u", 0.1 + 0.2, 0.0, 0.29, 2)], "well string, npt_hours double, non_npt_recorded_hours double, summed_block_hours double, npt_blocks bigint")
    events = spark.createDataFrame([("u", 0.29)], "well string, duration_hours double")
    assert abs(0.1 + 0.2 - 0.29) > 0.01
    found = ort.reconcile(walked, events).first()
    assert found.hours_agree and found.categories_sum and not found.counts_agree
