import datetime as dt
import gzip
import hashlib
import random

import pytest
from pyspark.errors import PySparkException

from daytrace import fixed
from daytrace.operators import days as od
from daytrace.operators import events as oe
from daytrace.operators import recorded_time as ort
from daytrace.sources import daily, files, labels, reports, store
from daytrace.streaming.replay import replay_days

SOURCE = ", ".join(f"{c} double" for c in daily.NUMBERS) + (
    ", DATEPRD date, NPD_WELL_BORE_NAME string, AVG_CHOKE_UOM string, FLOW_KIND string, WELL_TYPE string"
)


def source_rows(spark, *changes):
    base = {n: 1.0 for n in daily.NUMBERS} | {
        "DATEPRD": dt.date(2010, 6, 1), "NPD_WELL_BORE_NAME": " 15/9-F-12 ", "AVG_CHOKE_UOM": "%", "FLOW_KIND": "production", "WELL_TYPE": "OP",
    }
    return spark.createDataFrame([{**base, **c} for c in changes], SOURCE)


def test_daily_rows_are_mapped_and_empty_rows_skipped(spark, tmp_path):
    empty = {c: None for c in (*daily.NUMBERS, "DATEPRD", "NPD_WELL_BORE_NAME", "AVG_CHOKE_UOM", "FLOW_KIND", "WELL_TYPE")}
    df = source_rows(spark, {}, {"FLOW_KIND": "injection", "BORE_OIL_VOL": None}, {"FLOW_KIND": None}, empty)
    df.write.parquet(str(tmp_path / "p"))
    got = daily.read_parquet(spark, str(tmp_path / "p"))
    assert {r.well_status for r in got.collect()} == {"producing", "injecting", None}
    assert got.count() == 3 and {r.well for r in got.collect()} == {"15/9-F-12"}
    df.limit(2).write.option("header", True).csv(str(tmp_path / "c"))
    assert daily.read_csv(spark, str(tmp_path / "c")).count() == 2
    assert od.classify(got).where("day_class = 'non_producing'").count() == 1


@pytest.mark.parametrize(
    "change", [{"FLOW_KIND": "mystery"}, {"NPD_WELL_BORE_NAME": "  "}, {"BORE_OIL_VOL": float("nan")}, {"DATEPRD": None}]
)
def test_bad_daily_rows_fail_the_job(spark, change):
    with pytest.raises(PySparkException):
        daily.from_source_columns(source_rows(spark, change), "x").collect()


def test_missing_columns_wrong_types_and_text_numbers_are_refused(spark, tmp_path):
    with pytest.raises(daily.SourceSchemaError):
        daily.from_source_columns(source_rows(spark, {}).drop("FLOW_KIND"), "x")
    with pytest.raises(daily.SourceSchemaError):
        daily.from_source_columns(source_rows(spark, {}).withColumn("AVG_WHP_P", oe.F.lit("much")), "x")
    df = source_rows(spark, {}).toPandas()
    df["AVG_WHP_P"] = "many"
    df.to_csv(tmp_path / "bad.csv", index=False)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        daily.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def activity(start, end, code="drilling -- drill", state="ok", comment="Text. More."):
    return (
        f"<witsml:activity><witsml:dTimStart>{start}</witsml:dTimStart><witsml:dTimEnd>{end}</witsml:dTimEnd>"
        f"<witsml:proprietaryCode>{code}</witsml:proprietaryCode><witsml:state>{state}</witsml:state>"
        f"<witsml:stateDetailActivity>success</witsml:stateDetailActivity><witsml:comments> {comment} </witsml:comments></witsml:activity>"
    )


def document(*groups, head=""):
    body = "".join(f"<witsml:drillReport>{''.join(g)}</witsml:drillReport>" for g in groups)
    ns = 'xmlns:witsml="http://www.witsml.org/schemas/1series"'
    return f'<?xml version="1.0" encoding="UTF-8"?>{head}<witsml:drillReports {ns}>{body}</witsml:drillReports>'


T = "2010-06-01T{:02d}:00:00+02:00"


@pytest.fixture
def folder(tmp_path):
    good = document(
        [activity(T.format(0), T.format(4)), activity(T.format(4), T.format(6), "interruption -- repair"), activity(T.format(8), T.format(9), "Interruption -- wait", comment="")],
        [activity(T.format(8), T.format(10), state="FAIL"), activity(T.format(10), T.format(9), "interruption -- fish")],
    )
    (tmp_path / "15_9_F_12_2010_06_01.xml").write_text(good)
    (tmp_path / "15_9_F_12_B_2010_06_02.xml").write_text(document([]))
    (tmp_path / "15_9_19_A_2010_06_03.xml").write_text(document([activity("", "")]))
    (tmp_path / "15_9_F_1_2010_06_04.xml").write_text(document([], head="<!DOCTYPE x [<!ENTITY a 'b'>]>"))
    (tmp_path / "15_9_F_1_2010_06_05.xml").write_text(document([]).replace("</witsml:drillReports>", ""))
    include = '<xi:include xmlns:xi="http://www.w3.org/2001/XInclude" href="a"/></witsml:drillReports>'
    (tmp_path / "15_9_F_1_2010_06_06.xml").write_text(document([]).replace("</witsml:drillReports>", include))
    (tmp_path / "15_9_F_1_2010_06_07.txt").write_text(document([]))
    (tmp_path / "nameless.xml").write_text(document([]))
    (tmp_path / "15_9_F_1_2010_06_08.xml").write_text(document([activity(T.format(0), T.format(1), comment="x" * 9000)]))
    return str(tmp_path)


def test_reports_are_refused_before_they_are_read(spark, folder):
    scanned = reports.scan(spark, folder, max_bytes=5000)
    reasons = {r.source: r.reason for r in reports.refused(scanned).collect()}
    assert reasons == {
        "15_9_F_1_2010_06_04.xml": "unsafe_input", "15_9_F_1_2010_06_05.xml": "malformed_input",
        "15_9_F_1_2010_06_06.xml": "unsafe_input", "15_9_F_1_2010_06_07.txt": "unsafe_input",
        "nameless.xml": "malformed_input", "15_9_F_1_2010_06_08.xml": "unsafe_input",
    }


def test_events_ids_indices_and_recorded_time(spark, folder):
    usable = reports.usable(reports.scan(spark, folder, max_bytes=5000))
    blocks = reports.blocks(usable).cache()
    assert {(r.well, r.wellbore) for r in usable.collect()} == {("15/9-F-12", "15/9-F-12"), ("15/9-F-12", "15/9-F-12 B"), ("15/9-19", "15/9-19 A")}
    events = oe.extract(blocks).cache()
    rows = {(r.subcategory, r.state): r for r in events.collect()}
    assert len(rows) == 4
    wait = rows[("wait", "ok")]
    text = "|".join(["15_9_F_12_2010_06_01.xml", T.format(8), "Interruption -- wait", "2"])
    assert wait.event_id == "npt_" + hashlib.sha256(text.encode()).hexdigest()[:16]
    assert wait.review_reasons == ["no_comment"] and wait.needs_review and wait.duration_hours == 1.0
    assert rows[("fish", "ok")].review_reasons == ["negative_duration"]
    assert rows[("drill", "FAIL")].category == "drilling"
    assert oe.chunks(events).count() == 3
    totals = {r.well: r for r in ort.per_well(blocks, usable.select("well", "source_document")).collect()}
    assert totals["15/9-F-12"].reports == 2 and totals["15/9-F-12"].npt_blocks == 4
    assert totals["15/9-19"].untimed_blocks == 1 and totals["15/9-19"].summed_block_hours == 0.0
    assert totals["15/9-F-12"].unclassified_gap_hours == 2.0 and totals["15/9-F-12"].concurrent_overlap_hours == 0.0
    assert oe.integrity_findings(blocks, events).count() == 0
    assert oe.integrity_summary(blocks, events).first().detection_exact
    broken = events.where("subcategory <> 'wait'").unionByName(events.where("subcategory = 'fish'"))
    kinds = sorted(r.kind for r in oe.integrity_findings(blocks, broken).collect())
    assert kinds == ["duplicate_event_id", "missing_event", "unexpected_event"]
    stray = events.withColumn("activity_code", oe.F.lit("drilling -- other"))
    assert {r.kind for r in oe.integrity_findings(blocks, stray).collect()} >= {"missing_event", "unexpected_event"}


def test_lost_time_without_times_is_an_error_not_a_skip(spark, tmp_path):
    (tmp_path / "15_9_F_12_2010_06_01.xml").write_text(document([activity("soon", T.format(1), "interruption -- wait")]))
    blocks = reports.blocks(reports.usable(reports.scan(spark, str(tmp_path))))
    with pytest.raises(PySparkException, match="no usable timestamps"):
        oe.extract(blocks).collect()
    assert oe.extract(blocks, strict=False).count() == 0


def test_activity_dates_come_from_names_only(spark, folder, tmp_path):
    listed = reports.listing(spark, folder).where("file_name like '15%'")
    dates = {(r.well, str(r.activity_date)) for r in reports.activity_dates(listed).collect()}
    assert ("15/9-F-12", "2010-06-02") in dates and ("15/9-19", "2010-06-03") in dates
    with pytest.raises(PySparkException, match="unrecognised"):
        reports.activity_dates(reports.listing(spark, folder)).collect()


def test_store_versions_are_written_once_and_verified(spark, folder, tmp_path_factory):
    events = oe.extract(reports.blocks(reports.usable(reports.scan(spark, folder, max_bytes=5000))))
    root = str(tmp_path_factory.mktemp("store"))
    kept = store.VersionedStore(spark, root)
    kept.write(events, "v1", source_directory="reports", source_files=9)
    assert kept.versions() == ["v1"] and kept.manifest("v1").first().event_count == 4
    assert kept.verify("v1").first().verified
    assert store.content_digest(store.digestible(events)).first() == store.content_digest(store.digestible(events.repartition(3))).first()
    kept.read("v1").limit(1).write.mode("append").parquet(f"{root}/v1/events")
    assert not kept.verify("v1").first().verified
    for bad in ("v1", "../x", "a b"):
        with pytest.raises(store.StoreError):
            kept.write(events, bad)
    with pytest.raises(store.StoreError):
        kept.digest("v9")


def test_digest_sees_nulls_copies_and_values(spark):
    schema = "a string, b int"
    digest = lambda rows: store.content_digest(spark.createDataFrame(rows, schema)).first().content_hash
    same = digest([("x", 1), ("y", 2)])
    assert same == digest([("y", 2), ("x", 1)])
    others = [digest(r) for r in ([("x", 1)], [("x", 1), ("x", 1)], [("x", None), ("y", 2)], [("", 1), ("y", 2)], [(None, 1), ("y", 2)])]
    assert len({same, *others}) == 6


def test_file_manifest_statuses(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a": "one", "sub/b": "two", "c": "three"}.items():
        (tmp_path / name).write_text(text)
    found = files.fingerprints(spark, str(tmp_path)).cache()
    assert {r.path for r in found.collect()} == {"a", "sub/b", "c"}
    sha = {r.path: r.sha256 for r in found.collect()}
    assert sha["a"] == hashlib.sha256(b"one").hexdigest()
    recorded = [("a", 3, sha["a"].upper()), ("sub/b", 4, sha["sub/b"]), ("gone", 1, "00"), ("c", 5, "00")]
    manifest = spark.createDataFrame(recorded, "path string, size long, sha256 string")
    got = {r.path: r.status for r in files.verify(found, manifest).collect()}
    assert got == {"a": "ok", "sub/b": "SIZE", "gone": "MISSING", "c": "CHECKSUM"}
    assert {r.path: r.status for r in files.verify(found, manifest.where("path <> 'a'")).collect()}["a"] == "UNRECORDED"


def test_great_files_are_not_one_row(spark, tmp_path, monkeypatch):
    """Rows of at most 1,000 bytes stand for the 2 GB that a row may have."""
    monkeypatch.setattr(files, "WHOLE_BYTES", 1000, raising=False)
    draw, mark = random.Random(5), b"\xef\xbb\xbf"
    texts = {
        "small": b"one", "lines": b"ab\n" * 60_000, "open end": b"ab\n" * 60_000 + b"x", "feeds": b"\n" * 30_000, "no feed": bytes(90_000),
        "crlf": b"a\r\n\r" * 20_000, "random.parquet": draw.randbytes(200_000), "mark": mark + b"ab\n" * 20_000, "mark, open": mark + b"ab\n" * 20_000 + b"x",
        "really.gz": gzip.compress(draw.randbytes(50_000)), "not.gz": b"text\n" * 9000, "not.snappy": draw.randbytes(5000), "sub/a %20+\u00e9": draw.randbytes(99_999),
    }
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    limits = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "40000", "spark.sql.files.openCostInBytes": "1000"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = {r.path: (r.size, r.sha256) for r in files.fingerprints(spark, str(tmp_path)).collect()}
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert got == {name: (len(text), hashlib.sha256(text).hexdigest()) for name, text in texts.items()}


def test_label_files_need_their_fields(spark, tmp_path):
    line = '{"event_id": "e", "cause": "other", "labeller_pass": "p", "label_source": "expert"}\n'
    (tmp_path / "good.jsonl").write_text(line)
    assert labels.read_labels(spark, str(tmp_path / "good.jsonl")).first().evidence_span is None
    (tmp_path / "bad.jsonl").write_text(line + '{"event_id": "e", "cause": "other", "labeller_pass": "p"}\n')
    with pytest.raises(PySparkException, match="label_source"):
        labels.read_labels(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "broken.jsonl").write_text(line + "{not json\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        labels.read_labels(spark, str(tmp_path / "broken.jsonl")).collect()


def test_logs_append_exports_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("W", 1)], "well string, n int")
    for _ in range(2):
        store.append_rows(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    store.export(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().well == "W"
    with pytest.raises(PySparkException):
        store.export(rows, str(tmp_path / "out"))


def test_replay_classifies_arriving_files(spark, tmp_path):
    rows = daily.from_source_columns(source_rows(spark, {}, {"ON_STREAM_HRS": 30.0}), "x")
    rows.write.parquet(str(tmp_path / "in"))
    query = replay_days(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert {r.day_class for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"partial", "quarantined"}
    assert fixed.PARSER_VERSION


def plain_coverage(spans):
    """Gaps and overlap by walking the sorted spans."""
    spans = sorted(spans)
    gaps, groups = 0, [list(spans[0])]
    for s, e in spans[1:]:
        if s <= groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], e)
        else:
            gaps += s - groups[-1][1]
            groups.append([s, e])
    return gaps, max(0, sum(e - s for s, e in spans) - sum(e - s for s, e in groups))


def test_spans_that_end_before_they_start(spark):
    draw = random.Random(3)
    cases = {0: [(0, 2), (5, 4), (8, 9)], 1: [(5, 4)], 2: [(0, 9), (5, 4)], 3: [(3, 1), (3, 2), (3, 4)]}
    for k in range(4, 120):
        cases[k] = [(s := draw.randint(0, 20), s + draw.randint(-4, 5)) for _ in range(draw.randint(1, 7))]
    at = lambda h: dt.datetime(2020, 1, 2) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(k, at(s), at(e)) for k, v in cases.items() for s, e in v], "k int, start_time timestamp, end_time timestamp")
    got = {r.k: (round(r.gap_hours), round(r.overlap_hours)) for r in ort.span_coverage(rows, ["k"]).collect()}
    assert got == {k: plain_coverage(v) for k, v in cases.items()} and got[0] == (7, 0)
