import gzip

import pytest
from brute import sha
from pyspark.sql import functions as F

from daytrace.llm import archives


def round_trip(spark, rows, path, versions="CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END"):
    pages = spark.createDataFrame([(k, u, h, "x", 0) for k, u, h in rows], "page_id bigint, url string, html string, id string, version int")
    packed = archives.pages_to_arc(pages, "page_id", "url", "html", versions)
    archives.write_warc(archives.with_types(archives.convert(packed)), path)
    return archives.resolved(archives.read_warc(spark, path)).collect()


def test_pages_through_both_formats(spark, tmp_path):
    big = "é" * 200
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nHTTP/1.1 200 OK\r\nX-Record-Id: 99\r\n\r\n" + "y" * 100
    rows = [(4, "http://a b/é", big), (2, "http://a/", big), (9, None, big), (3, "x", None), (5, "y", ""), (6, "z", "small"), (8, "z", "small"), (7, "t", tricky), (11, "t", tricky), (12, "l", "\r\n\r\n" * 300_000)]
    got = {r.id: r for r in round_trip(spark, rows, str(tmp_path / "w"))}
    assert len(got) == len(rows)
    for k, _, html in rows:
        data = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].sound) == (len(data), sha(data), True)
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {4: 2, 9: 2, 11: 7}
    assert got[4].uri == "http://a%20b/%C3%A9" and got[9].uri == "-"
    files = [f for f in (tmp_path / "w").iterdir() if f.name.endswith(".gz")]
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC-Refers-To: <urn:uuid:") == 3 and b"WARC-Date: 2024-01-01T00:00:00Z" in text


def test_null_and_repeated_ids_and_no_rows(spark, tmp_path):
    same = "q" * 150
    got = round_trip(spark, [(None, "a", same), (1, "b", same), (1, "c", same), (None, "d", "r" * 120), (None, "e", "r" * 120)], str(tmp_path / "w"), "1")
    kinds = sorted((r.id or 0, r.record_type, r.refers_to or 0, r.payload_digest == sha(same)) for r in got)
    assert kinds == [(0, "response", 0, False), (0, "response", 0, False), (0, "revisit", 1, True), (1, "response", 0, True), (1, "response", 0, True)]
    assert round_trip(spark, [], str(tmp_path / "none")) == []


def test_arc_parser_goes_by_lengths():
    for version in (1, 2):
        block = b"HTTP/1.0 200 OK\r\n\r\nhttp://x 0.0.0.0 20200101000000 text/html 5\nabcde"
        data = archives.arc_start(version, "n.arc", "20200101000000") + archives.arc_record(version, "http://u/", "20200102030405", block, 7, "n.arc") + archives.arc_record(version, "", "20200102030405", b"", 9, "n.arc")
        one, two = archives.parse_arc(data)
        assert one.block == block and two.block == b"" and one.fields["URL"] == "http://u/" and two.fields["URL"] == "-"
        assert list(one.fields) == archives.FIELDS[version].split()
        with pytest.raises(ValueError, match="cut off"):
            list(archives.parse_arc(data[:-20] if version == 1 else data.replace(b" 0\n\n", b" 50\n\n")))
    with pytest.raises(ValueError, match="version block"):
        list(archives.parse_arc(b"http://x 1 2 3 4\n"))
    assert list(archives.parse_arc(b"")) == []


def test_binary_payloads_and_converted_fields(spark):
    block = b"HTTP/1.1 200 OK\r\n\r\n\xff\x00\xfe"
    data = archives.arc_start(1, "n", "20200101000000") + archives.arc_record(1, "u", "20210203040506", block, 0, "n")
    row = archives.convert(spark.createDataFrame([("n", bytearray(data))], "name string, content binary")).first()
    assert row.payload == b"\xff\x00\xfe" and row.date == "2021-02-03T04:05:06Z" and row.id is None
    again = archives.convert(spark.createDataFrame([("n", bytearray(data))], "name string, content binary")).first()
    assert row.record_id == again.record_id


def test_warc_reader_takes_members_and_refuses_torn_files():
    record = archives.warc_record({"record_type": "response", "record_id": "<a>", "uri": "u", "date": "d", "mime": "m", "head": b"", "payload": b"p" * 10, "payload_digest": "x", "whole": None}) + b"\r\n"
    members = gzip.compress(record) + gzip.compress(record * 2)
    assert len(list(archives.parse_warc(archives._inflated(members)))) == 3
    assert [b for _, b in archives.parse_warc(archives._inflated(record))] == [b"p" * 10]
    with pytest.raises(ValueError, match="cut off"):
        list(archives.parse_warc([record[:-9]]))


def test_types_of_one_payload_spread_over_tasks(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("r"), "id").alias("record_id"), F.lit("u").alias("uri"), F.lit("d").alias("date"), F.lit(100).cast("bigint").alias("payload_bytes"), F.lit("same").alias("payload_digest"))
    got = archives.with_types(rows).groupBy("record_type", "refers_to").count().collect()
    assert sorted((r.record_type, r.refers_to or 0, r["count"]) for r in got) == [("response", 0, 1), ("revisit", 0, 499)]
