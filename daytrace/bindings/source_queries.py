"""Queries over the readers: report XML made of `events`, source day tables, label files, stored versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daytrace.bindings.event_queries import LANES_SQL, block_view
from daytrace.bindings.registry import day, query, rounded
from daytrace.bindings.views import table
from daytrace.operators import events as oe
from daytrace.session import shared_folder
from daytrace.sources import daily, files, labels, reports, store

#: Faults planted in the reports of a user and day, by a number that both engines can make.
FAULT = "({user} * 31 + year({day}) + 7 * month({day}) + 3 * day({day})) % 23"
DOCTYPE, TORN, MISNAMED, INCLUDE, NOT_XML, QUOTED, UNTIMED = 1, 2, 3, 4, 5, 6, 7
INCLUSION = ' xmlns:xi="http://www.w3.org/2001/XInclude"'


def report_texts(spark, folder) -> DataFrame:
    """One report per user and day as (file_name, length, text), two drillReports each, with planted faults.

    The blocks of a report are its events by id; even ids go to the first drillReport.
    """
    c = F.col
    fault = F.expr(FAULT.format(user="CAST(well AS BIGINT)", day="report_date"))
    blocks = block_view(spark, folder).withColumn("fault", fault)
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    end = F.when(c("fault") == UNTIMED, "when done").otherwise(F.date_format("end_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    body = F.concat(
        F.lit("<activity>"),
        tag("dTimStart", c("start_raw")),
        tag("dTimEnd", end),
        tag("proprietaryCode", c("activity_code")),
        tag("state", c("state")),
        tag("stateDetailActivity", c("state_detail")),
        tag("comments", c("comment")),
        F.lit("</activity>"),
    )
    half = lambda odd: F.collect_list(F.when(c("block_index") % 2 == odd, F.struct("block_index", body.alias("xml"))))
    grouped = blocks.groupBy("well", "report_date", "fault").agg(half(0).alias("even"), half(1).alias("odd"))
    part = lambda name: F.concat(
        F.lit("<drillReport>"), F.array_join(F.transform(F.array_sort(name), lambda b: b["xml"]), ""), F.lit("</drillReport>")
    )
    is_ = lambda n, yes, no="": F.when(c("fault") == n, yes).otherwise(no)
    text = F.concat(
        is_(DOCTYPE, "<!DOCTYPE drillReports>"),
        is_(QUOTED, '<!-- <!ENTITY a "b"> --><!-- xi:include -->'),
        F.lit("<drillReports"),
        is_(INCLUDE, INCLUSION),
        F.lit(">"),
        is_(INCLUDE, '<xi:include href="other.xml"/>'),
        part("even"),
        part("odd"),
        is_(TORN, "", "</drillReports>"),
    )
    dated = F.concat(F.lit("15_9_F_"), "well", F.lit("_"), F.translate(c("report_date").cast("string"), "-", "_"))
    name = (
        F.when(c("fault") == MISNAMED, F.concat(F.lit("copy of "), "well", F.lit(" "), c("report_date").cast("string"), F.lit(".xml")))
        .when(c("fault") == NOT_XML, F.concat(dated, F.lit(".txt")))
        .otherwise(F.concat(dated, F.lit(".xml")))
    )
    return grouped.select(name.alias("file_name"), F.octet_length(text).cast("bigint").alias("length"), text.alias("text"))


BLOCK_ROWS_SQL = f"""e AS (
  SELECT *, CAST(ts AS DATE) AS d, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
f AS (SELECT *, {FAULT.format(user="user_id", day="d")} AS fault,
    CASE WHEN event_type = 'error' THEN 'interruption -- ' || ['repair', 'wait', 'waiting on weather', 'fish'][k % 4 + 1]
      ELSE 'drilling -- ' || event_type END AS code,
    CASE WHEN event_type = 'click' AND k % 10 = 0 THEN 'fail' ELSE 'success' END AS state,
    CASE WHEN k % 7 <> 0 THEN 'Pump ' || k || ' stopped. Wait due to ' || event_type || '; crew informed.' ELSE '' END AS comment,
    '15_9_F_' || user_id || '_' || strftime(d, '%Y_%m_%d') AS named FROM e),
blocks AS (
  SELECT named || '.xml' AS source_document, CAST(d AS VARCHAR) AS report_date, '15/9-F-' || user_id AS wellbore, '15/9-F-' || user_id AS well,
    CAST(event_id % 2 AS INTEGER) AS report_index,
    CAST(row_number() OVER (PARTITION BY user_id, d, event_id % 2 ORDER BY event_id) - 1 AS INTEGER) AS block_index,
    code, state, comment, epoch_us(ts) AS start_us, fault,
    CASE WHEN fault <> {UNTIMED} THEN CAST(epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS BIGINT) END AS end_us
  FROM f WHERE fault NOT IN ({DOCTYPE}, {TORN}, {MISNAMED}, {INCLUDE}, {NOT_XML}))"""


@query(
    "report_refusals",
    f"""WITH {BLOCK_ROWS_SQL}
    SELECT DISTINCT CASE WHEN fault IN ({DOCTYPE}, {INCLUDE}, {NOT_XML}) THEN 'unsafe_input' ELSE 'malformed_input' END AS reason,
      CASE WHEN fault = {MISNAMED} THEN 'copy of ' || user_id || ' ' || CAST(d AS VARCHAR) || '.xml'
        WHEN fault = {NOT_XML} THEN named || '.txt' ELSE named || '.xml' END AS source
    FROM f WHERE fault IN ({DOCTYPE}, {TORN}, {MISNAMED}, {INCLUDE}, {NOT_XML})""",
)
def report_refusals(spark, folder) -> DataFrame:
    """Reports that are unsafe, torn or wrongly named; quoted markup is no reason."""
    return reports.refused(reports.judge(report_texts(spark, folder))).select("reason", "source")


@query(
    "report_blocks",
    f"""WITH {BLOCK_ROWS_SQL}
    SELECT source_document, report_date, wellbore, well, report_index, block_index, code AS activity_code, state, comment, start_us, end_us
    FROM blocks""",
)
def report_blocks(spark, folder) -> DataFrame:
    """Activity blocks of the usable reports, in the order of the file."""
    blocks = reports.blocks(reports.usable(reports.judge(report_texts(spark, folder))))
    return blocks.select(
        "source_document", day("report_date"), "wellbore", "well", "report_index", "block_index", "activity_code", "state", "comment",
        F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"),
    )


@query(
    "report_lost_time",
    f"""WITH {BLOCK_ROWS_SQL}
    SELECT source_document, count(*) AS events, round(sum(CAST(end_us - start_us AS DOUBLE)) / 3.6e9, 4) AS hours
    FROM blocks WHERE end_us IS NOT NULL AND (code LIKE 'interruption%' OR state = 'fail') GROUP BY source_document""",
)
def report_lost_time(spark, folder) -> DataFrame:
    """Lost time read from report text."""
    blocks = reports.blocks(reports.usable(reports.judge(report_texts(spark, folder))))
    lost = oe.extract(blocks, strict=False)
    return lost.groupBy("source_document").agg(F.count(F.lit(1)).alias("events"), rounded(F.sum("duration_hours"), "hours"))


@query(
    "report_untimed",
    f"""WITH {BLOCK_ROWS_SQL}
    SELECT source_document, report_index, block_index, 'when done' AS end_raw FROM blocks
    WHERE end_us IS NULL AND (code LIKE 'interruption%' OR state = 'fail')""",
)
def report_untimed(spark, folder) -> DataFrame:
    """Lost-time blocks whose times cannot be read; a strict extraction fails on them."""
    blocks = reports.blocks(reports.usable(reports.judge(report_texts(spark, folder))))
    return oe.untimed(blocks).select("source_document", "report_index", "block_index", "end_raw")


@query(
    "report_activity_dates",
    f"""WITH {BLOCK_ROWS_SQL}
    SELECT DISTINCT '15/9-F-' || user_id AS well, CAST(d AS VARCHAR) AS activity_date FROM f WHERE fault NOT IN ({MISNAMED}, {NOT_XML})""",
)
def report_activity_dates(spark, folder) -> DataFrame:
    """Dates with a report, by its name alone; refused contents do not matter."""
    named = report_texts(spark, folder).select("file_name").where(~F.contains("file_name", F.lit(" ")))
    return reports.activity_dates(named).select("well", day("activity_date"))


@query(
    "daily_source_rows",
    """SELECT '15/9-F-' || l_suppkey AS well, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS production_date,
      CASE WHEN l_orderkey % 211 = 0 THEN 'injecting' WHEN l_orderkey % 5 <> 0 THEN 'producing' END AS well_status, round(l_quantity, 4) AS oil_volume_sm3,
      CASE WHEN l_partkey % 3 <> 0 THEN round(l_extendedprice, 4) END AS gas_volume_sm3, round(l_discount * 100, 4) AS choke_size, '%' AS choke_unit,
      l_orderkey || '-' || l_linenumber AS source
    FROM lineitem WHERE l_orderkey % 101 <> 0""",
)
def daily_source_rows(spark, folder) -> DataFrame:
    """Rows under the source's own column names, mapped; rows that are null throughout are skipped."""
    c = F.col
    there = c("l_orderkey") % 101 != 0
    made = {n: F.lit(None).cast("double") for n in daily.NUMBERS} | {
        "DATEPRD": c("l_shipdate").cast("date"),
        "NPD_WELL_BORE_NAME": F.concat(F.lit(" 15/9-F-"), "l_suppkey", F.lit(" ")),
        "AVG_CHOKE_UOM": F.lit(" %"),
        "FLOW_KIND": F.when(c("l_orderkey") % 211 == 0, " injection ").when(c("l_orderkey") % 5 != 0, "production"),
        "BORE_OIL_VOL": c("l_quantity"),
        "BORE_GAS_VOL": F.when(c("l_partkey") % 3 != 0, c("l_extendedprice")),
        "AVG_CHOKE_SIZE_P": c("l_discount") * 100,
    }
    raw = table(spark, folder, "lineitem").select(
        *[F.when(there, v).alias(n) for n, v in made.items()], F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line")
    )
    rows = daily.from_source_columns(raw, c("line"))
    return rows.select(
        "well", day("production_date"), "well_status", rounded("oil_volume_sm3"), rounded("gas_volume_sm3"), rounded("choke_size"), "choke_unit", "source"
    )


def _written(df: DataFrame, kind: str) -> str:
    """The folder of a table written to the shared folder as the given kind of file."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.format(kind).save(path)
    return path


@query(
    "label_lines",
    """SELECT 'evt_' || doc_id AS event_id, CASE WHEN toxic = 1 THEN 'equipment_failure' ELSE 'operational_wait' END AS cause,
      'pass_' || quality AS labeller_pass, 'expert' AS label_source, CASE WHEN quality = 1 THEN 'span "' || doc_id || '"' END AS evidence_span
    FROM labels""",
)
def label_lines(spark, folder) -> DataFrame:
    """Label files as JSON lines, written and read back."""
    c = F.col
    made = table(spark, folder, "labels").select(
        F.concat(F.lit("evt_"), "doc_id").alias("event_id"),
        F.when(c("toxic") == 1, "equipment_failure").otherwise("operational_wait").alias("cause"),
        F.concat(F.lit("pass_"), "quality").alias("labeller_pass"),
        F.lit("expert").alias("label_source"),
        F.when(c("quality") == 1, F.concat(F.lit('span "'), "doc_id", F.lit('"'))).alias("evidence_span"),
    )
    read = labels.read_labels(spark, _written(made, "json"))
    return read.select("event_id", "cause", "labeller_pass", "label_source", "evidence_span")


@query(
    "manifest_check",
    """SELECT 'p' || page_id AS path, CASE WHEN page_id % 11 = 0 THEN 'UNRECORDED' WHEN page_id % 11 = 1 THEN 'MISSING' WHEN page_id % 11 = 2 THEN 'SIZE'
      WHEN page_id % 11 = 3 THEN 'CHECKSUM' ELSE 'ok' END AS status FROM pages""",
)
def manifest_check(spark, folder) -> DataFrame:
    """Sizes and checksums against a manifest with planted faults; each page stands for a file."""
    pages = table(spark, folder, "pages")
    kind, body = F.col("page_id") % 11, F.coalesce("html", F.lit(""))
    path, size = F.concat(F.lit("p"), "page_id").alias("path"), F.octet_length(body).cast("bigint")
    found = pages.where(kind != 1).select(path, size.alias("size"), F.sha2(body, 256).alias("sha256"))
    told = F.upper(F.sha2(F.when(kind == 3, F.concat(body, F.lit("!"))).otherwise(body), 256))
    recorded = pages.where(kind != 0).select(path, (size + (kind == 2).cast("int")).alias("size"), told.alias("sha256"))
    return files.verify(found, recorded)


@query(
    "store_version",
    f"""SELECT n AS event_count, content_hash AS recorded_hash, content_hash, true AS verified, left(content_hash, 16) AS digest, 'v1,v2' AS versions
    FROM (SELECT count(*) AS n, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {LANES_SQL})) AS content_hash
      FROM (SELECT sha256('=' || conv_id || '|=' || role || '|=' || text || '|=' || turn) AS h FROM conversations WHERE role <> 'system'))""",
)
def store_version(spark, folder) -> DataFrame:
    """A version written once to a store of two, verified against its manifest, and its digest."""
    kept = store.VersionedStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    talk = table(spark, folder, "conversations")
    kept.write(talk, "v1")
    kept.write(talk.where("role <> 'system'"), "v2")
    one = kept.verify("v2").select("event_count", "recorded_hash", "content_hash", "verified")
    return one.withColumns({"digest": kept.digest("v2").scalar(), "versions": F.lit(",".join(kept.versions()))})


@query(
    "exported_series",
    "SELECT source AS well, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source",
)
def exported_series(spark, folder) -> DataFrame:
    """A table exported one folder per key, read back."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    store.export(table(spark, folder, "documents").select(F.col("source").alias("well"), "n_chars"), path)
    return spark.read.parquet(path).groupBy("well").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("total"))
