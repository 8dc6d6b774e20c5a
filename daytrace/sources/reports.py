"""Activity-report XML: refusals, names, activity blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace import fixed, schemas
from daytrace.functions import names

XINCLUDE = "http://www.w3.org/2001/XInclude"


def _markup(text: Column) -> Column:
    """The document without comments and literal sections, where markup is only quoted."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")


def unsafe_markup(text: Column) -> Column:
    body = _markup(text)
    prefix = F.regexp_extract(body, rf"""xmlns:([\w.-]+)\s*=\s*["']{XINCLUDE}["']""", 1)
    default = body.rlike(rf"""xmlns\s*=\s*["']{XINCLUDE}["']""")
    return (
        body.rlike(r"<!DOCTYPE|<!ENTITY")
        | default
        | ((prefix != "") & F.contains(body, F.concat(F.lit("<"), prefix, F.lit(":"))))
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with name and size; contents are not read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")


def scan(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """One row per file: file_name, length, parsed document, and `problem` (null when usable).

    Files are judged on their content. With `max_bytes`, a file over it is refused on its size alone;
    the size filter reaches the file reader, so its contents are never loaded.
    """
    files = spark.read.format("binaryFile").load(folder)
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    judged = judge(files.where(fits).select(name, "length", F.decode("content", "UTF-8").alias("text")))
    oversize = files.where(~fits).select(
        name, "length", F.lit("unsafe_input").alias("problem")
    )
    return judged.unionByName(oversize, allowMissingColumns=True)


def judge(texts: DataFrame) -> DataFrame:
    """Rows (file_name, length, text) as `scan` gives them: parsed, or with the problem they have."""
    is_xml = F.lower("file_name").endswith(".xml")
    parsed = f"{schemas.REPORT}, _broken string"
    bodies = texts.withColumn("_unsafe", unsafe_markup(F.col("text"))).withColumn(
        "report",
        F.when(
            is_xml & ~F.col("_unsafe"),
            F.from_xml("text", parsed, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE", "ignoreNamespace": "true"}),
        ),
    )
    broken = F.col("report").isNull() | F.col("report._broken").isNotNull()
    unnamed = names.report_date(F.col("file_name")).isNull() | (
        names.name_from_token(names.report_token(F.col("file_name"))).isNull()
    )
    return bodies.withColumn(
        "problem",
        F.when(~is_xml | F.col("_unsafe"), "unsafe_input").when(broken | unnamed, "malformed_input"),
    ).drop("text", "_unsafe")


def refused(scanned: DataFrame) -> DataFrame:
    """Quarantine rows of the files not used."""
    return scanned.where(F.col("problem").isNotNull()).select(
        F.col("problem").alias("reason"),
        F.col("file_name").alias("source"),
        "length",
        F.lit(fixed.PARSER_VERSION).alias("parser_version"),
    )


def usable(scanned: DataFrame) -> DataFrame:
    bore = names.name_from_token(names.report_token(F.col("file_name")))
    return scanned.where(F.col("problem").isNull()).select(
        F.col("file_name").alias("source_document"),
        names.report_date(F.col("file_name")).alias("report_date"),
        bore.alias("wellbore"),
        F.coalesce(names.well_of(bore), F.substring_index(bore, " ", 1)).alias("well"),
        "report",
    )


def blocks(reports: DataFrame) -> DataFrame:
    """Every activity block with its 0-based index inside its own drillReport."""
    per_report = reports.select(
        "source_document",
        "report_date",
        "wellbore",
        "well",
        F.posexplode("report.drillReport").alias("report_index", "_r"),
    )
    rows = per_report.select(
        "source_document", "report_date", "wellbore", "well", "report_index",
        F.posexplode("_r.activity").alias("block_index", "a"),
    )

    def text(tag: str) -> Column:
        return F.coalesce(F.trim(F.col(f"a.{tag}")), F.lit(""))

    return rows.select(
        "source_document",
        "report_date",
        "wellbore",
        "well",
        "report_index",
        "block_index",
        text("proprietaryCode").alias("activity_code"),
        text("state").alias("state"),
        text("stateDetailActivity").alias("state_detail"),
        text("comments").alias("comment"),
        text("dTimStart").alias("start_raw"),
        text("dTimEnd").alias("end_raw"),
        F.try_to_timestamp(text("dTimStart")).alias("start_time"),
        F.try_to_timestamp(text("dTimEnd")).alias("end_time"),
    )


def activity_dates(files: DataFrame) -> DataFrame:
    """Report dates per well, from file names only."""
    xml = files.where(F.col("file_name").endswith(".xml"))
    name = F.col("file_name")
    bore = names.name_from_token(names.report_token(name))
    day = names.report_date(name)
    known = F.when(
        bore.isNull() | day.isNull(),
        F.raise_error(F.concat(F.lit("unrecognised report file name: "), name)).cast("string"),
    ).otherwise(F.coalesce(names.well_of(bore), F.substring_index(bore, " ", 1)))
    return xml.select(known.alias("well"), day.alias("activity_date")).distinct()
