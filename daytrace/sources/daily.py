"""Daily production rows under a fixed column map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrace import fixed

NUMBERS = tuple(
    s for s, c in fixed.SOURCE_COLUMNS.items() if c not in ("production_date", "well", "choke_unit")
)
CSV_SCHEMA = "DATEPRD date, NPD_WELL_BORE_NAME string, AVG_CHOKE_UOM string, FLOW_KIND string, " + (
    ", ".join(f"{n} double" for n in NUMBERS)
)


class SourceSchemaError(ValueError):
    """The table does not have the columns or types the map names."""


def _refuse(bad: Column, message: str, value: Column) -> Column:
    """The value, or a failed job naming the problem where `bad` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def check_columns(df: DataFrame) -> None:
    wanted = [*fixed.SOURCE_COLUMNS, "FLOW_KIND"]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise SourceSchemaError(f"missing expected columns: {missing}")
    for name in NUMBERS:
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise SourceSchemaError(f"{name} is not a number column")
    if not isinstance(df.schema["DATEPRD"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise SourceSchemaError("DATEPRD is not a date column")


def from_source_columns(df: DataFrame, label: Column | str) -> DataFrame:
    """Canonical day rows. An unmapped flow kind, a blank well, a missing date or a non-finite
    number fails the job; rows that are null throughout are skipped."""
    check_columns(df)
    used = [*fixed.SOURCE_COLUMNS, "FLOW_KIND"]
    kind = F.trim("FLOW_KIND")
    statuses = F.create_map(*[F.lit(x) for p in fixed.FLOW_KIND_TO_STATUS.items() for x in p])
    status = F.try_element_at(statuses, kind)
    well = F.trim("NPD_WELL_BORE_NAME")

    def number(name: str) -> Column:
        v = F.col(name).cast("double")
        bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        return _refuse(F.coalesce(bad, F.lit(False)), f"{name} holds a non-finite number", v.cast("string")).cast("double")

    columns = {
        "well": _refuse(F.coalesce(well, F.lit("")) == "", "a row has no well name", well),
        "production_date": _refuse(
            F.col("DATEPRD").isNull(), "a row has no date", F.col("DATEPRD").cast("date").cast("string")
        ).cast("date"),
        "choke_unit": F.trim("AVG_CHOKE_UOM"),
        **{fixed.SOURCE_COLUMNS[n]: number(n) for n in NUMBERS},
        "well_status": _refuse(kind.isNotNull() & status.isNull(), "unmapped FLOW_KIND", status),
        "source": label if isinstance(label, Column) else F.lit(label),
        "parser_version": F.lit(fixed.PARSER_VERSION),
    }
    some = F.coalesce(*[F.col(c).cast("string") for c in used]).isNotNull()
    return df.where(some).select(*[c.alias(n) for n, c in columns.items()])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return from_source_columns(df.select("*", "_metadata.file_name"), F.col("file_name"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the same header; a value that is not of its column's type fails the job."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in (*fixed.SOURCE_COLUMNS, "FLOW_KIND") if c not in header]
    if missing:
        raise SourceSchemaError(f"missing expected columns: {missing}")
    types = dict(part.strip().split(" ") for part in CSV_SCHEMA.split(","))
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    df = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False).csv(path)
    return from_source_columns(df.select("*", "_metadata.file_name"), F.col("file_name"))
