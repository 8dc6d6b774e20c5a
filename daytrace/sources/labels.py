"""Label files as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace import schemas

REQUIRED = ("event_id", "cause", "labeller_pass", "label_source")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows; a line that is not JSON fails the job, as does one missing a required field."""
    df = spark.read.schema(schemas.LABEL).option("mode", "FAILFAST").json(path)
    absent = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    checked = F.when(
        absent != "", F.raise_error(F.concat(F.lit("a label is missing "), absent)).cast("string")
    ).otherwise(F.col("event_id"))
    return df.withColumn("event_id", checked)
