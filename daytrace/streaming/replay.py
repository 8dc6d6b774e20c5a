"""Classify day rows from a folder as files arrive (historical replay)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from daytrace import schemas
from daytrace.operators import days as od


def replay_days(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Classify every file of `source` once, in batches, appending to `target`.

    Day classes depend on one row only, so there is no state and nothing arrives late. Duplicates
    are collapsed by the batch job that reads `target`.
    """
    rows = spark.readStream.schema(schemas.DAY).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        od.classify(rows)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
