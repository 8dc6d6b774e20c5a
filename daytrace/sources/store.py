"""Versioned tables, content digests, append-only logs, exports."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daytrace import fixed

PLAIN_NAME = re.compile(r"[A-Za-z0-9._-]+")
LANES = 8


class StoreError(ValueError):
    """A version that is missing, taken, wrongly named, or not what its manifest says."""


def row_text(columns: Sequence[str]) -> Column:
    """A row as text: columns by name, each value marked so that null and '' differ.

    Scalars only; cast arrays and maps to text before.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(columns)]
    return F.concat_ws("|", *parts)


def content_digest(df: DataFrame, text: Column | None = None) -> DataFrame:
    """One row: count and order-independent digest of the rows.

    Each row's SHA-256 is cut into eight 32-bit lanes and the lanes are summed, so the state is
    eight numbers however large the table is, nothing is sorted or gathered, and every copy of a
    repeated row counts.
    """
    hashed = df.select(F.sha2(text if text is not None else row_text(df.columns), 256).alias("h"))
    lanes = [
        F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)").alias(f"l{i}")
        for i in range(LANES)
    ]
    total = hashed.select(*lanes).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(f"l{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"l{i}") for i in range(LANES)],
    )
    joined = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(LANES)])
    return total.select("rows", F.sha2(joined, 256).alias("content_hash"))


def digestible(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, so that `row_text` can take them."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


class VersionedStore:
    """Write-once versions of an event table under one folder, each with a manifest row."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, version: str) -> str:
        if not PLAIN_NAME.fullmatch(version):
            raise StoreError(f"version {version!r} is not a plain name")
        return f"{self.root}/{version}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def versions(self) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/*/manifest")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(s.getPath().getParent().getName() for s in found or [])

    def write(self, events: DataFrame, version: str, *, source_directory: str = "", source_files: int = 0) -> None:
        folder = self._folder(version)
        if self._exists(folder):
            raise StoreError(f"version {version!r} already exists")
        events.write.mode("errorifexists").parquet(f"{folder}/events")
        # Read back: the manifest then describes what was stored, whatever was recomputed meanwhile.
        self._manifest(self.read_unchecked(version)).select(
            F.lit(version).alias("version"),
            F.current_timestamp().alias("written_at"),
            F.lit(fixed.PARSER_VERSION).alias("parser_version"),
            F.lit(fixed.EXTRACTOR_VERSION).alias("extractor_version"),
            F.lit(source_directory).alias("source_directory"),
            F.lit(source_files).alias("source_file_count"),
            F.col("rows").alias("event_count"),
            "content_hash",
            F.lit(version.endswith("-attributed")).alias("is_attributed"),
        ).write.mode("errorifexists").json(f"{folder}/manifest")

    def _manifest(self, events: DataFrame) -> DataFrame:
        return content_digest(digestible(events))

    def read_unchecked(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(version)}/events")

    def manifest(self, version: str) -> DataFrame:
        folder = f"{self._folder(version)}/manifest"
        if not self._exists(folder):
            raise StoreError(f"no manifest for version {version!r}")
        return self.spark.read.json(folder)

    def read(self, version: str) -> DataFrame:
        self.manifest(version)
        return self.read_unchecked(version)

    def verify(self, version: str) -> DataFrame:
        """One row: recorded and found counts and digests, and whether they agree."""
        recorded = self.manifest(version).select("event_count", F.col("content_hash").alias("recorded_hash"))
        found = self._manifest(self.read(version))
        same = (F.col("event_count") == F.col("rows")) & (F.col("recorded_hash") == F.col("content_hash"))
        one = found.select(F.struct(*found.columns)).scalar()
        return recorded.withColumn("_found", one).select(*recorded.columns, "_found.*").withColumn("verified", same)

    def digest(self, version: str) -> DataFrame:
        """Digest of one version; a version that does not exist is an error, not an empty digest."""
        return self._manifest(self.read(version)).select(F.left("content_hash", F.lit(16)).alias("digest"))

    def wells(self, version: str) -> DataFrame:
        return self.read(version).select("well").distinct()


def append_rows(admitted: DataFrame, path: str) -> None:
    """Append validated rows to a log of JSON lines."""
    admitted.write.mode("append").json(path)


def export(df: DataFrame, path: str, *, by: str | None = "well") -> None:
    """Facts or series as Parquet, one folder per well; write once."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def manifest_json(row: DataFrame) -> str:
    """A one-row table as a JSON document (for run manifests; at most one row is read)."""
    first = row.limit(1).toJSON().take(1)
    return json.dumps(json.loads(first[0]) if first else {}, indent=2)
