"""Manifest check of a file tree: size and SHA-256."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files up to this size are one row each; greater ones are read as lines.
WHOLE_BYTES = 32 << 20
#: Suffixes that the line reader would unpack.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"
#: Hadoop's codec that hands a packed file on as it is, and its option as Hadoop and its shaded client name it.
AS_IT_IS = "org.apache.hadoop.io.compress.PassthroughCodec"
ITS_SUFFIX = ("io.compress.passthrough.extension", "org.apache.hadoop.shaded.io.compress.passthrough.extension")
#: The line reader leaves this out at the start of a file.
MARK = b"\xef\xbb\xbf"


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Relative path, size and SHA-256 of every file, hashed in parallel where it lies.

    A file of up to `WHOLE_BYTES` is one row. A greater one is read in splits as lines and put together
    again in order: one task hashes it and holds a batch of it at a time, or its longest stretch without
    a line feed. Names starting with a dot are left out, and empty files, which Spark's readers do not list.
    """

    def read(kind: str, **options: str) -> DataFrame:
        return spark.read.format(kind).options(recursiveFileLookup=True, pathGlobFilter=pattern, **options).load(folder)

    files = read("binaryFile")
    found = files.where(F.col("length") <= WHOLE_BYTES).select(
        "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")
    )
    great = files.where(F.col("length") > WHOLE_BYTES)
    for (suffix,) in great.select(F.regexp_extract("path", PACKED, 0)).distinct().collect():
        # Such a file is one split, handed on as it is.
        as_it_is = {"io.compression.codecs": AS_IT_IS, **dict.fromkeys(ITS_SUFFIX, suffix)}
        text = read("text", lineSep="\n", **(as_it_is if suffix else {}))
        name = F.col("_metadata.file_name")
        mine = text.where((F.col("_metadata.file_size") > WHOLE_BYTES) & (F.regexp_extract(name, PACKED, 0) == suffix))
        found = found.unionAll(_streamed(mine))
    root = folder.rstrip("/").split("://")[-1].split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", rf"^.*?\Q{root}\E/", "")
    return found.withColumn("path", relative).where(~F.col("path").rlike(r"(^|/)\."))


def _streamed(text: DataFrame) -> DataFrame:
    """Path, size and SHA-256 of files read as lines."""
    place = {"path": "file_path", "size": "file_size", "start": "file_block_start"}
    lines = text.select(*[F.col(f"_metadata.{c}").alias(n) for n, c in place.items()], F.col("value").cast("binary").alias("line"))
    blocks = lines.mapInArrow(_blocks, BLOCK_TYPE)
    ordered = blocks.repartition("path").sortWithinPartitions("path", "start", "nth")
    hashed = ordered.mapInArrow(_hashed, "path string, size long, sha256 string")
    # These paths are URIs, those of `binaryFile` are not.
    return hashed.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))


#: A run of lines of a split without its last line feed. One more row of each split, with `start` -1 and no
#: content, has in `nth` the bytes of all its lines, so that a file's bytes are known before its first block.
BLOCK_TYPE = "path string, size long, start long, nth long, content binary"
_BLOCK = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("nth", pa.int64()), ("content", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, int, int], list[int]] = {}

    def row(path: str, size: int, start: int, nth: int, content: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([pa.array([v], t) for v, t in zip((path, size, start, nth), _BLOCK.types[:4], strict=True)] + [content], schema=_BLOCK)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        files = batch.column("path").dictionary_encode().indices.to_numpy()
        starts = batch.column("start").to_numpy()
        cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            split = tuple(batch.column(c)[low].as_py() for c in ("path", "size", "start"))
            lines = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), batch.column("line").slice(low, high - low))
            content = pc.binary_join(lines, pa.scalar(b"\n", pa.binary()))
            count = counts.setdefault(split, [0, 0])
            yield row(*split, count[0], content)
            count[0] += 1
            count[1] += pc.binary_length(content)[0].as_py() + 1
    for (path, size, _), (_, taken) in counts.items():
        yield row(path, size, -1, taken, pa.array([None], pa.binary()))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, size, taken, digest = None, 0, 0, None

    def ended() -> pa.RecordBatch:
        """The file so far; where it ends in a line feed, all its lines were followed by one."""
        if size - taken in (0, len(MARK)):
            digest.update(b"\n")
        return pa.record_batch([pa.array([path]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()])], names=["path", "size", "sha256"])

    for batch in batches:
        heads = [batch.column(c).to_pylist() for c in ("path", "size", "start", "nth")]
        for place, (name, length, start, nth) in enumerate(zip(*heads, strict=True)):
            if name != path:
                if path is not None:
                    yield ended()
                path, size, taken, digest = name, length, 0, None
            if start < 0:
                taken += nth
                continue
            if digest is None:
                missing = size - taken
                if missing not in (0, -1, len(MARK), len(MARK) - 1):
                    raise ValueError(f"{path}: its lines take {taken} bytes, the file {size}")
                digest = hashlib.sha256(MARK if missing > 0 else b"")
            else:
                digest.update(b"\n")
            digest.update(batch.column("content")[place].as_buffer())
    if path is not None:
        yield ended()


def verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status per path: ok, MISSING, SIZE, CHECKSUM or UNRECORDED."""
    f, m = found.alias("f"), manifest.alias("m")
    status = (
        F.when(F.col("m.size").isNull(), "UNRECORDED")
        .when(F.col("f.size").isNull(), "MISSING")
        .when(F.col("f.size") != F.col("m.size"), "SIZE")
        .when(F.col("f.sha256") != F.lower("m.sha256"), "CHECKSUM")
        .otherwise("ok")
    )
    return f.join(m, "path", "full").select("path", status.alias("status"))
