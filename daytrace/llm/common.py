"""What the operators share: tables, the shared folder, and a join that no hot key can stop."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and are no more than this.
BROADCAST_ROWS = 500_000
#: Rows that a partition of a packed table holds at least, unless there would be fewer partitions than cores.
PACKED_ROWS = 5_000
#: A to Z and their small letters, the only letters that the contracts lower.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HELD: dict[str, dict] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only under a local master without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df` as files in the shared folder, which outlive any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def held(owner: str) -> dict:
    """What a Python worker remembers between the tasks of one operator; what it held for another one is dropped.

    Workers outlive the step that they were started for, so without this a worker holds the tables of all steps.
    """
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = {}
    return _HELD[owner]


def packed(df: DataFrame, rows: int = PACKED_ROWS) -> DataFrame:
    """`cut`, with neighbouring partitions of a small table read together.

    A shuffle writes its files per partition that it reads, and a block for each that it writes; of a small
    table in many partitions nearly all of that is overhead. Large tables keep their partitions.
    """
    held = cut(df)
    return held.coalesce(max(held.sparkSession.sparkContext.defaultParallelism, held.count() // rows))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count shows at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str | Column], how: str = "inner", salts: int = 32
) -> DataFrame:
    """Join on `on` where one key may hold a large share of the left rows.

    The right side has few rows a key and is copied `salts` times; a left row goes to the copy that
    the hash of `spread` names. Keys compare null-safe. Both sides meet in exchanges of their own,
    so adaptive execution can split what is still large.
    """
    names = [f"_on{i}" for i in range(len(on))]
    copies = right.select(
        *[F.col(c).alias(n) for c, n in zip(on, names, strict=True)],
        *[c for c in right.columns if c not in on],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_copy"),
    )
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    meet = F.col("_salt") == F.col("_copy")
    for c, n in zip(on, names, strict=True):
        meet = meet & F.col(c).eqNullSafe(F.col(n))
    return dealt.join(copies, meet, how).drop("_salt", "_copy", *names)


def ascii_lower(text: Column) -> Column:
    """A to Z lowered and nothing else; plain ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
