"""Operator 4: two-pass external shuffle into shards.

Pass one scatters every record by seeded hashes: the shard by rendezvous hashing of the key (the
shard whose seeded hash of the key is largest, so one more shard only takes rows into itself), and
inside the shard one of enough buckets that a bucket fits in a task's memory. Pass two sorts a
bucket by a seeded hash of the whole record, which makes its order independent of how rows arrived,
and Fisher-Yates shuffles it (Spark's `shuffle`, with a seed).

A shard may be of any size: only buckets are held whole, and their number grows with the bytes.
Records that are equal in all columns share a bucket; their order is the same either way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import small

LAW = "key"
ADDED = ("law", "shard", "slot", "grown_shard")
#: Text bytes of a bucket; a task holds a bucket about three times over.
BUCKET_BYTES = 16 << 20
#: What a record counts besides the bytes of its text.
RECORD_BYTES = 16


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("bigint")


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard 0 to `shards` - 1 with the largest (hash of key, shard and seed, shard)."""
    ranked = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(key, s, F.lit(seed)).alias("weight"), s.alias("shard")),
    )
    return F.array_max(ranked)


def shuffle_records(
    df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 42, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All records with law, shard, slot (gapless from 0 in a shard) and grown_shard.

    Input columns of those names are replaced. A null key hashes as a value of its own, a null text
    counts no bytes, rows with one key go to one shard, an empty table gives no rows. One job sums
    the bytes before the plan is made; the buckets of all shards are counted in a second one.
    """
    columns = [c for c in df.columns if c not in ADDED]
    total = df.agg(F.sum(text_bytes(F.col(text))).alias("b")).first()["b"] or 0
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    best = rendezvous(F.col(key), shards, seed)
    placed = df.select(
        F.struct(*columns).alias("record"),
        best.alias("best"),
        F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]).alias("order"),
    ).select(
        "record",
        F.col("best.shard").alias("shard"),
        F.when(F.xxhash64(F.col(f"record.{key}"), F.lit(shards), F.lit(seed)) >= F.col("best.weight"), F.lit(shards))
        .otherwise(F.col("best.shard"))
        .alias("grown_shard"),
        F.pmod("order", F.lit(buckets)).cast("int").alias("bucket"),
        "order",
    )
    ends = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    held = (
        placed.repartition(shards * buckets, "shard", "bucket")
        .sortWithinPartitions("shard", "bucket", "order")
        .groupBy("shard", "bucket")
        .agg(F.collect_list(F.struct("record", "grown_shard")).alias("rows"))
    )
    mixed = held.select("shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "row"))
    met = mixed.join(small(offsets), (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return met.select(
        "row.record.*",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("offset") + F.col("place")).cast("bigint").alias("slot"),
        F.col("row.grown_shard").alias("grown_shard"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Parquet folders shard=0, shard=1 and so on, each bucket's records in slot order."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
