import xxhash
from pyspark.sql import functions as F

from daytrace.llm import sharding

M = (1 << 64) - 1


def weight(key, shard, seed=42):
    h = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest() if key is not None else 42
    for v in (shard, seed):
        h = xxhash.xxh64(v.to_bytes(4, "little", signed=True), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def expected(key, shards):
    return max(range(shards), key=lambda s: (weight(key, s), s))


def table(spark, rows, schema="doc_id bigint, text string, shard string, slot int"):
    return spark.createDataFrame(rows, schema)


def test_shards_slots_and_growth(spark):
    docs = table(spark, [(i, "é" * (i % 7) if i % 5 else None, "mine", -1) for i in range(600)])
    rows = sharding.shuffle_records(docs, 8, bucket_bytes=700).collect()
    assert len(rows) == 600 and {r.doc_id for r in rows} == set(range(600))
    for r in rows:
        assert (r.shard, r.grown_shard) == (expected(r.doc_id, 8), expected(r.doc_id, 9)) and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted((r.slot, r.doc_id) for r in rows if r.shard == s)
        assert [x for x, _ in slots] == list(range(len(slots)))
        assert [k for _, k in slots] != sorted(k for _, k in slots)
    assert sum(r.grown_shard == 8 for r in rows) > 30


def test_order_of_arrival_does_not_matter(spark):
    docs = table(spark, [(i, f"text {i}", None, None) for i in range(300)])
    place = lambda df: {(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_records(df, 4, bucket_bytes=900).collect()}
    assert place(docs) == place(docs.repartition(7).orderBy(F.desc("doc_id")))


def test_nulls_repeated_rows_long_texts_and_no_rows(spark):
    docs = table(spark, [(None, None, None, None)] * 3 + [(1, "x", "a", 1)] * 40 + [(2, "y" * 200_000, "b", 2), (3, "", None, None)])
    rows = sharding.shuffle_records(docs, 4, bucket_bytes=64).collect()
    assert len(rows) == 45 and sum(r.doc_id is None for r in rows) == 3
    for s in range(4):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1 and next(len(r.text) for r in rows if r.doc_id == 2) == 200_000
    assert sharding.shuffle_records(table(spark, []), 4).count() == 0


def test_written_shards_read_back(spark, tmp_path):
    docs = table(spark, [(i, f"text {i}", None, None) for i in range(50)])
    sharding.write_shards(sharding.shuffle_records(docs, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
