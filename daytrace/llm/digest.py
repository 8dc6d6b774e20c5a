"""Operator 6: quartile bucket digest of a document.

Every three bytes in a row of the UTF-8 text are hashed into one of 256 buckets. The digest holds,
per bucket, the quartile of its count among all buckets (0 to 3, two bits), and the length on a
logarithmic scale: 130 hex digits. Two digests differ by a score between 0 and 1 that weighs
the quartile codes as a multiset (what both have over what either has) and the difference of lengths.

Digests are computed inside the rows. The next document, which the edited texts need, is the next row
of a bucket of doc_id ranges: one shuffle of the texts, with the first row of the next range copied
into each, so no window spans more than a range.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

BUCKETS = 256
#: Each step of the length code is a growth by this factor.
LENGTH_STEP = 1.1
#: Share of the score that the length difference can take, and the steps at which it is full.
LENGTH_SHARE, LENGTH_FULL = 0.1, 32
#: Bytes hashed at a time, so that a very long text takes no more memory than this needs.
PIECE = 1 << 20
#: Text bytes of a range of keys, and the most ranges; beyond that ranges grow and their window spills.
RANGE_BYTES, MOST_RANGES = 2 << 20, 4096


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for k in range(0, max(len(data) - 2, 0), PIECE):
        b = np.frombuffer(data[k : k + PIECE + 2], dtype=np.uint8).astype(np.uint32)
        triplet = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        counts += np.bincount((triplet * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    """130 hex digits: the length code, then 256 two-bit quartile codes. Null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    cuts = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > cuts[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | (codes[:, 1] << 2) | (codes[:, 2] << 4) | (codes[:, 3] << 6)
    length = min(255, round(math.log(len(data) + 1, LENGTH_STEP)))
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def _unpacked(digests: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), dtype=np.uint8).reshape(len(digests), 1 + BUCKETS // 4)
    codes = np.stack([(raw[:, 1:] >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(digests), BUCKETS)
    return raw[:, 0].astype(np.int64), codes


def difference(left: pd.Series, right: pd.Series) -> pd.Series:
    """Score from 0 (alike) to 1 for pairs of digests."""
    if not len(left):
        return pd.Series([], dtype="float64")
    (n, a), (m, b) = _unpacked(left), _unpacked(right)
    either = np.maximum(a, b).sum(axis=1, dtype=np.int64)
    both = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    content = np.where(either > 0, 1 - both / np.maximum(either, 1), 0.0)
    length = np.minimum(np.abs(n - m), LENGTH_FULL) / LENGTH_FULL
    return pd.Series((1 - LENGTH_SHARE) * content + LENGTH_SHARE * length)


@pandas_udf(T.StringType())
def digest_of(texts: pd.Series) -> pd.Series:
    return texts.map(digest, na_action=None)


@pandas_udf(T.DoubleType())
def likeness(left: pd.Series, right: pd.Series) -> pd.Series:
    """1 for equal digests down to 0."""
    return 1.0 - difference(left, right)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of every whole text."""
    return docs.select(F.col(key), digest_of(F.col(text)).alias("fingerprint"))


def range_of(key: Column, kind: str, cuts: list) -> Column:
    """How many of the sorted `cuts` are at or below the key, found in two steps; 0 for null."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    firsts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), f"array<{kind}>")
    fine = F.from_json(F.lit(json.dumps(groups)), f"array<array<{kind}>>")
    below = lambda a: F.size(F.filter(a, lambda c: c <= key))
    coarse = below(firsts)
    inside = F.when(coarse > 0, (coarse - 1) * width + below(F.get(fine, coarse - 1))).otherwise(F.lit(0))
    return F.when(key.isNull(), F.lit(0)).otherwise(inside).cast("int")


def with_follower(rows: DataFrame, key: str, text: str, ranges: int | None = None) -> DataFrame:
    """All rows with _range, _copy, and per range a copy (_copy 1) of the row that follows its last.

    Rows are dealt to ranges of the numeric key, cut at approximate quantiles. The cuts and the first
    key of each range are collected (at most MOST_RANGES values), so they are the same wherever they
    are used. Equal keys follow each other by a hash of the text. After the last row comes the first.
    """
    about = rows.agg(
        F.sum(F.octet_length(text)).alias("b"),
        F.percentile_approx(key, [k / MOST_RANGES for k in range(1, MOST_RANGES)], 40_000).alias("p"),
    ).first()
    ranges = ranges or min(MOST_RANGES, 1 + (about["b"] or 0) // RANGE_BYTES)
    points = about["p"] or []
    cuts = sorted({points[k * len(points) // ranges] for k in range(1, ranges)}) if points else []
    dealt = rows.withColumn("_range", range_of(F.col(key), rows.schema[key].dataType.simpleString(), cuts)).withColumn("_hash", F.xxhash64(text))
    least = dealt.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("set"), F.col(key).alias("k"), F.col("_hash").alias("h"))).alias("first"))
    found = sorted(least.collect(), key=lambda r: r["_range"])
    firsts = rows.sparkSession.createDataFrame(
        [(r["first"]["k"], r["first"]["h"], r["_range"], found[i - 1]["_range"]) for i, r in enumerate(found)],
        f"_k {rows.schema[key].dataType.simpleString()}, _h bigint, _g int, _before int",
    )
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")) & (F.col("_range") == F.col("_g"))
    heads = dealt.join(F.broadcast(firsts), same).dropDuplicates(["_g"])
    copies = heads.select(*rows.columns, F.col("_before").alias("_range"), "_hash", F.lit(1).alias("_copy"))
    return dealt.withColumn("_copy", F.lit(0)).unionByName(copies)


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row: key, n_chars, edited text, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    next document. Null counts as empty; a table of one row is its own next; null keys come first.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = with_follower(docs.select(F.col(key).alias("_key"), whole.alias("_text")), "_key", "_text", ranges)
    window = Window.partitionBy("_range").orderBy("_copy", F.col("_key").asc_nulls_first(), "_hash")
    printed = rows.withColumn("_print", digest_of(F.col("_text")))
    # Two plain columns: a struct of them would go through the shuffle beside them.
    led = printed.withColumns({"_next_text": F.lead("_text").over(window), "_next": F.lead("_print").over(window)}).where("_copy = 0")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next_text"), F.lit(1), half))
    made = led.select("_key", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "_print", "_next")
    digested = made.withColumn("edited_fingerprint", digest_of(F.col("edited")))
    return digested.select(
        F.col("_key").alias(key),
        "n_chars",
        "edited",
        F.col("_print").alias("fingerprint"),
        "edited_fingerprint",
        likeness("_print", "edited_fingerprint").alias("near_edited"),
        likeness("_print", "_next").alias("near_next"),
    )
