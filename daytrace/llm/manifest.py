"""Operator 11: Merkle manifest of a dataset, its trees stored in van Emde Boas order.

A tree of L levels is cut at half its height: the lower L // 2 levels fall into aligned subtrees, the
upper levels are one tree, and both are cut again until a part has at most BAND levels. Parts of
equal height form a band; a part is a block, one row of the stored table. Inside a block the same
cut goes on down to single nodes. So a node's place in the whole tree is arithmetic on its depth and
index (`address`), every block is one contiguous run of places, and a path from a leaf to the
root reads one block a band, whatever the size of the page that holds it.

Construction goes up: the leaves of a bottom block are one group of at most 2 ** (BAND - 1) rows, and
block roots are the leaves of the next band. Retrieval goes down: each block's path to the root is made
from its parent block, then handed to the blocks below. No group grows with the data. Leaves are
ranked by range partitions and counts, never in one task. Bands and ranks are tables in the shared
folder, so a lost executor costs the tasks it ran.

Defined cases: a null field is `-`; rows without a tree value form a tree of their own (first in order); null keys
come first; equal keys follow each other by their leaf digests, so equal rows are leaves of their own;
an empty table has no root and gives no rows; columns other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daytrace.llm.common import new_folder

#: Most levels of a block: 2 ** (BAND - 1) leaves, one group of rows.
BAND = 12
#: A tree has fewer levels than this (leaves are counted in a long).
MOST_LEVELS = 64
#: Bytes of a stored node, and of a path entry: a side (0 none, 1 sibling left, 2 right) and a digest.
NODE, ENTRY = 32, 33


# Address arithmetic


def levels_of(leaves: int) -> int:
    return 1 + (leaves - 1).bit_length()


@cache
def bands(levels: int, most: int = BAND) -> tuple[int, ...]:
    """Heights of the bands from the leaves up."""
    if levels <= most:
        return (levels,)
    low = levels // 2
    return bands(low, most) + bands(levels - low, most)


def address(levels: int, depth: int, index: int) -> int:
    """Place of a node in the van Emde Boas order of a full tree; the root has depth 0 and place 0."""
    place = 0
    while levels > 1:
        low = levels // 2
        high = levels - low
        if depth < high:
            levels = high
        else:
            depth -= high
            place += (1 << high) - 1 + (index >> depth) * ((1 << low) - 1)
            index &= (1 << depth) - 1
            levels = low
    return place


@cache
def layout(levels: int) -> tuple[np.ndarray, ...]:
    """Per depth the places of all nodes of a full tree, by the same rule as `address`."""
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    low = levels // 2
    high = levels - low
    base = (1 << high) - 1 + np.arange(1 << high, dtype=np.int64) * ((1 << low) - 1)
    return layout(high) + tuple((base[:, None] + below[None, :]).ravel() for below in layout(low))


# Hashes


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _paired(nodes: list[str]) -> list[str]:
    whole = [h(a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=False)]
    return whole + [h(nodes[-1])] if len(nodes) % 2 else whole


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and a path lead to."""
    for k in range(0, len(path), ENTRY):
        sibling = path[k + 1 : k + ENTRY].hex()
        leaf = h(leaf) if path[k] == 0 else h(sibling, leaf) if path[k] == 1 else h(leaf, sibling)
    return leaf


def siblings(path: bytes) -> list[str]:
    return [path[k + 1 : k + ENTRY].hex() for k in range(0, len(path), ENTRY) if path[k]]


def record_digest(fields: Sequence[Column]) -> Column:
    """Digest of a record: each field is `-` if null, else its UTF-8 byte count, a colon and the value."""
    whole = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in whole]
    return F.sha2(F.concat(*parts), 256)


# Ranks


def ranked(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """`rows` with nth (from 0, by `order`, nulls first) and n (rows) within the value of `tree`.

    Rows go to ranges of (tree, order), are sorted there and written once with a running number;
    counts per tree and range then give each range its offset. A tree's ranges are ordered by one
    window whose size is the number of ranges.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    path = new_folder(rows.sparkSession, "ranked")
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sorted_.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.schema(T.StructType([*rows.schema, T.StructField("_at", T.LongType())])).parquet(path)
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    spans = placed.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_span")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    of_tree = Window.partitionBy("_tree")
    before = F.sum("_rows").over(of_tree.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("_tree", "_span", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(of_tree).alias("n"))
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_span"))
    return placed.join(spans, same).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("nth"), "n")


# Trees


@dataclass(frozen=True)
class Forest:
    """Stored trees, one per value of `tree`: blocks by band, from the leaves up, and the roots."""

    folders: tuple[str, ...]
    bands: tuple[DataFrame, ...]
    roots: DataFrame  # tree, n, digest


def _by_levels(n: Column, of) -> Column:
    """A number that depends on the levels of a tree of n leaves, from a table of MOST_LEVELS values."""
    levels = F.when(n <= 1, F.lit(1)).otherwise(1 + F.length(F.bin(n - 1)))
    return F.element_at(F.array(*[F.lit(of(k)) for k in range(1, MOST_LEVELS + 1)]), levels)


def _grouped(children: DataFrame, band: int) -> DataFrame:
    """Children (tree, n, child, ...) with the block of `band` that is built over them."""
    width = lambda k: 0 if len(bands(k)) <= band else bands(k)[band] - (band == 0)
    return children.withColumn("block", F.call_function("shiftright", F.col("child"), _by_levels(F.col("n"), width)))


def _block_levels(children: pd.DataFrame, band: int) -> tuple[list[list[str]], int]:
    """The nodes of a block, from its bottom level up, and the levels of the whole tree."""
    levels = levels_of(int(children["n"].iloc[0]))
    height = bands(levels)[band]
    at = children["child"].to_numpy()
    by = np.argsort(at, kind="stable")
    if (np.diff(at[by]) != 1).any():
        raise ValueError("the children of a block must be its leaves or block roots, each once")
    nodes = children["digest"].to_numpy()[by].tolist()
    rows = [nodes if band == 0 else _paired(nodes)]
    while len(rows) < height:
        rows.append(_paired(rows[-1]))
    return rows, levels


def _builder(band: int):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, levels = _block_levels(rows, band)
        height = len(nodes)
        held = np.zeros(((1 << height) - 1, NODE), dtype=np.uint8)
        for up, digests in enumerate(nodes):
            places = layout(height)[height - 1 - up][: len(digests)]
            held[places] = np.frombuffer(bytes.fromhex("".join(digests)), dtype=np.uint8).reshape(-1, NODE)
        depth = levels - sum(bands(levels)[: band + 1])
        base = address(levels, depth, int(key[1]))
        return pd.DataFrame({"tree": [key[0]], "n": [rows["n"].iloc[0]], "block": [key[1]], "base": [base], "height": [height], "nodes": [held.tobytes()], "digest": [nodes[-1][0]]})

    return build


def grow(leaves: DataFrame) -> Forest:
    """Build and store the trees over leaves (tree, nth, n, digest)."""
    spark = leaves.sparkSession
    kind = leaves.schema["tree"].dataType
    most = leaves.agg(F.max("n")).first()[0]
    count = max((len(bands(k)) for k in range(1, levels_of(most) + 1)), default=0) if most else 0
    schema = T.StructType([T.StructField("tree", kind), *T.StructType.fromDDL("n bigint, block bigint, base bigint, height int, nodes binary, digest string")])
    children = leaves.select("tree", "n", F.col("nth").alias("child"), "digest")
    folders, stored = [], []
    for band in range(max(count, 1)):
        folder = new_folder(spark, f"band{band}")
        _grouped(children, band).groupBy("tree", "block").applyInPandas(_builder(band), schema).write.parquet(folder)
        folders.append(folder)
        stored.append(spark.read.schema(schema).parquet(folder))
        on = stored[-1].where(_by_levels(F.col("n"), lambda k: len(bands(k))) > band + 1)
        children = on.select("tree", "n", F.col("block").alias("child"), "digest")
    tops = [_tops(b, k).select("tree", "n", "digest") for k, b in enumerate(stored)]
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return Forest(tuple(folders), tuple(stored), roots)


def _tops(blocks: DataFrame, band: int) -> DataFrame:
    return blocks.where(_by_levels(F.col("n"), lambda k: len(bands(k))) == band + 1)


def _paths_in(children: pd.DataFrame, block: pd.Series, band: int) -> list[bytes]:
    """Per child its path to the root of the whole: siblings by address inside the block, then the block's own path.

    A sibling is there if its index is below the number of nodes of its level.
    """
    n, height, first = int(block["n"]), int(block["height"]), int(block["block"])
    below = sum(bands(levels_of(n))[:band])  # levels under this block's bottom level
    held, places = block["nodes"], layout(height)
    beside = dict(zip(children["child"], children["digest"], strict=True)) if band else {}
    shared: dict[tuple[int, int], bytes] = {}

    def entry(index: int, total: int, digest: bytes | None) -> bytes:
        other = index ^ 1
        return bytes([0]) + bytes(NODE) if other >= total else bytes([1 if other < index else 2]) + digest

    def upward(up: int, local: int) -> bytes:
        """From the node `local` of the level `up` of this block; made once per node."""
        if up == height - 1:
            return block["above"]
        if (up, local) not in shared:
            total = -(-n // (1 << (below + up)))
            place = int(places[height - 1 - up][local ^ 1]) * NODE
            index = (first << (height - 1 - up)) + local
            shared[up, local] = entry(index, total, held[place : place + NODE]) + upward(up + 1, local >> 1)
        return shared[up, local]

    out = []
    bottom = (1 << (height - 1)) - 1
    for child in children["child"]:
        child = int(child)
        if band == 0:
            out.append(upward(0, child & bottom))
        else:
            total = -(-n // (1 << (below - 1)))
            digest = bytes.fromhex(beside[child ^ 1]) if child ^ 1 in beside else None
            out.append(entry(child, total, digest) + upward(0, (child >> 1) & bottom))
    return out


def _hander(band: int):
    def hand(key: tuple, rows: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        one = parent.iloc[0]
        return pd.DataFrame({"_t": [key[0]] * len(rows), "_b": rows["child"], "above": _paths_in(rows, one, band), "top": one["top"]})

    return hand


def bottom_blocks(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The lowest blocks with `above`, the path from the block's root to the root of the whole, and `top`.

    `above` (tree, above) goes on from each tree's own root; without it a tree ends there. `top` is
    the digest of the tree's own root.
    """
    start = forest.roots.select(F.col("tree").alias("_tree"), F.col("digest").alias("top"))
    if above is None:
        start = start.withColumn("above", F.lit(b""))
    else:
        start = start.join(above.select(F.col("tree").alias("_t"), "above"), F.col("_tree").eqNullSafe(F.col("_t"))).drop("_t")
    kind = forest.bands[0].schema["tree"].dataType
    schema = T.StructType([T.StructField("_t", kind), *T.StructType.fromDDL("_b bigint, above binary, top string")])
    handed = None
    for band in reversed(range(len(forest.bands))):
        blocks = forest.bands[band]
        here = _tops(blocks, band).join(start, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        if handed is not None:
            same = F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))
            here = here.unionByName(blocks.join(handed, same).drop("_t", "_b"))
        if band == 0:
            return here
        below = forest.bands[band - 1].where(_by_levels(F.col("n"), lambda k: len(bands(k))) > band)
        children = below.select("tree", "n", F.col("block").alias("child"), "digest")
        folder = new_folder(blocks.sparkSession, f"paths{band}")
        pairs = _grouped(children, band).groupBy("tree", "block").cogroup(here.groupBy("tree", "block"))
        pairs.applyInPandas(_hander(band), schema).write.parquet(folder)
        handed = blocks.sparkSession.read.schema(schema).parquet(folder)
    raise AssertionError


def leaf_paths(leaves: DataFrame, forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """Leaves (tree, nth, n, digest, key) as (key, path)."""

    def read(key: tuple, rows: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": rows["key"], "path": _paths_in(rows, parent.iloc[0], 0)})

    children = leaves.select("tree", "n", F.col("nth").alias("child"), "digest", F.col("key").cast("string"))
    pairs = _grouped(children, 0).groupBy("tree", "block").cogroup(bottom_blocks(forest, above).groupBy("tree", "block"))
    return pairs.applyInPandas(read, "key string, path binary")


@dataclass(frozen=True)
class Manifest:
    """Leaves with their ranks, the stored trees, the stored tree over their roots, and its root."""

    leaves: DataFrame
    trees: Forest
    crown: Forest
    crown_leaves: DataFrame
    root: str | None


def manifest(records: DataFrame, tree: str, key: str, digest: str, carried: Sequence[str] = ()) -> Manifest:
    """Trees over the digests of records, one per value of `tree`, by `key`; and one over their roots, by that value.

    Values of `tree` are compared as texts, byte by byte. `carried` columns stay beside the leaves, for `prove`.
    """
    named = records.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"), F.col(digest).alias("digest"), *carried)
    leaves = ranked(named, "tree", ["key", "digest", *carried])
    trees = grow(leaves)
    tops = trees.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("key"), "digest")
    crown_leaves = ranked(tops, "tree", ["key"])
    crown = grow(crown_leaves)
    root = crown.roots.first()
    return Manifest(leaves, trees, crown, crown_leaves, root["digest"] if root else None)


def prove(m: Manifest, claimed: str = "digest", paths: bool = False) -> DataFrame:
    """Per leaf: key, leaf, subroot, root, proof_sha256, folded_root, verified, and with `paths` its siblings.

    The siblings go level by level from the leaf to the root of its tree and on to the root of all.
    folded_root is what they make of the digest in column `claimed`; verified says whether that is the root.
    """
    kind = m.leaves.schema["key"].dataType
    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", siblings array<string>" if paths else "")
    root = m.root

    def read(key: tuple, rows: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        one = parent.iloc[0]
        found = _paths_in(rows, one, 0)
        inside = (int(one["height"]) - 1) * ENTRY
        further: dict[str, str] = {}  # what a block root folds to, once per root

        def to_root(start: str, path: bytes) -> str:
            block_root = fold(start, path[:inside])
            if block_root not in further:
                further[block_root] = fold(block_root, path[inside:])
            return further[block_root]

        folded = [to_root(c, p) for c, p in zip(rows["claimed"], found, strict=True)]
        out = pd.DataFrame({"key": rows["key"], "leaf": rows["digest"], "subroot": one["top"], "root": root})
        beside = [siblings(p) for p in found]
        out["proof_sha256"] = [h(*s) for s in beside]
        out["folded_root"] = folded
        out["verified"] = [f == root for f in folded]
        if paths:
            out["siblings"] = beside
        return out

    above = leaf_paths(m.crown_leaves, m.crown).select(F.col("key").alias("tree"), F.col("path").alias("above"))
    children = m.leaves.select("tree", "n", F.col("nth").alias("child"), "digest", F.col("key").cast("string"), F.col(claimed).alias("claimed"))
    pairs = _grouped(children, 0).groupBy("tree", "block").cogroup(bottom_blocks(m.trees, above).groupBy("tree", "block"))
    # Keys pass through pandas as texts: a long beside nulls would become a double there.
    return pairs.applyInPandas(read, schema).withColumn("key", F.col("key").cast(kind))
