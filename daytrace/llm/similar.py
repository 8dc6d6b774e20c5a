"""Near-duplicates by similarity: documents whose five-word shingles have a Jaccard of at least 0.8.

Each text is cut into words as in `simhash`; 64-bit hashes of its shingles form a set, and equal sets
are one node. A set has BANDS keys of ROWS minhashes each: two sets of similarity 0.8 miss each other
in all of them with a probability of (1 - 0.8 ^ ROWS) ^ BANDS, about 5e-8. Nodes that share a key are
candidates, and the sets of candidates are made again from the texts and compared exactly.

A key with at most `pairs` nodes gives all their pairs. A larger one first gives each node with the smallest
and with the greatest of them, so that candidates grow with the nodes; that settles it where the key then
holds one component, as a group of near copies does. The nodes of the other large keys are compared in full:
two sets of similarity 0.8 share one of the rarest fifth of their shingles (their prefixes, in one order
for all, rarest first), so nodes with a common prefix shingle are candidates if they are not in one component already.
No pair is lost, and none is formed inside a component.

With `fingerprints`, nodes whose SimHash fingerprints `simhash` links are candidates as well, under the same exact check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm import simhash
from daytrace.llm.common import BROADCAST_ROWS, held, packed, salted_join
from daytrace.llm.simhash import _LOWER, components

WORDS = 5
BANDS, ROWS = 32, 4
#: Keys that hold more nodes than this are linked by their smallest and greatest node, the rest by prefixes.
PAIRS = 64
#: Numerator and denominator of the least similarity.
LEAST = (4, 5)
_FACTORS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole text if it has fewer words; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends[words - 1 :] - 1).tolist() if len(found) >= words else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, last)), dtype=np.uint64, count=len(last)))


def keys(found: np.ndarray) -> list[int]:
    """Signed keys of the bands of a set; one key of its own for the empty set."""
    if not len(found):
        return [0]
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), 4096):
        least = np.minimum(least, (_FACTORS[:, None] * found[None, k : k + 4096]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(rows[b].tobytes(), b)) for b in range(BANDS)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def signatures(rows: DataFrame, row: str, text: str) -> DataFrame:
    """row, node (a hash of the set of shingles) and keys per row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("similar")
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            nodes = pa.array([_signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array([keys(s) for s in sets], pa.list_(pa.int64()))], names=["row", "node", "keys"])

    return rows.select(row, text).mapInArrow(sign, "row bigint, node bigint, keys array<bigint>")


def candidates(nodes: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Distinct (a, b), a < b, of nodes (distinct node, keys) that share a key."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))
    shared = packed(shared.where("n > 1"))
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(shared), "key")
    else:
        met = salted_join(keyed.withColumnRenamed("key", "_key"), shared.withColumnRenamed("key", "_key"), ["_key"], ["node"], salts=8).withColumnRenamed("_key", "key")
    met = packed(met)
    together = met.where(F.col("n") <= pairs).groupBy("key").agg(F.collect_set("node").alias("all"))
    every = together.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))
    many = met.where(F.col("n") > pairs)
    ends = many.select(F.col("least").alias("a"), F.col("node").alias("b")).union(many.select("node", "most")).where("a < b")
    return every.union(ends).distinct()


def fingerprint_candidates(marked: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the nodes of `marked` (fp, node) that share a fingerprint or whose fingerprints are linked.

    A fingerprint stands for its nodes by the smallest of them, so pairs grow with nodes and links.
    """
    least = packed(marked.groupBy("fp").agg(F.min("node").alias("least")))
    same = salted_join(marked, least, ["fp"], ["node"], salts=8).select(F.col("least").alias("a"), F.col("node").alias("b"))
    one, two = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in ("a", "b"))
    across = simhash.links(least.select("fp")).join(one, "a").join(two, "b").select("least_a", "least_b")
    every = same.union(across).where("a <> b")
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_of(rows: DataFrame, text: str) -> DataFrame:
    """node and its set, made again from the text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "found"])

    return rows.select("node", text).mapInArrow(make, "node bigint, found array<bigint>")


def links(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of `found` whose sets have a Jaccard of at least LEAST."""
    size = sets.withColumn("size", F.size("found"))
    met = salted_join(found, size.withColumnsRenamed({"node": "b", "found": "y", "size": "n_y"}), ["b"], ["a"], salts=4)
    met = salted_join(met, size.withColumnsRenamed({"node": "a", "found": "x", "size": "n_x"}), ["a"], ["b"], salts=4)
    met = met.select("a", "b", "x", "y", (F.col("n_x") + F.col("n_y")).alias("both"))
    # i / (both - i) >= p / q without a division
    p, q = LEAST
    common = F.size(F.array_intersect("x", "y"))
    return met.where(common * (p + q) >= F.col("both") * p).select("a", "b").distinct()


def unsettled(nodes: DataFrame, roots: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(node, root) of the nodes that share a key with more than `pairs` nodes, not all of one component."""
    of = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    keyed = of.select("node", F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key"))
    mixed = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = packed(mixed.where((F.col("n") > pairs) & (F.col("least") != F.col("most"))).select("key"))
    return packed(salted_join(keyed, mixed, ["key"], ["node"], how="left_semi", salts=8).select("node", "root").distinct())


def prefix_candidates(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of different roots whose prefixes share a shingle and whose sizes allow the similarity."""
    p, q = LEAST
    size = F.size("found")
    elements = sets.join(roots, "node").select("node", "root", size.alias("size"), F.explode("found").alias("element"))
    seen = elements.groupBy("element").agg(F.count(F.lit(1)).alias("seen"))
    order = Window.partitionBy("node").orderBy("seen", "element")
    # A set of n must share n - ceil(n * p / q) + 1 of its first elements in that order.
    held = F.col("size") - F.ceil(F.col("size") * p / q) + 1
    prefixes = elements.join(seen, "element").withColumn("_nth", F.row_number().over(order)).where((F.col("_nth") <= held) & (F.col("seen") > 1))
    prefixes = packed(prefixes.select("element", "node", "root", "size"))
    other = prefixes.select("element", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"))
    near = (F.greatest("size", "size_b") * p <= F.least("size", "size_b") * q) & (F.col("root") != F.col("root_b")) & (F.col("node") < F.col("b"))
    return prefixes.join(other, "element").where(near).select(F.col("node").alias("a"), "b").distinct()


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", pairs: int = PAIRS, fingerprints: bool = False) -> DataFrame:
    """One row of `docs` of each component of similar texts: that with the smallest key, null keys last.

    Texts without words are copies of each other. Of rows that share the smallest key the one with the
    smallest hash of the text stays, and of repeated rows one. Components follow links of similar texts.
    """
    rows = docs.withColumn("__row_id", F.xxhash64(key, F.xxhash64(text)))
    prints = packed(signatures(rows, "__row_id", text))
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "__row_id")
    orders = rows.select("__row_id", order.alias("order")).groupBy("__row_id").agg(F.min("order").alias("order"))
    ordered = prints.join(orders, F.col("row") == F.col("__row_id"))
    nodes = packed(ordered.groupBy("node").agg(F.min("order").alias("order"), F.any_value("keys").alias("keys")))

    def sets(wanted: DataFrame) -> DataFrame:
        needed = packed(nodes.join(wanted, "node").select("node", F.col("order.__row_id").alias("__row")))
        texts = rows.select("__row_id", text).join(needed, F.col("__row_id") == F.col("__row")).dropDuplicates(["__row_id"])
        return packed(sets_of(texts, text))

    met = candidates(nodes.select("node", "keys"), pairs)
    if fingerprints:
        marked = packed(simhash.fingerprints(rows, "__row_id", text)).join(prints.select(F.col("row").alias("__row_id"), "node"), "__row_id")
        met = met.union(fingerprint_candidates(packed(marked.select("fp", "node").distinct()))).distinct()
    found = packed(met)
    linked = packed(links(found, sets(found.select(F.col("a").alias("node")).union(found.select("b")).distinct())))
    roots = components(linked)
    rest = unsettled(nodes.select("node", "keys"), roots, pairs)
    if not rest.isEmpty():
        crowd = sets(rest.select("node"))
        more = links(packed(prefix_candidates(crowd, rest)), crowd)
        roots = components(packed(linked.union(more).distinct()))
    known = nodes.select("node", "order").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    root = F.struct(F.col("root").isNotNull().alias("linked"), F.coalesce("root", "node").alias("name"))
    chosen = known.groupBy(root.alias("root")).agg(F.min("order").alias("order")).select(F.col("order.__row_id").alias("__chosen"))
    once = Window.partitionBy("__row_id").orderBy("__row_id")
    picked = rows.join(chosen, F.col("__row_id") == F.col("__chosen")).withColumn("__nth", F.row_number().over(once))
    return picked.where("__nth = 1").select(*docs.columns)
