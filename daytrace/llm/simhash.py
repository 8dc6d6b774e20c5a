"""Operator 8: SimHash near-duplicates by anchor-point covering.

Anchors are the code words of a covering code: the first 46 of the 64 fingerprint bits are cut into
two blocks of 23, and each block is covered by the perfect binary Golay code, whose covering radius
is 3. So every fingerprint has one home anchor, at most 3 bits away in each block. A fingerprint is
replicated to every anchor within radius plus threshold: 3 + a bits in one block and 3 + b in the
other, for all a + b <= threshold. Two fingerprints that differ in at most `threshold` bits then
meet at the home of either, so comparing inside anchors finds every link.

Equal fingerprints are one node from the start, so groups of copies cost nothing. A task compares an
anchor's members in numpy and emits a spanning forest of the links, never all pairs. Anchors that
are home to more than `crowd` fingerprints (clouds of near copies) are not compared in one task:
their members are keyed by themselves and by all fingerprints one bit away; two that differ by at
most two bits share such a key, and a key has at most 65 distinct members whatever the data.
Components come from contraction of the links in rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import cut, packed, salted_join, small

WORDS = 3
SEED = 42
THRESHOLD = 2
#: Anchors that are home to more fingerprints than this are linked by one-bit keys instead.
CROWD = 256
# Generator polynomial of the binary Golay code of length 23.
GOLAY, BLOCK, RADIUS = 0xAE3, 23, 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of the word shingles; 0 for a text without words or null."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends[words - 1 :] - 1).tolist() if len(found) >= words else [len(line)]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, dtype=np.int64), len(last)
    for k in range(0, n, 65536):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[k : k + 65536], last[k : k + 65536])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint as a signed 64-bit number) per row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["_key", "fp"])

    return rows.mapInArrow(digest, f"_key {rows.schema['_key'].dataType.simpleString()}, fp bigint").withColumnRenamed("_key", key)


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    for bit in range(BLOCK - 1, 10, -1):
        v = np.where((v >> bit) & 1, v ^ (GOLAY << (bit - 11)), v)
    return v


@cache
def _errors(most: int) -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the words of weight up to 3 + `most` that lead to a code word, and the flips beyond 3 each needs."""
    words = [0]
    for size in range(1, RADIUS + most + 1):
        words += _of_weight(size)
    v = np.array(words, dtype=np.int64)
    weight = np.bitwise_count(v)
    syndrome = _syndrome(v)
    order = np.lexsort((weight, syndrome))
    v, weight, syndrome = v[order], weight[order], syndrome[order]
    begin = np.searchsorted(syndrome, np.arange(1 << 11))
    width = int(np.bincount(syndrome).max())
    table = np.zeros((1 << 11, width), dtype=np.int64)
    extra = np.full((1 << 11, width), 99, dtype=np.int64)
    place = np.arange(len(v)) - begin[syndrome]
    table[syndrome, place] = v
    extra[syndrome, place] = np.maximum(0, weight.astype(np.int64) - RADIUS)
    return table, extra


def _of_weight(size: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << b for b in bits) for bits in combinations(range(BLOCK), size)]


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, whether it is the row's home) for every anchor that each fingerprint goes to."""
    table, extra = _errors(threshold)
    mask = (1 << BLOCK) - 1
    blocks = [(fps & np.uint64(mask)).astype(np.int64), ((fps >> np.uint64(BLOCK)) & np.uint64(mask)).astype(np.int64)]
    (s1, s2) = (_syndrome(b) for b in blocks)
    r1, k1 = np.nonzero(extra[s1] <= threshold)
    a1, e1 = blocks[0][r1] ^ table[s1[r1], k1], extra[s1[r1], k1]
    rows, codes, homes = [], [], []
    for k2 in range(table.shape[1]):
        e = e1 + extra[s2[r1], k2]
        ok = e <= threshold
        r = r1[ok]
        rows.append(r)
        codes.append(a1[ok] | ((blocks[1][r] ^ table[s2[r], k2]) << BLOCK))
        homes.append(e[ok] == 0)
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(homes)


def with_homes(nodes: DataFrame) -> DataFrame:
    """fp and the anchor that is its home."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            _, code, _ = anchors(fps, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code)], names=["fp", "anchor"])

    return nodes.select("fp").mapInArrow(find, "fp bigint, anchor bigint")


def replicated(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """anchor, fp, home for each fingerprint and anchor within radius plus threshold."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(every), 2048):
                fps = every[k : k + 2048]
                row, code, home = anchors(fps, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code), pa.array(fps[row].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"]
                )

    return nodes.select("fp").mapInArrow(spread, "anchor bigint, fp bigint, home boolean")


def linked_members(fps: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and all members of one anchor."""
    parent = np.arange(len(fps))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    for i in np.nonzero(home)[0]:
        near = np.nonzero(np.bitwise_count(fps ^ fps[i]) <= threshold)[0]
        for j in near.tolist():
            a, b = top(int(i)), top(j)
            if a != b:
                parent[b] = a
                left.append(int(i))
                right.append(j)
    return fps[left], fps[right]


def compared(members: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) inside anchors: rows of one anchor lie together and are compared as they stream by."""
    together = members.select("anchor", "fp", "home").repartition("anchor").sortWithinPartitions("anchor")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in _with_end(batches):
            if batch is not None:
                part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
                held = part if not held else [np.concatenate(p) for p in zip(held, part)]
                last = int(np.searchsorted(held[0], held[0][-1]))
                whole, held = [h[:last] for h in held], [h[last:] for h in held]
            else:
                whole, held = held, []
            if not whole or not len(whole[0]):
                continue
            anchor, fps, home = whole[0], whole[1].view(np.uint64), whole[2].astype(bool)
            begin = np.concatenate(([0], np.nonzero(np.diff(anchor))[0] + 1, [len(anchor)]))
            size = np.diff(begin)
            a, b = [], []
            # Anchors of few members go side by side, one distance between rows at a time.
            few = np.nonzero((size > 1) & (size <= 16))[0]
            for step in range(1, 16):
                few = few[size[few] > step]
                if not len(few):
                    break
                count = size[few] - step
                i = np.repeat(begin[few] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                i = i[home[i] | home[i + step]]
                i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= threshold]
                a.append(fps[i])
                b.append(fps[i + step])
            for g in np.nonzero(size > 16)[0]:
                x, y = linked_members(fps[begin[g] : begin[g + 1]], home[begin[g] : begin[g + 1]], threshold)
                a.append(x)
                b.append(y)
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return together.mapInArrow(compare, "a bigint, b bigint")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def one_bit_links(members: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints up to two bits apart by shared one-bit keys; at most 65 members a key."""
    bits = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    keyed = members.select("fp", F.explode(bits).alias("near"))
    least = keyed.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("all")).where("a < z")
    return least.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def links(nodes: DataFrame, threshold: int = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """Distinct links (a, b) that connect all fingerprints of `nodes` up to `threshold` bits apart.

    `nodes` has one row per distinct fp. Links inside an anchor are thinned to a spanning forest.
    An anchor that is home to more than `crowd` fingerprints is dense: all its members, replicas
    included, are linked by one-bit keys, which covers every link of a fingerprint at home there;
    the links between all others are found in anchors without those fingerprints.
    """
    homes = packed(with_homes(nodes))
    dense = packed(homes.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"))
    if dense.isEmpty():
        return _ordered(compared(replicated(homes, threshold), threshold))
    if threshold > 2:
        raise ValueError("dense anchors are linked by one-bit keys, which reach two bits")
    dense = small(dense)
    calm = homes.join(dense, "anchor", "left_anti")
    members = replicated(homes, threshold).join(dense, "anchor").select("fp").distinct()
    return _ordered(compared(replicated(calm, threshold), threshold).unionByName(one_bit_links(members)))


def _ordered(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b): equal roots exactly where a path connects.

    Each round renames the nodes by a bijection (xxhash64 of one number is one), so that no order of
    names can be unlucky; then every node moves to the smallest name within two steps, and edges
    shrink to those between names that are left. A star, however large, collapses in one round, and
    any component loses a fraction of its nodes in each, so rounds grow with its logarithm.
    """
    edges = packed(edges)
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        fresh = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731  used within the round
        edges = edges.select(fresh("a").alias("a"), fresh("b").alias("b"))
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = packed(low.withColumnsRenamed({"a": "b"}))
        step = salted_join(both, low, ["b"], ["a"], salts=8).groupBy("a").agg(F.min("m").alias("to"))
        step = packed(step.select("a", F.least("a", "to").alias("to")))
        moved = salted_join(edges, step.withColumnRenamed("to", "x"), ["a"], ["b"], salts=8)
        moved = salted_join(moved, step.withColumnsRenamed({"a": "b", "to": "y"}), ["b"], ["a"], salts=8)
        edges = packed(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        roots = roots.withColumn("root", fresh("root"))
        roots = salted_join(roots, step.withColumnsRenamed({"a": "root"}), ["root"], ["node"], "left", salts=8)
        roots = packed(roots.select("node", F.coalesce("to", "root").alias("root")))
    return roots


def _named(prints: DataFrame, key: str) -> DataFrame:
    """fp, component_id and root (a name that the component has even without keys) of every distinct fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(nodes))
    known = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.struct(F.col("root").isNotNull().alias("linked"), F.coalesce("root", "fp").alias("name")).alias("root")
    )
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return salted_join(known.select("fp", "root"), least, ["root"], ["fp"], salts=8).select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id, the smallest key reachable over links.

    Null and empty texts have fingerprint zero and link like any other; a component of null keys only
    has a null id; repeated rows stay, each with the component of its fingerprint.
    """
    prints = cut(fingerprints(docs, key, text))
    met = salted_join(prints, _named(prints, key), ["fp"], [key])
    return met.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` of each component, with its columns: that with the smallest key, null keys last.

    Of rows that share this key the one with the smallest hash of the text stays. The texts are
    shuffled once, and only rows chosen by then are numbered to leave out repeated ones.
    """
    rows = docs.withColumn("__row_id", F.xxhash64(key, F.xxhash64(text)))
    prints = cut(fingerprints(rows, "__row_id", text))
    keys = rows.select("__row_id", F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "__row_id").alias("order"))
    keyed = prints.join(keys.groupBy("__row_id").agg(F.min("order").alias("order")), "__row_id")
    met = salted_join(keyed, _named(keyed.select("fp", F.col("order.key").alias("key")), "key"), ["fp"], ["__row_id"])
    chosen = met.groupBy("root").agg(F.min("order").alias("order")).select(F.col("order.__row_id").alias("__chosen"))
    once = Window.partitionBy("__row_id").orderBy("__row_id")
    picked = rows.join(chosen, F.col("__row_id") == F.col("__chosen")).withColumn("__nth", F.row_number().over(once))
    return picked.where("__nth = 1").select(*docs.columns)
