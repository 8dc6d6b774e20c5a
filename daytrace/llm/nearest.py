"""Operator 13: exact top-k by inner product, as a Voronoi k-nearest-neighbour join.

Vectors become whole numbers, floor(scale * x). One more component, sqrt(M - |x|^2) for data and 0 for
queries, with M the greatest squared length, turns the greatest inner product into the least
distance, since |q - x|^2 = |q|^2 + M - 2 q.x. In that space:

1. Pivots, a bounded draw by hash of the vectors, are sent to all tasks; each row goes to the cell
   of its nearest pivot and keeps its distance from it.
2. A summary per cell (rows, k + 1 least and the greatest distance from the pivot; for queries rows and the
   greatest distance) is all that the driver sees: PIVOTS rows at most.
3. From summaries, theta of a cell's queries: k + 1 rows at least lie within it (one may be the query itself).
   A row x of cell j can matter to queries of cell i only if | d(p_i, p_j) - d(p_j, x) | <= theta_i + U_i,
   U_i the greatest distance of a query of i from p_i.
4. Query cells near each other make a group; each row is copied to the groups whose ring it lies in.
   A group's rows are dealt to blocks by a hash of the row, so no cell, however full, meets in one task.
5. A task multiplies a group's queries with a block of rows and keeps k each; the best k of all blocks are the
   result. Scores are whole numbers, so the result does not depend on pivots, groups or blocks.

Defined cases: null vectors, and such with null or non-finite components, take no part, nor do rows without an id;
a shorter vector counts as if zeros followed; equal scores go to the smaller id, rows of equal
ids being rows of their own (a query is never its own neighbour, but may be of its copy); a whole number or score beyond a
long is held at the end of its range; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytrace.llm.common import new_folder

#: Most pivots; below that there are as many as the square root of the rows.
PIVOTS = 1024
#: Queries of a group and rows of a block, about: a task holds one of each and their products by parts.
GROUP_QUERIES, BLOCK_ROWS = 1024, 8192
#: Queries multiplied at a time.
PART = 256
#: Rows turned into cells at a time.
BATCH = 8192
#: Bounds are widened by this share, beyond any rounding of doubles.
SLACK = 1e-6
#: Whole numbers up to this are exact as doubles, sums included.
EXACT = 2**53
LONG = 2**63


@dataclass(frozen=True)
class Pivots:
    at: np.ndarray  # pivots x (components + 1)
    most: float  # the greatest squared length


# Rows


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, row, v): v the whole numbers, row a number of its own for each row; written once."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(key).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    v = F.transform(x, lambda c: F.when(F.abs(c) < LONG / scale, F.floor(c * scale)).when(c > 0, F.lit(LONG - 1)).otherwise(F.lit(-LONG)))
    taken = rows.select(F.col(key).alias("id"), v.alias("v"), sound.alias("_sound")).where("_sound").drop("_sound")
    path = new_folder(rows.sparkSession, "vectors")
    taken.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.schema(taken.withColumn("row", F.lit(0).cast("bigint")).schema).parquet(path)


def _matrix(lists, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of a matrix of longs, zeros behind shorter ones."""
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _placed(v: np.ndarray, pivots: Pivots, query: bool) -> np.ndarray:
    """The point of a vector in the space where nearest means greatest product."""
    x = v.astype(np.float64)
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(pivots.most - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, more])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def draw_pivots(vectors: DataFrame, most: int = PIVOTS) -> Pivots | None:
    """The vectors with the least hashes, as many as the square root of the rows, `most` at most."""
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    facts = vectors.agg(F.count("*").alias("n"), F.max(length).alias("most"), F.max(F.size("v")).alias("width")).first()
    if not facts["n"]:
        return None
    wanted = min(most, math.isqrt(facts["n"] - 1) + 1)
    drawn = vectors.select("v", F.xxhash64("v").alias("_h")).distinct().orderBy("_h").limit(wanted).collect()
    at = _matrix([r["v"] for r in drawn], facts["width"])
    squares = facts["most"] * (1 + SLACK)
    return Pivots(_placed(at, Pivots(at, squares), False), squares)


def assign(vectors: DataFrame, pivots: Pivots, query: bool) -> DataFrame:
    """(id, row, v, cell, dist): the nearest pivot of each row and the distance from it."""
    width = pivots.at.shape[1] - 1

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), BATCH):
                some = rows.iloc[k : k + BATCH].copy()
                d = _distances(_placed(_matrix(some["v"].tolist(), width), pivots, query), pivots.at)
                some["cell"] = d.argmin(axis=1)
                some["dist"] = d.min(axis=1)
                yield some

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "row", "v").mapInPandas(near, f"id {kind}, row bigint, v array<bigint>, cell bigint, dist double")


# Bounds from summaries


@dataclass(frozen=True)
class Plan:
    """Where rows go: per cell of data the groups and the ring of distances they need; per group its blocks."""

    groups: np.ndarray  # of each query cell, -1 without queries
    parts: np.ndarray  # of each group: parts that its queries are dealt to
    blocks: np.ndarray  # of each group
    low: np.ndarray  # cells x groups
    high: np.ndarray


def summaries(placed: DataFrame, k: int) -> pd.DataFrame:
    """Per cell: rows, the greatest distance, and the k + 1 least ones."""
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    least = placed.select("cell", "dist").withColumn("_nth", nth).where(F.col("_nth") <= k + 1).groupBy("cell").agg(F.sort_array(F.collect_list("dist")).alias("least"))
    return placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("dist").alias("most")).join(least, "cell").toPandas()


def bounds(pivots: Pivots, data: pd.DataFrame, queries: pd.DataFrame, k: int, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> Plan:
    """Groups of near query cells, and the rings of data that they need."""
    cells = len(pivots.at)
    between = _distances(pivots.at, pivots.at)
    least = np.full((cells, k + 1), np.inf)
    for cell, some in zip(data["cell"], data["least"], strict=True):
        least[cell, : len(some)] = some
    reach, asked = np.zeros(cells), np.zeros(cells, dtype=np.int64)
    reach[queries["cell"]], asked[queries["cell"]] = queries["most"], queries["rows"]
    held, most = np.zeros(cells, dtype=np.int64), np.full(cells, -np.inf)
    held[data["cell"]], most[data["cell"]] = data["rows"], data["most"]
    theta = np.full(cells, np.inf)
    for i in np.flatnonzero(asked):
        upper = (between[i][:, None] + least + reach[i]).ravel()
        theta[i] = np.partition(upper, k)[k]
    # Neighbouring cells until a group is full; the next one is always the nearest that is left.
    groups, number, filled = np.full(cells, -1), 0, 0
    left = set(np.flatnonzero(asked).tolist())
    at = min(left, default=None)
    while left:
        if filled and filled + asked[at] > group_queries:
            number, filled = number + 1, 0
        groups[at], filled = number, filled + asked[at]
        left.discard(at)
        rest = np.fromiter(left, dtype=np.int64, count=len(left))
        at = int(rest[between[at][rest].argmin()]) if left else None
    count = int(groups.max()) + 1 if len(groups) else 0
    low, high = np.full((cells, count), np.inf), np.full((cells, count), -np.inf)
    for i in np.flatnonzero(asked):
        width = (theta[i] + reach[i]) * (1 + SLACK) + 1
        low[:, groups[i]] = np.minimum(low[:, groups[i]], between[i] * (1 - SLACK) - width)
        high[:, groups[i]] = np.maximum(high[:, groups[i]], between[i] * (1 + SLACK) + width)
    parts = np.array([-(-int(asked[groups == g].sum()) // group_queries) for g in range(count)], dtype=np.int64)
    # Cells that a ring reaches; of a cell that it crosses fewer rows may go.
    needed = [int(held[(low[:, g] <= most) & (high[:, g] >= least[:, 0])].sum()) for g in range(count)]
    return Plan(groups, parts, np.array([max(1, -(-n // block_rows)) for n in needed], dtype=np.int64), low, high)


def _mixed(row: np.ndarray, seed: int) -> np.ndarray:
    """A hash of row numbers (splitmix), so blocks and parts fill evenly."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (z ^ (z >> np.uint64(31))) >> np.uint64(1)


def send_data(placed: DataFrame, plan: Plan) -> DataFrame:
    """Rows, copied to the groups (all their parts) whose ring they lie in: (part, block, id, row, v)."""

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cell, dist, row = rows["cell"].to_numpy(), rows["dist"].to_numpy(), rows["row"].to_numpy()
            for g in range(len(plan.parts)):
                meant = np.flatnonzero((dist >= plan.low[cell, g]) & (dist <= plan.high[cell, g]))
                block = (_mixed(row[meant], 1) % np.uint64(plan.blocks[g])).astype(np.int64)
                for p in range(int(plan.parts[g])):
                    for k in range(0, len(meant), BATCH):
                        some = rows.iloc[meant[k : k + BATCH]][["id", "row", "v"]]
                        yield some.assign(grp=g, part=p, block=block[k : k + BATCH])

    return placed.mapInPandas(copies, _sent(placed))


def send_queries(placed: DataFrame, plan: Plan) -> DataFrame:
    """Queries, copied to all blocks of their group."""

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            group = plan.groups[rows["cell"].to_numpy()]
            part = (_mixed(rows["row"].to_numpy(), 2) % plan.parts[group].astype(np.uint64)).astype(np.int64)
            for g in np.unique(group):
                mine = rows[group == g][["id", "row", "v"]].assign(grp=g, part=part[group == g])
                for block in range(int(plan.blocks[g])):
                    yield mine.assign(block=block)

    return placed.mapInPandas(copies, _sent(placed))


def _sent(placed: DataFrame) -> str:
    return f"id {placed.schema['id'].dataType.simpleString()}, row bigint, v array<bigint>, grp bigint, part bigint, block bigint"


# Local search


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as exact longs; beyond a long they are held at its ends."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if bound < LONG / 2:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -LONG, LONG - 1).astype(np.int64)


def best(scores: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """Per query the places of its k greatest scores, the earlier place first among equals; own[i] is left out."""
    out = []
    for s, mine in zip(scores, own, strict=True):
        open_ = np.flatnonzero(np.arange(len(s)) != mine) if mine >= 0 else np.arange(len(s))
        if len(open_) > k:
            least = np.partition(s[open_], len(open_) - k)[len(open_) - k]
            over = open_[s[open_] > least]
            open_ = np.concatenate([over, open_[s[open_] == least][: k - len(over)]])
        out.append(open_[np.lexsort((open_, ~s[open_]))])
    return out


def _search(k: int):
    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = {"qrow": [], "query": [], "id": [], "row": [], "score": []}
        if len(queries) and len(rows):
            rows = rows.sort_values(["id", "row"], kind="stable")
            width = max(queries["v"].map(len).max(), rows["v"].map(len).max())
            x, ids, numbers = _matrix(rows["v"].tolist(), width), rows["id"].to_numpy(), rows["row"].to_numpy()
            place = {n: i for i, n in enumerate(numbers.tolist())}
            for start in range(0, len(queries), PART):
                some = queries.iloc[start : start + PART]
                scores = products(_matrix(some["v"].tolist(), width), x)
                own = np.array([place.get(n, -1) for n in some["row"].tolist()])
                for i, at in enumerate(best(scores, own, k)):
                    found["qrow"] += [some["row"].iloc[i]] * len(at)
                    found["query"] += [some["id"].iloc[i]] * len(at)
                    found["id"] += ids[at].tolist()
                    found["row"] += numbers[at].tolist()
                    found["score"] += scores[i, at].tolist()
        return pd.DataFrame(found)

    return search


def top_k(
    rows: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024,
    pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, key, score) of the k best rows of each row for which `asked` (over column id) holds."""
    kind = rows.schema[key].dataType.simpleString()
    out = f"query_id {kind}, rank int, {key} {kind}, score bigint"
    vectors = whole_vectors(rows, key, vector, scale)
    drawn = draw_pivots(vectors, pivots)
    if drawn is None:
        return rows.sparkSession.createDataFrame([], out)
    spark = rows.sparkSession
    sides = []
    for side, query in ((vectors, False), (vectors.where(asked), True)):
        placed = assign(side, drawn, query)
        path = new_folder(spark, "cells")
        placed.write.parquet(path)
        sides.append(spark.read.schema(placed.schema).parquet(path))
    data, queries = sides
    plan = bounds(drawn, summaries(data, k), summaries(queries, k), k, group_queries, block_rows)
    keys = ["grp", "part", "block"]
    pairs = send_queries(queries, plan).groupBy(*keys).cogroup(send_data(data, plan).groupBy(*keys))
    near = pairs.applyInPandas(_search(k), f"qrow bigint, query {kind}, id {kind}, row bigint, score bigint")
    nth = F.row_number().over(Window.partitionBy("qrow").orderBy(F.col("score").desc(), "id", "row"))
    ranked = near.withColumn("rank", nth).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")
