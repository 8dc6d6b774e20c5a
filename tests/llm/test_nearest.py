import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daytrace.llm import nearest


def plain(rows, k):
    """Sorted (query_id, rank, vec_id, score) over all pairs of rows (id, vector)."""
    vectors = []
    for key, v in rows:
        if key is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        vectors.append((key, [max(-(2**63), min(2**63 - 1, math.floor(1024 * c))) for c in v]))
    out = []
    for i, (key, q) in enumerate(vectors):
        if key % 10:
            continue
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x)))), other) for j, (other, x) in enumerate(vectors) if j != i)
        out += [(key, n, other, -s) for n, (s, other) in enumerate(found[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, row int, v string")
    got = nearest.top_k(df, F.col("id") % 10 == 0, k=k, **more)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def clustered(seed, n, dims=8, centers=12, unit=False):
    draw = np.random.default_rng(seed)
    at = draw.normal(size=(centers, dims)) * 3
    x = at[draw.integers(centers, size=n)] + draw.normal(size=(n, dims)) * 0.1
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_all_pairs(spark):
    rows = clustered(1, 600)
    assert found(spark, rows) == plain(rows, 5)
    assert found(spark, rows, pivots=3, group_queries=7, block_rows=40) == plain(rows, 5)


def test_rings_leave_rows_out(spark):
    """Far clusters of vectors of about one length go to few groups, and the result is still whole."""
    rows = clustered(2, 900, centers=9, unit=True)
    seen = []
    plan = nearest.bounds

    def watched(*args, **named):
        seen.append((plan(*args, **named), args[1]))
        return seen[-1][0]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(nearest, "bounds", watched)
        assert found(spark, rows, group_queries=5) == plain(rows, 5)
    made, data = seen[0]
    groups = made.low.shape[1]
    sent = 0
    for cell, n, most, least in zip(data["cell"], data["rows"], data["most"], data["least"], strict=True):
        sent += n * sum(made.low[cell, g] <= most and made.high[cell, g] >= least[0] for g in range(groups))
    assert groups > 3 and sent < 0.7 * len(rows) * groups
    assert made.blocks.tolist() == [1] * groups


def test_copies_ties_and_repeated_ids(spark):
    draw = random.Random(4)
    rows = [(i, [1.0, 0.5] if i % 3 else [draw.choice([0.25, 0.5]), draw.choice([1.0, -1.0])]) for i in range(300)]
    rows += [(10, [1.0, 0.5]), (10, [1.0, 0.5]), (11, [1.0, 0.5])]
    assert found(spark, rows, block_rows=16) == plain(rows, 5)


def test_nulls_lengths_and_great_values(spark):
    rows = [
        (0, [1.0, 2.0]), (10, None), (20, [1.0, None]), (30, [math.nan, 1.0]), (40, [math.inf, 1.0]), (None, [1.0, 1.0]), (50, []), (60, [1.0, 2.0, -3.0]),
        (70, [3e38, -3e38]), (1, [1e20, 1.0]), (2, [-1e30, 1.0]), (3, [2.0**40, 2.0**40]), (80, [2.0**40, -(2.0**41)]),
    ]
    assert found(spark, rows) == plain(rows, 5)
    assert found(spark, rows[:1]) == [] and found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []
