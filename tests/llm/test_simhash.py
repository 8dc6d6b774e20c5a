import random

import numpy as np
import pytest
from brute import groups, simhash as plain

from daytrace.llm import simhash


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def clouds(seed, centres, each, flips):
    draw, out = random.Random(seed), set()
    for _ in range(centres):
        c = draw.getrandbits(64)
        for _ in range(each):
            v = c
            for _ in range(draw.randint(0, flips)):
                v ^= 1 << draw.randrange(64)
            out.add(v)
    return sorted(out)


@pytest.mark.parametrize("crowd", [256, 3])
def test_components_against_all_pairs(spark, crowd):
    fps = clouds(1, 40, 8, 3) + clouds(2, 2, 60, 4) + [0, 1, 3, (1 << 64) - 1]
    fps = sorted(set(fps))
    want = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, crowd=crowd)).collect()}
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(roots.get(signed(f), ("alone", f)), set()).add(i)
    expected = {}
    for i, g in enumerate(want):
        expected.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))
    assert any(len(g) > 3 for g in got.values())


def test_every_fingerprint_has_one_home_and_close_ones_meet_there():
    draw = random.Random(5)
    fps = np.array([draw.getrandbits(64) for _ in range(300)], dtype=np.uint64)
    row, code, home = simhash.anchors(fps)
    assert sorted(row[home]) == list(range(300))
    homes = dict(zip(row[home].tolist(), code[home].tolist()))
    for i in range(300):
        other = int(fps[i]) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))
        _, reached, _ = simhash.anchors(np.array([other], dtype=np.uint64))
        assert homes[i] in reached


def test_star_and_chain(spark):
    star = [(0, i) for i in range(1, 400)]
    chain = [(1000 + i, 1001 + i) for i in range(300)]
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(star + chain, "a bigint, b bigint")).collect()}
    assert len(roots) == 701 and len({roots[i] for i in range(400)}) == 1 and len({roots[1000 + i] for i in range(301)}) == 1
    assert len(set(roots.values())) == 2


def documents(spark, rows):
    return spark.createDataFrame([(k, t, 1, "z", 0) for k, t in rows], "doc_id bigint, text string, fp int, fingerprint string, component_id int")


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (3, base.upper()), (5, base + " one"), (9, None), (4, ""), (6, " \t\n"), (2, "a b"), (8, "A  b"), (8, "A  b"), (None, "solo x y"), (11, "Ä ß \u00a0x"), (12, "w " * 50_000)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for k, t in rows:
        texts.setdefault(k, t)
    for r in got:
        assert r.fingerprint == f"{plain(texts[r.doc_id]):016x}"
    by = {r.doc_id: r.component_id for r in got}
    assert by[7] == by[3] == 3 and by[9] == by[4] == by[6] == 4 and by[2] == by[8] == 2 and by[None] is None
    kept = simhash.representatives(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == sorted((k is None, k) for k in {by[r.doc_id] for r in got})
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 and simhash.representatives(documents(spark, [])).count() == 0


def test_rounds_over_few_edges_do_not_write_files_of_every_shuffle_partition(spark):
    from daytrace.llm.simhash import components

    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a bigint, b bigint").repartition(48, "a")
        roots = components(edges)
        groups: dict[int, set[int]] = {}
        for r in roots.collect():
            groups.setdefault(r["root"], set()).add(r["node"])
        parts = roots.rdd.getNumPartitions()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(map(sorted, groups.values())) == [list(range(i, i + 10)) for i in range(0, 40, 10)]
    assert parts <= spark.sparkContext.defaultParallelism
