import random

from brute import sha
from pyspark.sql import functions as F

from daytrace.llm import manifest


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([sha("".join(x[i : i + 2])) for i in range(0, len(x), 2)])
    return out


def siblings(tree, i):
    found = []
    for nodes in tree[:-1]:
        if i ^ 1 < len(nodes):
            found.append((i ^ 1 < i, nodes[i ^ 1]))
        else:
            found.append(None)
        i //= 2
    return found


def expected(rows):
    """(tree, key, leaf, claimed) -> sorted rows of prove, by the plain definition."""
    trees = {}
    for t, k, leaf, claimed in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        trees.setdefault(t, []).append((k, leaf, claimed))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {t: levels([x[1] for x in trees[t]]) for t in names}
    crown = levels([grown[t][-1][0] for t in names])
    out = []
    for at, t in enumerate(names):
        for i, (k, leaf, claimed) in enumerate(trees[t]):
            path = siblings(grown[t], i) + siblings(crown, at)
            x = claimed
            for s in path:
                x = sha(x) if s is None else sha(s[1] + x) if s[0] else sha(x + s[1])
            beside = [s[1] for s in path if s]
            out.append((str(k), leaf, grown[t][-1][0], crown[-1][0], sha("".join(beside)), x, x == crown[-1][0], beside))
    return sorted(out)


def proved(spark, rows):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "t string, k bigint, leaf string, claimed string, tree string, nth int")
    built = manifest.manifest(df, "t", "k", "leaf", carried=["claimed"])
    got = manifest.prove(built, "claimed", paths=True)
    return sorted((str(r.key), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified, r.siblings) for r in got.collect())


def test_addresses_are_the_recursive_order():
    def order(depth, index, height):
        """Nodes (depth, index) of a subtree in van Emde Boas order, by plain recursion."""
        if height == 1:
            return [(depth, index)]
        low = height // 2
        high = height - low
        out = order(depth, index, high)
        for j in range(1 << high):
            out += order(depth + high, (index << high) + j, low)
        return out

    for height in range(1, 11):
        nodes = order(0, 0, height)
        assert [manifest.address(height, d, i) for d, i in nodes] == list(range((1 << height) - 1))
        assert all(manifest.layout(height)[d][i] == place for place, (d, i) in enumerate(nodes))
    for height in (13, 18, 37):
        assert sum(manifest.bands(height)) == height and max(manifest.bands(height)) <= manifest.BAND


def test_trees_and_proofs(spark):
    draw = random.Random(5)
    rows = []
    for t, n in (("en", 170), (None, 5), ("de", 64), ("é", 1), ("fr", 33), ("Z", 2)):
        for k in draw.sample(range(10**12), n):
            leaf = sha(f"{t}{k}")
            rows.append((t, k, leaf, leaf if k % 3 else sha("other")))
    assert proved(spark, rows) == expected(rows)


def test_long_trees_of_many_bands(spark):
    """4,500 leaves have 14 levels, so two bands of 7; the block table is contiguous in the order."""
    rows = [("x", k, sha(str(k)), sha(str(k))) for k in range(4500)]
    got = proved(spark, rows)
    assert got == expected(rows) and all(r[6] for r in got)
    df = spark.createDataFrame(rows, "tree string, key bigint, digest string, claimed string")
    forest = manifest.grow(manifest.ranked(df, "tree", ["key"]))
    assert len(forest.bands) == 2
    tree = levels([r[2] for r in rows])
    for band, blocks in enumerate(forest.bands):
        for b in blocks.collect():
            down = 7 if band == 0 else 0
            for depth in range(b.height):
                for i in (0, (1 << depth) - 1):
                    index = (b.block << depth) + i
                    place = manifest.address(14, down + depth, index) - b.base
                    want = tree[13 - down - depth]
                    held = b.nodes[place * 32 : place * 32 + 32].hex()
                    assert held == (want[index] if index < len(want) else "0" * 64)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [("a", None, sha("1"), sha("1")), ("a", None, sha("1"), sha("1")), ("a", 7, sha("2"), sha("2")), ("a", 7, sha("3"), sha("3")), (None, 9, sha("4"), sha("x"))]
    assert proved(spark, rows) == expected(rows)
    assert proved(spark, []) == []
    assert proved(spark, [(None, None, sha("1"), sha("1"))]) == expected([(None, None, sha("1"), sha("1"))])


def test_record_digest(spark):
    df = spark.createDataFrame([(1, None, "é\n:2"), (None, "", "-")], "a bigint, b string, c string")
    got = [r[0] for r in df.select(manifest.record_digest([F.col(c) for c in "abc"])).collect()]
    assert got == [sha("1:1-5:é\n:2"), sha("-0:1:-")]
