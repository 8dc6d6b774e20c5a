import random

from brute import sha

from daytrace.llm import digest


def run(spark, rows, ranges=None):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, fingerprint string, _range int")
    return digest.edited_pairs(docs, ranges=ranges).collect()


def check(rows, got):
    ordered = sorted(rows)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (k, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = by[k]
        assert (r.n_chars, sha(r.edited)) == (len(t), sha(edited))
        assert (r.fingerprint, r.edited_fingerprint) == (digest.digest(t), digest.digest(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_edited_texts_over_ranges(spark):
    draw = random.Random(1)
    rows = [(draw.randrange(10**9), "".join(draw.choice("abcdé😀 ") for _ in range(draw.randint(0, 90)))) for _ in range(150)]
    rows = list(dict(rows).items())
    for ranges in (None, 9, 4096):
        check(rows, run(spark, rows, ranges))


def test_few_rows_nulls_and_repeated_rows(spark):
    check([(1, "abcdef")], run(spark, [(1, "abcdef")]))
    check([(1, None), (2, ""), (3, "abcdef")], run(spark, [(1, None), (2, ""), (3, "abcdef")], 3))
    assert run(spark, []) == []
    got = run(spark, [(None, "aaaa"), (None, "bbbb"), (2, "cccc"), (2, "cccc")], 4)
    assert len(got) == 4 and {r.edited for r in got} <= {"aabb", "bbcc", "bbaa", "aacc", "cccc", "ccaa", "ccbb"}


def test_score():
    import pandas as pd

    draw = random.Random(2)
    long = "".join(draw.choice(["alpha ", "beta ", "gamma-", "delta\n", "eps ", "zeta", "eta ", "theta"]) for _ in range(60_000))
    a, b, c, e = digest.digest(long), digest.digest(long[:-500] + "x" * 500), digest.digest("z" * 90_000), digest.digest("")
    d = digest.difference(pd.Series([a, a, a, e, e]), pd.Series([a, b, c, e, a])).tolist()
    assert d[0] == d[3] == 0 and d[1] < 0.1 < d[2] <= 1 and d[4] == 1 and digest.digest(None) == e and len(a) == 130
    assert digest.bucket_counts(b"abcd").sum() == 2 and digest.bucket_counts(b"x" * ((1 << 20) + 50)).sum() == (1 << 20) + 48
