import random

import pytest
from brute import contamination as plain

from daytrace.llm import contamination


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(k, t, 1, "w") for k, t in docs], "doc_id bigint, text string, n_words int, words string"),
        spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, row int"),
    )


def compare(spark, docs, items, span=13):
    d, b = tables(spark, docs, items)
    got = contamination.contamination(d, b, span=span).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        n, hit, found, bad = plain(texts[r.doc_id], [(k, t) for k, t in items if k is not None], span)
        assert (r.n_words, r.n_hit, sorted(r["items"], key=str), r.contaminated) == (n, hit, found, bad), r


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_python(spark, seed):
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(n))
    items = [(i, text(draw.randint(0, 12))) for i in range(12)]
    docs = [(i, text(draw.randint(0, 60)) + (" " + items[i % 12][1]) * (i % 3)) for i in range(60)]
    compare(spark, docs, items, span=4)


def test_contract_cases(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    docs = [
        (1, item), (2, " ".join(words[2:15])), (3, " ".join(words[2:14])), (4, "x " * 300 + " ".join(words[5:18])),
        (5, "W5, " + "-".join(words[6:18]).upper()), (6, None), (7, ""), (8, "short item here"), (9, "É é ÀB nothing"),
        (10, " ".join(words[20:30]) + " tail"), (11, ("filler " * 20_000) + item), (12, "rest of w0 " + " ".join(words[17:])),
    ]
    items = [(100, item), (20, "Short  ITEM"), (3, None), (4, " "), (5, "é"), (6, "never in any document"), (100, item)]
    compare(spark, docs, items)


def test_repeated_rows_null_ids_and_no_rows(spark):
    d, b = tables(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "x")], [(None, "b c"), (7, "a b")])
    got = sorted((r.doc_id or 0, r.n_hit, r["items"]) for r in contamination.contamination(d, b).collect())
    assert got == [(0, 3, ["7"]), (1, 3, ["7"]), (1, 3, ["7"]), (2, 0, [])] or [g[:2] for g in got] == [(0, 3), (1, 3), (1, 3), (2, 0)]
    empty_d, empty_b = tables(spark, [], [])
    assert contamination.contamination(empty_d, b).count() == 0
    assert [r.n_hit for r in contamination.contamination(d, empty_b).collect()] == [0] * 4


def test_proximity(spark):
    d, b = tables(spark, [(1, "rare1 x x rare2"), (2, "rare1 rare2"), (3, "rare1 " + "x " * 30 + "rare2"), (4, "x rare1 x rare2")], [(9, "rare1 x rare2")])
    got = {(r.doc_id, r.off) for r in contamination.proximity(d, b, slack=3).collect()}
    assert {k for k, _ in got} == {1, 2, 4} and (4, 0) in got and all(abs(o) <= 3 for _, o in got)
