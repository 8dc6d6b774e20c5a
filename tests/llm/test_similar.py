import random

import corpus_pipeline
import pytest
from brute import LOWER, groups, simhash

from daytrace.llm import similar


def found(text):
    words = (text or "").translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def edited(seed, bases=14, each=5, size=200):
    draw, texts = random.Random(seed), []
    word = lambda: f"w{draw.randrange(10**6)}"
    for _ in range(bases):
        base = [word() for _ in range(size)]
        for _ in range(each):
            text = list(base)
            for _ in range(draw.randrange(0, 9)):
                text[draw.randrange(size)] = word()
            texts.append(" ".join(text))
    return texts


def kept(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((r.doc_id is None, r.doc_id, r.text) for r in similar.representatives(df, **how).collect())


def test_against_all_pairs(spark):
    texts = edited(1)
    sets = [found(t) for t in texts]
    want = set(groups(sets, alike))
    assert 14 < len(want) < len(texts)
    assert kept(spark, list(enumerate(texts))) == sorted((False, i, texts[i]) for i in want)


def test_stage_takes_similar_texts_that_are_more_than_two_bits_apart(spark):
    texts = edited(2)
    pair = next((a, b) for i, a in enumerate(texts) for b in texts[:i] if alike(found(a), found(b)) and (simhash(a) ^ simhash(b)).bit_count() > 4)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(pair)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [tuple(r) for r in corpus_pipeline.without_near_copies(spark, df, "").collect()] == rows[:1]


@pytest.mark.parametrize("pairs", [64, 3])
def test_large_groups(spark, pairs):
    draw = random.Random(3)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(base + [f"x{draw.randrange(10**6)}"])) for i in range(120)]
    rows += [(200 + i, t) for i, t in enumerate(edited(4, bases=3, each=1))]
    assert [r[1] for r in kept(spark, rows, pairs=pairs)] == [0, 200, 201, 202]


def test_pairs_over_one_shared_passage(spark):
    """All texts share a passage; two of each pair are just similar, any others just not."""
    draw = random.Random(5)
    passage = [f"p{i}" for i in range(400)]
    own = lambda n: [f"o{draw.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(150):
        both = own(1)
        rows += [(2 * i + k, " ".join(passage + both + own(49))) for k in range(2)]
    sets = [found(t) for _, t in rows]
    want = groups(sets, alike)
    assert sum(alike(sets[i], sets[i + 1]) for i in range(0, 300, 2)) == 150 and len(set(want)) == 150
    assert [r[1] for r in kept(spark, rows, pairs=8)] == sorted(set(want))


def test_nulls_short_texts_and_no_rows(spark):
    rows = [(7, None), (4, ""), (6, " \n"), (2, "A  b"), (8, "a b"), (8, "a b"), (9, "a b c"), (None, "a B"), (None, "solo"), (None, "solo")]
    assert kept(spark, rows) == [(False, 2, "A  b"), (False, 4, ""), (False, 9, "a b c"), (True, None, "solo")]
    assert kept(spark, []) == []


def test_stage_takes_the_links_of_fingerprints(spark, monkeypatch):
    """With no minhash key shared, texts whose fingerprints are linked still meet, and the exact check judges them."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(10**6)}" for _ in range(1500)]
    near = next(t for i in range(1500) if (simhash(t := " ".join(base[:i] + ["other"] + base[i + 1 :])) ^ simhash(" ".join(base))).bit_count() == 2)
    short = ["a b c d", "a b c d a b c d"]  # other sets of five words
    texts = [" ".join(base), near, *short]
    assert alike(found(texts[0]), found(texts[1])) and not alike(*map(found, short))
    monkeypatch.setattr(similar, "candidates", lambda nodes, pairs: nodes.sparkSession.createDataFrame([], "a bigint, b bigint"))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, df, "").collect()) == [0, 2, 3]
