import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from daytrace.llm import interactions


def plain(docs, labels):
    """The rows of the audit by walking each order; docs: (id, text, source)."""
    good = {k for k, q, t in labels if q == 1 and k is not None}
    bad = {k for k, q, t in labels if t == 1 and k is not None}
    rows = []
    for k, text, source in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = set()
        if len(words) < 3:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if "#" in text:
            fails.add("D")
        if k is not None and any(o is not None and o < k and (t or "") == text for o, t, _ in docs):
            fails.add("E")
        rows.append((k, source or "", fails))
    out = {}
    for part in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == part]
        removed_by = dict.fromkeys("ABDE", 0)
        for order in permutations("ABDE"):
            alive = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in alive if f in r[2]]
                failing = sum(f in r[2] for r in mine)
                alive = [r for r in alive if f not in r[2]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), failing - len(gone), sum(r[2] == {f} for r in mine), sum(r[0] in good for r in gone), sum(r[0] in bad for r in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, source string, part string, rows int")
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    words = interactions.words_of(F.col("text"))
    conditions = {"A": F.size(words) < 3, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), "D": F.contains("text", F.lit("#"))}
    got = interactions.audit(df, said, conditions, copied="E").collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_every_order_by_walking_it(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["a", "b", "c", "#", "d\te"]) for _ in range(draw.randint(0, 6))) for _ in range(25)]
    docs = [(k, draw.choice(texts), draw.choice(["s", "t", None, ""])) for k in draw.sample(range(1000), 120)]
    labels = [(d[0], draw.choice([0, 1, None]), draw.choice([0, 1, None])) for d in docs if draw.random() < 0.7]
    assert audited(spark, docs, labels) == plain(docs, labels)


def test_nulls_repeated_rows_and_repeated_labels(spark):
    docs = [(1, None, "s"), (2, "", None), (2, "", None), (2, "a b c d", "s"), (None, "", "s"), (None, "", "s"), (3, "a b c d", "u"), (3, "a b c d", "u")]
    labels = [(2, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 1), (3, 1, 1)]
    assert audited(spark, docs, labels) == plain(docs, labels)
    assert audited(spark, docs, []) == plain(docs, [])


def test_nothing_fails_and_empty_table(spark):
    docs = [(1, "a b c", "s"), (2, "a b d", "t")]
    got = audited(spark, docs, [])
    assert got == plain(docs, []) and all(v[0] == 1 and sum(v[1:]) == 0 for v in got.values())
    assert audited(spark, [], []) == {}


def test_one_text_holds_most_rows(spark):
    docs = [(k, "same same # text", "s") for k in range(400)] + [(1000 + k, f"text number {k}", "s") for k in range(50)]
    assert audited(spark, docs, [(5, 1, 1)]) == plain(docs, [(5, 1, 1)])


def test_very_long_text(spark):
    docs = [(1, "word " * 200_000, "s"), (2, "x" * 1_000_000, "s")]
    assert audited(spark, docs, []) == plain(docs, [])
