import random
import zlib

import numpy as np
import pytest

from daytrace.llm import toxicity

INSULTS = ["grumblefink", "snotwaddle", "blatherskite", "nincompoop"]
PLAIN = [a + b for a in ("ran", "tel", "mor", "vis", "con", "der", "lis") for b in ("ting", "ber", "ion", "ed", "al", "os", "ume")]


def text(draw, toxic):
    words = [draw.choice(PLAIN) for _ in range(draw.randint(20, 60))]
    if toxic:
        for _ in range(draw.randint(2, 5)):
            words[draw.randrange(len(words))] = draw.choice(INSULTS)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def model():
    draw = random.Random(4)
    return toxicity.fit([toxicity.Sample(int(i % 5 == 0), sorted(toxicity.text_units(text(draw, i % 5 == 0)))) for i in range(600)])


def test_held_out_texts(model):
    draw = random.Random(5)
    labels = [i % 4 == 0 for i in range(200)]
    scores = toxicity._scores(model, [text(draw, y) for y in labels])
    assert ((scores >= 0.5) == labels).mean() > 0.96


def test_gapped_and_inserted_insults(model):
    plain = "ranting telber morion vised conal "
    forms = ["g.r.u.m.b.l.e.f.i.n.k snot-waddle", "g r u m b l e f i n k and n i n c o m p o o p", "grumblxefink snotwaddlle", "NINCOMPOOP! *blatherskite*"]
    assert (toxicity._scores(model, [plain + f for f in forms]) >= 0.5).all()
    assert (toxicity._scores(model, [plain * 3, "", None, "...", "a b c"]) < 0.5).all()


def brute(s, t, order, decay):
    """Sum over common subsequences of decay to the spans in both, by all index tuples."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_against_its_definition():
    draw = random.Random(6)
    strings = ["^" + "".join(draw.choice("abcd.") for _ in range(draw.randint(2, 7))) for _ in range(12)]
    others = ["^abca", "^dc.b"]
    got = toxicity.Kernel(others)(strings)
    for i, s in enumerate(strings):
        for j, t in enumerate(others):
            parts = []
            for order in toxicity.ORDERS:
                k = lambda a, b: brute(a, b, order, toxicity.DECAY)  # noqa: B023, E731
                parts.append(k(s, t) / np.sqrt(max(k(s, s), 1e-12) * max(k(t, t), 1e-12)))
            assert abs(got[i, j] - (sum(parts) / len(parts)) ** toxicity.POWER) < 1e-4


def test_tables(spark, model):
    draw = random.Random(7)
    rows = [(i, text(draw, i % 5 == 0), "x", 1) for i in range(300)] + [(None, None, None, None), (1000, "", "", 1), (1001, "word " * 60_000, "", 1), (1001, "word " * 60_000, "", 1), (1002, "z" * 90_000, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, label int")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, None), (7, 9), (10**6, 1)], "doc_id bigint, toxic int")
    sample = toxicity.sampled(docs, labels, "doc_id", "text", "toxic")
    assert len(sample) == 300 and len(toxicity.sampled(docs, labels, "doc_id", "text", "toxic", texts=40)) <= 40
    got = toxicity.score(docs, toxicity.fit(sample)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in got if r.doc_id is not None and r.doc_id < 300) > 295
    assert {r.predicted for r in got if r.doc_id is None or r.doc_id >= 1000} == {0}
    assert toxicity.kept(docs, toxicity.fit(sample)).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fit_without_both_labels_calls_nothing_toxic():
    for sample in ([], [(1, ["bad"])], [(0, ["good"])], [(1, []), (0, [])]):
        assert (toxicity._scores(toxicity.fit([toxicity.Sample(*s) for s in sample]), ["bad", None]) < 0.5).all()


def test_copies_do_not_make_a_word_toxic():
    draw = random.Random(8)
    bad = text(draw, True) + " oncewritten unheardof"
    texts = [(1, bad + f" {w}") for w in PLAIN[:20]] + [(int(i % 5 == 0), text(draw, i % 5 == 0)) for i in range(400)]
    found = toxicity._speaking(*([toxicity.Sample(y, sorted(toxicity.text_units(t)), toxicity.sketch(t)) for y, t in texts if y == k] for k in (1, 0)))
    assert set(INSULTS) <= set(found) and not {"oncewritten", "unheardof"} & set(found)


def test_held_out_rule(spark):
    from pyspark.sql import functions as F

    from daytrace.llm.queries import held_out

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_margins_are_remembered_in_few_bytes_and_those_of_another_step_are_dropped(monkeypatch):
    from daytrace.llm import bpe, common

    monkeypatch.setattr(common, "_HELD", {})
    model = toxicity.Model(("^vile", "^calm"), (1.0, -1.0), -0.1, (4.0, 1.0, 1.0, -2.0))
    texts = [f"vile{i} calm{i % 7} word{i}" for i in range(300)] + ["", None]
    first = toxicity._scores(model, texts)
    ranks = {bytes([b]): b for b in range(256)}
    (_, known) = common.held("toxicity")[model]
    assert len(known) == 607 and known.marks.nbytes + known.values.nbytes == 24 * 607
    monkeypatch.setattr(toxicity, "margins", lambda *_: 1 / 0)
    assert (toxicity._scores(model, texts[::-1])[::-1] == first).all()
    bpe._encoder(ranks, ".")
    assert list(common._HELD) == ["bpe"]
