import random
import re

from brute import line_dedup

from daytrace.llm import linededup


def run(spark, rows):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, n_lines int, _key string")
    return linededup.dedup_lines(df).collect()


def test_against_plain_python(spark):
    draw = random.Random(3)
    docs = [(i, "\n".join(draw.choice("abcde") * draw.randint(1, 2) for _ in range(draw.randint(0, 30)))) for i in range(200)]
    got = {r.doc_id: r for r in run(spark, docs)}
    want = line_dedup(docs)
    assert {k: r.text for k, r in got.items()} == want
    for k, t in docs:
        kept = 0 if got[k].n_removed == len(t.split("\n")) else len(want[k].split("\n"))
        assert got[k].n_lines == len(t.split("\n")) and got[k].n_removed == len(t.split("\n")) - kept


def test_nulls_copies_blank_lines_and_no_rows(spark):
    passage = "one\ntwo\nthree\nfour"
    rows = [(5, passage), (7, passage), (None, passage), (8, None), (9, ""), (10, "\n\n\n\n"), (11, "\n\n\n\n"), (12, "a\nb"), (13, "a\nb")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in run(spark, rows)}
    assert got[5] == (passage, 4, 0) and got[7] == ("", 4, 4) and got[None] == ("", 4, 4)
    assert got[8] == (None, 0, 0) and got[9] == ("", 1, 0) and got[11] == ("\n\n\n\n", 5, 0) and got[13] == ("a\nb", 2, 0)
    again = run(spark, [(1, passage), (1, passage), (2, "x\n" + passage)])
    assert sorted((r.doc_id, r.text) for r in again) == [(1, passage), (1, passage), (2, "x")]
    assert run(spark, []) == []


def test_runs_of_equal_lines_and_long_texts(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    got = {r.doc_id: r for r in run(spark, [(1, "a\n" * 9 + "a"), (2, long), (3, "x\n" + long + "\ny")])}
    assert got[1].text == "a" and got[2].text == long and got[3].text == "x\ny"


def test_passage_of_one_line_stays_when_its_neighbours_differ(spark):
    got = {r.doc_id: r.text for r in run(spark, [(1, "a\nP\nb"), (2, "c\nP\nd")])}
    assert got == {1: "a\nP\nb", 2: "c\nP\nd"}


def plain_sentences(docs):
    seen, out = set(), {}
    for key, text in sorted(docs):
        cut = re.split("(" + linededup.SENTENCES + ")", text)
        lines, between, gone = cut[::2], cut[1::2], set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p : p + 3])
            if "".join(window).strip(" "):
                gone |= {p, p + 1, p + 2} if window in seen else set()
                seen.add(window)
        new, last = "", None
        for p in sorted(set(range(len(lines))) - gone):
            if last is not None:
                new += "\n" if p > last + 1 and "\n" in between[last:p] else between[p - 1]
            new, last = new + lines[p], p
        out[key] = new
    return out


def test_passages_inside_one_line_go_with_sentences(spark):
    passage = "One two three. Four five six! Seven eight nine? Ten."
    docs = [(1, "Start here. " + passage + " The end\nis near."), (2, "Other.  " + passage + "  More.\nLast"), (3, "x\n" + passage + "\ny")]
    draw = random.Random(4)
    for i in range(10, 150):
        said = [draw.choice("abc") * draw.randint(1, 2) + draw.choice([". ", "!  ", "\n", ".\n", " ", "\u3002"]) for _ in range(draw.randint(0, 20))]
        docs.append((i, "".join(said)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(df, ends=linededup.SENTENCES).collect()}
    assert got[1].text == docs[0][1] and got[2].text == "Other.  More.\nLast"
    assert got[3].text == "x\ny" and got[3].n_removed == 4
    assert {k: r.text for k, r in got.items()} == plain_sentences(docs)


def test_stage_takes_passages_inside_one_line(spark):
    import corpus_pipeline

    passage = "One two three. Four five six! Seven eight nine?"
    rows = [(1, "a " + passage), (2, "Here. " + passage), (3, "There. " + passage + " End.")]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.without_repeated_lines(spark, df, "").collect()}
    assert got[1][0] == rows[0][1] and got[3] == ("There. End.", 11)
