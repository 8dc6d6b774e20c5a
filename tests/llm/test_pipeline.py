"""Each stage of the pipeline on its own input, against plain statements of what it does."""

import random

import corpus_pipeline
import public_tokenizers
import tiktoken
from brute import LOWER, contamination, groups, line_dedup

from daytrace.llm import bpe

WORDS = [a + b for a in ("ran", "tel", "mor", "vis", "con", "der") for b in ("ting", "ber", "ion", "ed", "al", "os", "um")]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture(spark, folder):
    draw = random.Random(9)
    say = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    passage = "\n".join(say(15) for _ in range(4))
    item = say(30)
    docs, toxic = [], set()
    for i in range(240):
        lines = [say(draw.randint(8, 20)) for _ in range(draw.randint(3, 8))]
        if i % 6 == 0:
            toxic.add(i)
            lines = [x + " grumblefink snotwaddle nincompoop" for x in lines]
        if i % 7 == 1:
            lines.insert(1, passage)
        if i % 10 == 3:
            lines.append(item)
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", None))
    base = say(300)
    docs += [(300 + i, base + (" " + say(1) if i else ""), "en", None, None) for i in range(6)] + [(400, None, None, None, None), (401, "", "", "", 0), (402, docs[5][1], "en", "s", None)]
    docs = [(k, t, lang, s, None if t is None else len(t)) for k, t, lang, s, _ in docs]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, say(40)), (3, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return toxic, item


def shingles(text):
    """Five-word shingles of a text, of the whole if it is shorter; none of a text without words."""
    words = (text or "").translate(LOWER).split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_stages(spark, tmp_path):
    toxic, item = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{n}")
        docs = spark.read.parquet(f"{tmp_path}/out{n}")
        after = {r.doc_id: r for r in docs.collect()}
        assert n == 4 or docs.columns == COLUMNS
        assert docs.count() == len(after)
        seen[name] = (before, after)
    before, after = seen["toxicity"]
    assert set(before) - set(after) == toxic
    before, after = seen["line_dedup"]
    assert {k: r.text for k, r in after.items()} == line_dedup([(k, r.text) for k, r in before.items()])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.lang, r.source) == (before[k].lang, before[k].source) for k, r in after.items())
    assert any(r.text != before[k].text for k, r in after.items())
    before, after = seen["near_dedup"]
    keys = sorted(before)
    sets = [shingles(before[k].text) for k in keys]
    want = {keys[i] for i in groups(sets, lambda x, y: 5 * len(x & y) >= 4 * len(x | y))}
    assert set(after) == want and len(want) < len(keys) and all(after[k] == before[k] for k in after)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    assert set(after) == {k for k, r in before.items() if not contamination(r.text, items)[3]} and len(after) < len(before)
    before, after = seen["tokens"]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(after) == set(before)
    for r in after.values():
        assert r["ids"] == library.encode_ordinary(r.text or "") and r.decodes and r.n_tokens == len(r["ids"])


def test_run_is_the_chain_of_stages(spark, tmp_path):
    fixture(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() > 100 and set(COLUMNS) < set(rows.columns)
