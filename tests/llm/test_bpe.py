import random

import public_tokenizers
import pytest
import tiktoken
from brute import sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daytrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
OWN = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and OWN.decode(ids) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "aab ", " \n", "0123456789", "!.-=", "theing", "漢字é😀", "abcdefghijklmnopqrstuvwxyz"])
def test_long_matches(alphabet):
    draw = random.Random(alphabet)
    for n in (50, 500, 5000):
        text = "".join(draw.choice(alphabet) for _ in range(n))
        assert OWN.encode(text) == LIBRARY.encode_ordinary(text)


def test_every_token_merges_to_itself():
    assert all(OWN.is_whole(t) for t in RANKS)


def test_join_is_associative_and_equals_merging():
    draw = random.Random(2)
    for _ in range(500):
        parts = [bytes(draw.choice(b"abcin gthe") for _ in range(draw.randint(0, 12))) for _ in range(3)]
        a, b, c = map(OWN.merged, parts)
        whole = OWN.merged(b"".join(parts))
        assert OWN.join(OWN.join(a, b), c) == OWN.join(a, OWN.join(b, c)) == whole


def test_tables(spark):
    rows = [(1, "Hello world's  end\n"), (2, None), (3, ""), (3, ""), (None, "é" * 3000), (4, "<|endoftext|> x" * 200)]
    docs = spark.createDataFrame([(k, t, "x", 5) for k, t in rows], "doc_id bigint, text string, ids string, _source int")
    there = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    back = bpe.decode(there, PATH).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r["ids"] == LIBRARY.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    both = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).select("doc_id", "text", bpe.ids_text(F.col("ids")).alias("said"), "decoded").collect()
    for r in both:
        assert sha(r.said) == sha(" ".join(map(str, LIBRARY.encode_ordinary(r.text or "")))) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ranks_without_all_bytes_are_refused():
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Encoder({b"a": 0}, ".")
