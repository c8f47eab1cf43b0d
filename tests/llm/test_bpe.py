import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from musterroll.llm import bpe

DATA = open(bpe.RANKS, "rb").read()
SPLIT, WHOLE = bpe._encodings(DATA, P.PATTERN)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sT 1²é\n\t　 \x1c!?-", max_size=60), st.integers(1, 9))
def test_cut_texts_give_the_ids_of_the_whole(text, chunk):
    assert bpe.encode_text(text, SPLIT, WHOLE, chunk).tolist() == plain().encode_ordinary(text)
    assert SPLIT.decode_bytes(bpe.encode_text(text, SPLIT, WHOLE, chunk).tolist()) == text.encode()


@pytest.mark.parametrize("after", ["", "y", " y", "\n"])
@pytest.mark.parametrize("blank", [" ", "\n", "　"])
def test_long_blank_runs(blank, after):
    text = "x" + blank * 9000 + after
    assert bpe.encode_text(text, SPLIT, WHOLE, 100).tolist() == plain().encode_ordinary(text)


def test_runs_that_the_library_cannot_step_through():
    text = "x" + " " * 1_500_000 + "y"
    assert SPLIT.decode_bytes(bpe.encode_text(text, SPLIT, WHOLE).tolist()) == text.encode()


def test_rows(spark):
    texts = [None, "", "Hello world's <|endoftext|>", "a " * 70_000, "é" * 3000, "same", "same"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "no id", "x", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS ids", "1 AS n_tokens", "'k' AS key")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = plain().encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert set(bpe.tokenized(docs).columns) == {*docs.columns}
    assert bpe.digests(docs.limit(0)).collect() == []
