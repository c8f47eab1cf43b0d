"""Packed sequences against plain encoding, and the deficits of the queues."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from musterroll.llm import packing

SCHEMA = "doc_id bigint, source string, text string"
LIBRARY = tokenizers.Tokenizer.from_file(packing.MODEL)
LIBRARY.encode_special_tokens = True
ENCODER = packing.Encoder(open(packing.MODEL).read(), 50)


def plain(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


@limits(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'sTé1²×ñ\x01_.\n\t　 \x1c\x85​!?-<|", max_size=40), max_size=4))
def test_parts_give_the_ids_of_the_whole(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(pa.array(texts, pa.string()))] == [plain(t)[:-1] for t in texts]


def test_long_runs():
    for text in (" " * 200_000 + "x", "x" * 50_000, "\n" * 100_001, "ab " * 50_000, "<|endoftext|> a<|endoftext|>"):
        assert np.frombuffer(ENCODER.encode(pa.array([text]))[0], "<u4").tolist() == plain(text)[:-1]


def checked(spark, rows, settings=packing.Settings()):
    """Pieces of ``rows``, after all that must hold for them."""
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "ids", "at", "window", "start", "tokens", "n_tokens")})
    found = packing.packed(docs, settings).collect()
    ids_of, pieces = defaultdict(list), defaultdict(list)
    for i, _, text in rows:
        ids_of[i].append(plain(text))
    for r in found:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids_of)
    for i, whole in ids_of.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, whole))
        spans = Counter((r.start, r.length, r.doc_tokens, zlib.crc32(bytes(r.ids))) for r in pieces[i])
        if len(whole) == 1:  # pieces of one document follow each other
            at = 0
            for start, length, tokens, crc in sorted(spans):
                assert (start, tokens) == (at, len(whole[0])) and crc == zlib.crc32(np.array(whole[0][at : at + length], "<u4").tobytes())
                at += length
        assert sum(n for _, n in spans.items()) == len(pieces[i])
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append(r)
    sizes = []
    for s in range(len(by_sequence)):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and len(r.ids) == 4 * r.length
            at += r.length
        sizes.append(at)
    total = sum(len(w) for some in ids_of.values() for w in some)
    full = total // settings.sequence
    assert sizes[:full] == [settings.sequence] * full and sum(sizes) == total
    assert all(n & (n - 1) == 0 for n in sizes[full:]) and len(set(sizes[full:])) == len(sizes[full:])  # no padding at all
    return found


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n))


ROWS = [
    (1, "a", prose(1, 900)), (2, "a", None), (3, None, ""), (4, "b", prose(4, 20)), (5, "b", "same"), (5, "b", "same"), (6, "b", "same"),
    (None, "b", prose(7, 30)), (None, None, "x"), (8, "c", prose(8, 6000)), (9, "\U0001f600", " é  \x1c"), (10, "", "an empty source"),
]


@pytest.mark.parametrize(
    "settings", [packing.Settings(), packing.Settings(sequence=64, window=4, piece=8), packing.Settings(sequence=32, window=2, piece=1, weights=(("c", 3.0), ("", 0.5)))]
)
def test_awkward_rows(spark, settings):
    checked(spark, ROWS, settings)


def test_empty_table_and_lone_rows(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [(r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in checked(spark, [(1, None, None)])] == [(0, 1, 1, 0, 0)]


def test_every_window_has_the_target_proportions(spark):
    rows = [(i, ["big", "mid", "low"][i % 7 % 3], prose(i, 20 + i % 90)) for i in range(700)]
    rows += [(1000 + i, "tiny", prose(i, 10)) for i in range(4)]
    settings = packing.Settings(sequence=64, window=16, piece=32)
    found = checked(spark, rows, settings)
    source = {i: s for i, s, _ in rows}
    total, per_window = Counter(), defaultdict(Counter)
    for r in found:
        total[source[r.doc_id]] += r.length
        per_window[r.sequence_id // settings.window][source[r.doc_id]] += r.length
    size = settings.sequence * settings.window
    for w in range(max(per_window)):
        for s in ("big", "mid", "low"):
            assert abs(per_window[w][s] / size - total[s] / sum(total.values())) < 2 * settings.piece / size
    # The small source saves its deficit up, and is not cut to single tokens.
    pieces = [r.length for r in found if source[r.doc_id] == "tiny"]
    assert len(pieces) <= 4 + total["tiny"] // settings.piece + len(pieces) // 2 and np.mean(pieces) > 8


def test_given_weights_hold_until_a_source_is_used_up(spark):
    rows = [(i, "a" if i % 2 else "b", prose(i, 60)) for i in range(400)]
    settings = packing.Settings(sequence=64, window=16, piece=16, weights=(("a", 3.0), ("b", 1.0)))
    source, per_window = {i: s for i, s, _ in rows}, defaultdict(Counter)
    for r in checked(spark, rows, settings):
        per_window[r.sequence_id // 16][source[r.doc_id]] += r.length
    share = [c["a"] / sum(c.values()) for _, c in sorted(per_window.items())]
    cut = int(len(share) * 0.6)
    assert all(abs(x - 0.75) < 0.02 for x in share[:cut]) and share[-2] < 0.01


def test_one_source_without_ids_and_equal_rows_holds_most(spark):
    rows = [(None, "hot", "equal words " * 20)] * 600 + [(i, f"s{i % 5}", prose(i, 30)) for i in range(200)]
    checked(spark, rows, packing.Settings(sequence=128, window=8, piece=16))
