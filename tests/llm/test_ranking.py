"""Ranked search against brute force, and the bounds that let blocks be skipped."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from musterroll.llm import ranking

TERM = re.compile(ranking.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, words=300):
    return " ".join(f"w{int(words * rng.random() ** 3)}" for _ in range(n))


def rows():
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.randint(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # copies: ties, to the smaller id
    docs += [(7, docs[7][1]), (None, docs[7][1]), (None, None), (500, None), (501, ""), (502, " ,;\x00 "), (503, "W1,w2;Éß x3"), (504, "w1 " * 30_000)]
    items = [(i, prose(rng, rng.randint(1, 30))) for i in range(25)]
    items += [(1, "w1 w1 w2 Éß"), (30, None), (31, ""), (32, "nowhere"), (33, "w0 w0 w0 w1"), (33, "w0 w0 w0 w1")]
    return docs, items


def plain(docs, items, k):
    split = lambda t: Counter(TERM.findall((t or "").translate(LOWER)))
    held = [(i, split(t)) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for place, (i, c, n) in enumerate(held):
            m = 25 + 75 * n * n_docs // length
            score = 0
            for t, q in split(text).items():
                if t in c:
                    score += q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, place, i))
        out += [(item, r + 1, s[-1], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return Counter(out)


SCHEMAS = "doc_id bigint, text string", "item_id bigint, text string"


@pytest.mark.parametrize(
    "settings",
    [ranking.Settings(), ranking.Settings(shard_postings=400, block=3), ranking.Settings(shard_postings=2000, block=1, k=3), ranking.Settings(query_postings=60, block=8)],
)
def test_against_brute_force(spark, settings):
    docs, items = rows()
    frames = [spark.createDataFrame(r, s).withColumns({c: F.lit("clash") for c in ("row", "n", "term", "tf", "id", "shard", "score", "rank")}) for r, s in zip((docs, items), SCHEMAS)]
    got = ranking.top_documents(*frames, settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain(docs, items, settings.k)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(r, s) for r, s in zip(rows(), SCHEMAS))
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs.filter("text = ''"), items)):
        assert ranking.top_documents(a, b).collect() == []


def test_blocks_are_skipped_and_summaries_bound_their_documents():
    rng = np.random.default_rng(2)
    n_docs, areas, topics = 4000, 5, 8
    doc, term, part = [], [], []
    for d in range(n_docs):
        area, topic = d % areas, d // areas % topics
        own = 10_000 + 1000 * area + 40 * topic + rng.choice(40, 12, replace=False)
        terms = np.concatenate([own, 100 * area + rng.choice(30, 8, replace=False)])
        doc += [d] * len(terms)
        term += terms.tolist()
        part += rng.integers(500_000, 1_000_000, len(terms)).tolist()
    shard = ranking.Shard(np.array(doc), np.array(term), np.array(part), ranking.Settings(block=8))
    number = {int(t): i for i, t in enumerate(shard.terms)}
    queries = []
    for q in range(30):
        area, topic = q % areas, q % topics
        some = [*(10_000 + 1000 * area + 40 * topic + rng.choice(40, 3, replace=False)), *(100 * area + rng.choice(30, 5, replace=False))]
        at = np.array(sorted(number[t] for t in some))
        queries.append((at, np.full(len(at), 3000)))
    found, (met, skipped) = ranking.search(shard, queries, np.zeros(30, np.int64), 10)
    for (q, docs, scores), (terms, weights) in zip(found, queries, strict=True):
        every = shard.scores(np.arange(n_docs), terms, weights)
        best = np.lexsort((np.arange(n_docs), -every))[:10]
        assert docs.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
    assert skipped > met // 3 > 0
    again, (met2, _) = ranking.search(shard, queries, np.array([s[-1] for _, _, s in found]), 10)
    assert [(d.tolist(), s.tolist()) for _, d, s in again] == [(d.tolist(), s.tolist()) for _, d, s in found] and met2 <= met

    vectors = shard.projected(np.ones(shard.n_terms, np.int64))
    t = shard.n_terms - 1  # the commonest
    docs, starts = shard.blocks(t, vectors)
    assert sorted(docs.tolist()) == sorted(shard.list_docs[shard.list_start[t] :].tolist()) and len(starts) > 10
    summary = shard.summaries(t, docs, starts, np.arange(shard.n_terms), shard.n_terms)
    for b, (low, high) in enumerate(zip(starts, [*starts[1:], len(docs)])):
        want = np.max([shard.scores(docs[low:high], np.array([t]), np.array([1]))], axis=1)
        assert summary[b, t] == want[0] and summary[b].max() == summary[b, t]
