"""The audit of sources against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from musterroll.llm import divergence

TERM = re.compile(divergence.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string"


def rows():
    rng = random.Random(5)
    word = lambda k: f"t{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}"
    out = []
    for i in range(420):
        words = [word(int(rng.choice([40, 150, 300]) * rng.random() ** 2)) for _ in range(rng.randint(0, 60))]
        if i % 11 == 0:
            words = [w.upper() for w in words]
        out.append((" ,1".join(words), ["en", "en", "fr", None][i % 4], [f"s{i % 9}", None, ""][min(2, i % 13)]))
    out += [out[3]] * 60  # repeated rows
    out += [(None, "en", "only null"), ("", "en", "only empty"), ("123 !!", "en", "no terms"), ("rare words here", "de", "a"), ("rarer", "de", "b")]
    out += [("éKK " * 40, "fr", "\U0001f600")] * 35 + [("x " * 20_000, "fr", "￮")]
    return out


def plain(docs, least=30, ranks=50):
    counts, holders = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        holders[lang or ""].update(set(words))
    out = []
    for lang in holders:
        kept = [t for t, n in holders[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        total = Counter()
        for c in groups.values():
            total.update(c)

        def shares(c):
            words = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (words + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(total)
        for s, c in groups.items():
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (value, item) in enumerate(found[:most])]
    return Counter(out)


@pytest.mark.parametrize("settings", [divergence.Settings(), divergence.Settings(held=10, dealt=5, sources=2), divergence.Settings(documents=1, ranks=3, sources=4)])
def test_against_a_plain_count(spark, settings):
    docs = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit("clash") for c in ("term", "n", "chunk", "bits", "p", "item", "value", "rank", "i", "j")})
    got = divergence.audit(docs, settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(rows(), settings.documents, settings.ranks)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chunks_hold_at_most_64_terms(spark):
    kept = spark.range(3000).selectExpr("'en' AS lang", "concat('t', id) AS term", "1 + id % 7 AS total")
    found = divergence._in_chunks(kept, divergence.Settings(dealt=500)).groupBy("chunk").agg(F.count("*").alias("n"), F.countDistinct("bit").alias("d"), F.max("bit").alias("b"))
    assert all(r.n == r.d <= 64 and r.b == r.n - 1 for r in found.collect())


def test_counts_beyond_64_bits(spark):
    n = 9_000_000_000_000_000
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first().p
    assert got == 1 + 1000000000 * (n + 5) // (3 * n + 35)


def test_joint_cells_by_complement():
    rng = np.random.default_rng(0)
    size, counts = 64, rng.integers(0, 4, (3, 64))
    group, share, bits, rest = [], [], [], []
    for g in range(3):
        for n in range(4):
            group.append(g)
            share.append(100 * g + 7 * n * n)
            rest.append(n == 0)
            bits.append(0 if n == 0 else sum(1 << int(t) for t in np.flatnonzero(counts[g] == n)))
    every = np.ones(12, bool)
    a, b, sums = divergence.joint_sums(np.array(group), np.array(share), np.array(bits, np.uint64), np.array(rest), size, every, every)
    p = np.array([[100 * g + 7 * n * n for n in counts[g]] for g in range(3)])
    assert sums.tolist() == [[int(np.abs(p[i] - p[j]).sum()) for j in range(3)] for i in range(3)]
