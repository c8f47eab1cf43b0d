"""SimHash near-dedup through an inverted index on positional bytes.

A 64-bit fingerprint has eight positional bytes.  Two that differ in at most
three bits share at least five of them, so five is the guaranteed minimum of
matches.  The index is keyed by five positions and their bytes: a pair that
shares t bytes meets in as many lists as there are ways to pick five of t, so
meeting at all means that its tally has reached the minimum.  Tallying lists
of single bytes instead would bring together a pair in every 32, and so grow
with the square of the input.  Pairs that meet are verified by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.llm.common import text_bytes
from musterroll.llm.components import components
from musterroll.runtime import written

SEED = 42


@dataclass(frozen=True)
class Settings:
    words: int = 3  # of a shingle
    bits: int = 3  # that linked fingerprints may differ in
    list_rows: int = 4096  # members of a list that are compared at once


def fingerprint_of(raw: bytes, size: int = 3) -> int:
    """Fingerprint of one text in UTF-8, as a signed 64-bit number.

    A bit is set if over half the hashes of the shingles have it, repeats
    counted; a text of fewer words has one shingle, one without words none.
    """
    words = raw.lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        high = min(n, low + (1 << 16))
        first = starts[low:high].tolist()
        last = ends[low + size - 1 : high + size - 1].tolist() if len(words) >= size else [len(joined)]
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """64-bit fingerprint of a text; 0 for a null text and one without words."""

    @F.arrow_udf("bigint")
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([fingerprint_of(raw.as_py(), size) for raw in batch], pa.int64())

    return made(text_bytes(text))


BITS = 64


def _postings(prints: DataFrame, width: int, agree: int) -> DataFrame:
    """``key, fp`` for every choice of ``agree`` blocks of ``width`` bits.

    The key is the hash of the choice's number and of the fingerprint with all
    other bits cleared.
    """
    block = (1 << width) - 1
    masks = [sum(block << (width * b) for b in c) for c in combinations(range(BITS // width), agree)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the absolute value


def linked_in_list(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what a list's pairs of at most so many differing bits connect."""
    left, right = [], []
    rest = members
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            at, front = front[0], front[1:]
            near = differing_bits(rest, at) <= bits
            found, rest = rest[near], rest[~near]
            left.append(np.full(len(found), at))
            right.append(found)
            front = np.concatenate([front, found])
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


class _Found:
    """Rows that a walk hands out, gathered until the end of a batch."""

    def __init__(self, bits: int):
        self.bits, self.parts = bits, []

    def links(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append((np.zeros(len(a), np.int64), np.ones(len(a), bool), a, b))

    def within(self, members: np.ndarray) -> None:
        self.links(*linked_in_list(members, self.bits))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        near = differing_bits(a, b) <= self.bits
        self.links(a[near], b[near])

    def whole(self, key: int, members: np.ndarray) -> None:
        self.parts.append((np.full(len(members), key), np.zeros(len(members), bool), members, members))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            key, linked, a, b = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            yield pa.record_batch([pa.array(key, mask=linked), pa.array(a), pa.array(b)], names=["key", "a", "b"])
            self.parts = []


def _scanned(postings: DataFrame, settings: Settings) -> DataFrame:
    """Walk the lists of ``postings`` in key order; returns ``key, a, b``.

    A row with a null key is a link.  A list above ``list_rows`` members is
    handed on whole, one row ``key, a, a`` for each: it needs finer keys.  A
    task holds one batch and one list of at most that size.
    """
    most, bits = settings.list_rows, settings.bits

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_key, held, large = _Found(bits), None, np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, members = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            sizes = np.diff(edges)
            # Only the first and the last list of a batch can reach across it.
            middle = np.arange(1, len(sizes) - 1)
            two = edges[middle[sizes[middle] == 2]]
            out.pairs(members[two], members[two + 1])
            for k in [0, *middle[sizes[middle] > 2].tolist(), len(sizes) - 1][: 1 if len(sizes) == 1 else None]:
                part, key = members[edges[k] : edges[k + 1]], keys[edges[k]]
                if key == open_key:
                    held = np.concatenate([held, part])
                else:
                    if large:
                        out.whole(open_key, held)
                    else:
                        out.within(held)
                    open_key, held, large = key, part, False
                if large or len(held) > most:
                    out.whole(key, held)
                    held, large = held[:0], True
            yield from out.rows()
        if not large:
            out.within(held)
        yield from out.rows()

    dealt = postings.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(walk, "key bigint, a bigint, b bigint")


def links_of(prints: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp``, enough to connect all that differ in few bits.

    Fingerprints in lists above ``list_rows`` members are keyed again by four
    bits at a time: of sixteen such blocks all but ``bits`` agree.  With three
    bits a finer list shares 52 bits, so it has 4,096 members at most.
    """
    scanned = written(_scanned(_postings(prints, 8, BITS // 8 - settings.bits), settings), "simhash-lists")
    links = scanned.filter(F.col("key").isNull()).select("a", "b")
    large = scanned.filter(F.col("key").isNotNull()).select(F.col("a").alias("fp"))
    if not large.isEmpty():
        whole = Settings(settings.words, settings.bits, 1 << (4 * settings.bits))
        rest = written(_scanned(_postings(large.distinct(), 4, BITS // 4 - settings.bits), whole), "simhash-finer")
        links = links.unionByName(rest.filter(F.col("key").isNull()).select("a", "b"))
    return links


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for every row of ``docs (doc_id, text)``.

    Exact copies share a fingerprint and are reduced to it before anything is
    compared.  ``component_id`` is the smallest id reachable over links, the
    row's own included; a component of rows without ids has none, and is told
    by ``root``, its smallest fingerprint.  Rows that repeat give a row each.
    Empty and null texts have fingerprint 0, which links like any other.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text"), settings.words).alias("fp"))
    marked = written(rows, "simhash-prints")
    prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    rooted = components(links_of(prints.select("fp"), settings))
    classes = prints.join(rooted, prints["fp"] == rooted["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = written(classes.join(least, "root").select("fp", "root", "component_id"), "simhash-classes")
    return marked.join(by_print, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of ``docs`` per component, with all its columns.

    That is the row with the smallest id (rows without an id come last), and
    of rows that repeat it, one.
    """
    return first_of_each(docs, near_duplicates(docs.select("doc_id", "text"), settings))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first row of ``docs`` for each ``root`` of ``found (doc_id, text_hash, root)``."""
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))).alias("k")
    kept = written(found.groupBy("root").agg(first).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash")), "simhash-kept")
    rows = docs.withColumn("__text_hash", F.xxhash64("text"))
    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    return rows.join(kept, here, "left_semi").dropDuplicates(["doc_id", "__text_hash"]).select(*docs.columns)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
