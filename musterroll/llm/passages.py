"""Substring dedup: MinHash banding over paragraphs that begin at content-chosen words.

Repeated passages begin and end anywhere in a line, so paragraphs are not cut
at line ends.  Anchors are the smallest hashes of five-word shingles in every
``spread`` neighbouring ones; they depend on nearby words only, so a passage
has the same anchors wherever it stands.  A paragraph is the ``length`` words
from an anchor on.  A passage of ``length`` + ``spread`` - 1 words (51) holds
a whole paragraph for certain.

Paragraphs that share too few of their smallest shingles with other documents
have no similar one there and drop out first.  The others are reduced to
distinct ones, banded by MinHash, verified by exact Jaccard where they
collide, and clustered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import text_bytes
from musterroll.llm.components import components
from musterroll.runtime import short_lived, shuffles_released, written

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5  # words
    similarity: float = 0.8
    recall: float = 0.999  # of pairs at that similarity, by banding
    permutations: int = 32  # at most
    length: int = 32  # words of a paragraph
    spread: int = 20  # shingles of which one is an anchor at least
    list_rows: int = 1024  # paragraphs of a list that are compared in one go


def tuned_bands(similarity: float, recall: float, permutations: int) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which pairs at ``similarity`` still meet with ``recall``."""
    best = (permutations, 1)
    for rows in range(1, permutations + 1):
        missed = 1 - similarity**rows
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(missed))) if missed > 0 else 1
        if bands * rows <= permutations:
            best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIXER
    return x ^ (x >> np.uint64(27))


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of so many words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + hashes[k : k + n]
    return _mixed(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _repeats(shingles: np.ndarray) -> bool:
    ordered = np.sort(shingles)
    return bool((ordered[1:] == ordered[:-1]).any())


def _slid(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = of(values[:-step], values[step:])
        reach += step
    return values


def anchors_of(shingles: np.ndarray, spread: int, last: int) -> np.ndarray:
    """Places of the anchors up to ``last``, ascending; equal neighbours count once in ``spread``."""
    if len(shingles) < 1 or last < 0:
        return np.zeros(0, np.int64)
    width = min(spread, len(shingles))
    if not _repeats(shingles):
        # A shingle is the least of some window where the largest of its windows' minima is itself.
        least = _slid(shingles, width, np.minimum)
        around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_slid(around, width, np.maximum) == shingles)
        return chosen[chosen <= last]
    chosen = np.empty(0, np.int64)
    for low in range(0, len(shingles) - width + 1, 1 << 18):
        view = np.lib.stride_tricks.sliding_window_view(shingles[low : low + (1 << 18) + width - 1], width)
        chosen = np.union1d(chosen, np.argmin(view, axis=1) + np.arange(len(view)) + low)
    out, before, at = [], None, -spread
    for place, value in zip(chosen.tolist(), shingles[chosen].tolist(), strict=True):
        if place <= last and (value != before or place - at >= spread):
            out.append(place)
            before, at = value, place
    return np.array(out, np.int64)


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # bytes: A-Z and the six blanks only


def _at(hashes: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of so many words at each place."""
    out = np.zeros(len(places), np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + hashes[places + k]
    return _mixed(out)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in a UTF-8 text, in code points."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edges = np.diff(inside)
    if raw.isascii():
        return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return points[np.flatnonzero(edges == 1)], points[np.flatnonzero(edges == -1)]


_DOCUMENT = (
    "doc_id bigint, text_hash int, places array<int>, starts array<int>, ends array<int>, paragraphs array<bigint>,"
    " groups array<int>, small array<boolean>, picks array<int>, keys array<bigint>, small_keys array<bigint>"
)


def least_shared(settings: Settings) -> tuple[int, int]:
    """(kept, shared): of their ``kept`` smallest shingles, two similar paragraphs have ``shared`` in common.

    A set of n shingles lacks at most n - ceil(similarity * n) of a similar
    one's, so both have one among so many and one more (prefix filtering).  Sets
    of all shingles but one at most have ``shared``; smaller ones, in which
    shingles repeat, have one with any other.
    """
    n, s = settings.length - settings.shingle + 1, settings.similarity
    up = lambda x: math.ceil(x - 1e-9)
    kept = n - up(s * n) + 1
    shared = min(kept - a + up(s / (1 + s) * (a + b)) for a, b in ((n, n), (n, n - 1), (n - 1, n - 1)))
    return kept, max(1, shared)


def _picked(shingles: np.ndarray, at: np.ndarray, n: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``kept`` smallest distinct ones of the ``n`` shingles from each place on (-1: fewer), and whether two or more repeat."""
    picks, small = np.full((len(at), kept), -1, np.int64), np.zeros(len(at), bool)
    for low in range(0, len(at), 1 << 14):
        some = at[low : low + (1 << 14)]
        window = shingles[some[:, None] + np.arange(n)]
        order = np.argsort(window, axis=1)
        window = np.take_along_axis(window, order, axis=1)
        again = window[:, 1:] == window[:, :-1]
        picks[low : low + len(some)] = some[:, None] + order[:, :kept]
        small[low : low + len(some)] = again.sum(axis=1) > 1
        for k in np.flatnonzero(again.any(axis=1)).tolist():
            own = order[k][np.append(True, ~again[k])][:kept]
            picks[low + k] = -1
            picks[low + k, : len(own)] = some[k] + own
    return picks, small


def _groups(shingles: np.ndarray, at: np.ndarray, settings: Settings) -> np.ndarray:
    """A number for each anchor of a text; paragraphs of the text that are similar, or linked by such, have the same.

    Where no shingle repeats, overlapping paragraphs are similar up to a known
    distance.  All paragraphs with a shingle that the text repeats are one group.
    """
    n, s = settings.length - settings.shingle + 1, settings.similarity
    repeats = _repeats(shingles)
    reach = least_shared(settings)[0] - 1 if repeats else math.floor(n * (1 - s) / (1 + s) + 1e-9)
    groups = np.append(0, np.cumsum(np.diff(at) > reach))
    if repeats:
        _, inverse, counts = np.unique(shingles, return_inverse=True, return_counts=True)
        seen = np.append(0, np.cumsum(counts[inverse] > 1))
        hit = np.zeros(groups[-1] + 1, bool)
        hit[groups[seen[at + n] > seen[at]]] = True
        if hit.any():
            groups = np.where(hit[groups], np.argmax(hit), groups)
    return groups


def _document_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """One row for each document that has anchors: the paragraphs from them, and the smallest shingles of these.

    ``starts`` and ``ends`` are spans in code points, ``keys`` are shingles, and
    ``picks`` tells where each paragraph's smallest shingles are in ``keys``.
    """
    n, kept = settings.length - settings.shingle + 1, least_shared(settings)[0]

    def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have, counts, widths, all_words, all_shingles = [], [], [], [], []
            found: list[tuple[np.ndarray, ...]] = []
            before = before_words = 0
            for k, raw in enumerate(batch.column(2)):
                data = raw.as_py()
                words = word_hashes(_words(data))
                shingles = _rolled(words, settings.shingle)
                at = anchors_of(shingles, settings.spread, len(words) - settings.length)
                if len(at):
                    starts, ends = word_spans(data)
                    found.append((at, starts[at], ends[at + settings.length - 1], _groups(shingles, at, settings), at + before, at + before_words))
                    have.append(k)
                    counts.append(len(at))
                    widths.append(len(shingles))
                    all_words.append(words)
                    all_shingles.append(shingles)
                    before, before_words = before + len(shingles), before_words + len(words)
            if not have:
                continue
            places, starts, ends, groups, at, in_words = map(np.concatenate, zip(*found, strict=True))
            whole = _at(np.concatenate(all_words), in_words, settings.length).view(np.int64)
            shingles, first = np.concatenate(all_shingles), np.cumsum(widths) - widths
            picks, small = _picked(shingles, at, n, kept)
            used = np.zeros(len(shingles) + 1, bool)
            used[picks[picks >= 0]] = True
            rank = np.append(0, np.cumsum(used[:-1]))  # keys before each place
            index = np.where(picks >= 0, rank[picks] - np.repeat(rank[first], counts)[:, None], -1)
            keys = shingles[np.flatnonzero(used)].view(np.int64)
            owner = np.repeat(np.arange(len(have)), counts)
            rare = picks[small] >= 0
            rare_keys = shingles[picks[small][rare]].view(np.int64)
            rare_sizes = np.bincount(np.repeat(owner[small], rare.sum(axis=1)), minlength=len(have))
            columns = [batch.column(0).take(pa.array(have)), batch.column(1).take(pa.array(have))]
            columns += [lists(c, counts, t) for c, t in ((places, pa.int32()), (starts, pa.int32()), (ends, pa.int32()), (whole, pa.int64()), (groups, pa.int32()), (small, pa.bool_()))]
            columns.append(lists(index.ravel(), np.array(counts) * kept, pa.int32()))
            columns.append(lists(keys, np.diff(np.append(rank[first], len(keys))), pa.int64()))
            columns.append(lists(rare_keys, rare_sizes, pa.int64()))
            yield pa.record_batch(columns, names=[c.split()[0] for c in _DOCUMENT.split(", ")])

    given = docs.select("doc_id", "text_hash", text_bytes(F.col("text")).alias("raw"))
    return given.mapInArrow(rows, _DOCUMENT)


def _that_can_link(met: DataFrame, settings: Settings) -> DataFrame:
    """The paragraphs of ``met`` (rows of documents with ``hits``, their shared keys) that share enough keys, with their groups."""
    kept, shared = least_shared(settings)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            lists = [batch.column(c) for c in ("places", "starts", "ends", "paragraphs", "groups", "small", "picks", "hits")]
            edges = [c.offsets.to_numpy() for c in lists]
            flat = [c.values.to_numpy(zero_copy_only=False) for c in lists]
            out = []
            for k in range(batch.num_rows):
                *plain, groups, small, picks, hits = (f[e[k] : e[k + 1]] for f, e in zip(flat, edges, strict=True))
                picks = picks.reshape(-1, kept)
                # 1: a shared key, 2: one that a small set has; the last entry is for picks of -1.
                marks = np.zeros(max(int(hits.max()) >> 1, int(picks.max())) + 2, np.int8)
                marks[hits >> 1] = 1 + (hits & 1)
                own = marks[picks]
                n = (own > 0).sum(axis=1)
                can = (n >= shared) | ((n > 0) & (small | (own > 1).any(axis=1)))
                chosen = np.zeros(groups.max() + 1, bool)
                chosen[groups[can]] = True
                kept_ones = chosen[groups]
                size = int(kept_ones.sum())
                if size:
                    out.append((np.full(size, ids[k]), np.full(size, hashes[k]), *(c[kept_ones] for c in plain)))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["doc_id", "text_hash", "place", "start", "end", "paragraph"])

    return met.mapInArrow(rows, "doc_id bigint, text_hash int, place int, start int, end int, paragraph bigint")


def _shingled(placed: DataFrame, settings: Settings) -> DataFrame:
    """``paragraph, shingles``: the distinct shingles of the paragraphs at the ``places`` of each text ``raw``."""

    n = settings.length - settings.shingle + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, windows = [], []
            for raw, places in zip(batch.column(0), batch.column(1), strict=True):
                hashes = word_hashes(_words(raw.as_py()))
                shingles = (_rolled(hashes, settings.shingle) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                at = places.values.to_numpy()
                names.append(_at(hashes, at, settings.length).view(np.int64))
                windows.append(shingles[at[:, None] + np.arange(n)])
            if windows:
                window = np.sort(np.concatenate(windows), axis=1)
                first = np.ones(window.shape, bool)
                first[:, 1:] = window[:, 1:] != window[:, :-1]
                ends = np.append(0, np.cumsum(first.sum(axis=1)))
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(window[first]))
                yield pa.record_batch([pa.array(np.concatenate(names)), sets], names=["paragraph", "shingles"])

    return placed.select("raw", "places").mapInArrow(rows, "paragraph bigint, shingles array<int>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.hash("text").alias("text_hash"), "text")


def paragraphs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, text_hash, place, start, end, paragraph`` of all paragraphs that may link, by themselves or through others, to another document's.

    Only paragraphs that can't are left out: two similar paragraphs have some
    of their smallest shingles in common, so one that shares too few of them
    with other documents has no link to any.  What is similar to a paragraph
    within its own document stays with it.
    """
    with short_lived(docs.sparkSession) as put:
        made = put(_document_rows(_rows(docs), settings), "passage-anchors")
        keys = made.select(F.explode("keys").alias("key"), "doc_id", F.lit(False).alias("small"))
        rare = made.select(F.explode("small_keys").alias("key"), "doc_id", F.lit(True).alias("small"))
        holders = keys.unionByName(rare).groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("small").alias("small"))
        shared = put(holders.filter(F.col("first") < F.col("last")).select("key", "small"), "passage-shared")
        held = made.select("doc_id", "text_hash", F.posexplode("keys").alias("index", "key")).join(shared, "key")
        hit = (F.col("index") * 2 + F.col("small").cast("int")).alias("hit")
        hits = held.select("doc_id", "text_hash", hit).groupBy("doc_id", "text_hash").agg(F.collect_set("hit").alias("hits"))
        # Written, so that the keys' shuffles end before the documents' rows are shuffled.
        hits = put(hits, "passage-hits")
        return written(_that_can_link(made.drop("keys", "small_keys").join(hits, ["doc_id", "text_hash"]), settings), "passage-paragraphs")


def shingle_sets(docs: DataFrame, distinct: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``paragraph, shingles`` of distinct paragraphs, read at the one place ``doc_id, text_hash, place`` given for each.

    Only these texts are cut into shingles, each once: rows that repeat are
    reduced to one before they are shuffled.
    """
    places = distinct.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("place")).alias("places"))
    texts = _rows(docs).groupBy("doc_id", "text_hash").agg(F.any_value(text_bytes(F.col("text"))).alias("raw"))
    return _shingled(texts.join(places, ["doc_id", "text_hash"]), settings)


def _banded(distinct: DataFrame, settings: Settings) -> DataFrame:
    """``key, paragraph``: one row per paragraph and band."""
    bands, rows = tuned_bands(settings.similarity, settings.recall, settings.permutations)
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    offsets = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().view(np.uint32).astype(np.uint64)
            out = []
            for band in range(bands):
                key = np.full(len(ids), band, np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    least = np.minimum.reduceat(_mixed(flat * factors[k] + offsets[k]), ends[:-1])
                    key = _mixed(key * _MULTIPLIER + least)
                out.append(key.view(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(out)), pa.array(np.tile(ids, bands))], names=["key", "paragraph"])

    return distinct.select("paragraph", "shingles").mapInArrow(keys, "key bigint, paragraph bigint")


def similar_in_lists(edges: np.ndarray, ends: np.ndarray, flat: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) that hold together what pairs of so much Jaccard similarity connect within each list.

    List k is the rows ``edges[k]`` to ``edges[k + 1]``, and row r the set
    ``flat[ends[r] : ends[r + 1]]``.  All lists are walked at once: in a round,
    every list compares one of its rows with those that nothing has reached yet.
    """
    n, rows = len(edges) - 1, int(edges[-1] - edges[0])
    bits = rows.bit_length()
    if n > 1 and n.bit_length() + bits > 32:  # list, value and row share 64 bits
        halves = [similar_in_lists(e, ends, flat, similarity) for e in (edges[: n // 2 + 1], edges[n // 2 :])]
        return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])
    ends = ends[edges[0] : edges[-1] + 1]
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(n), np.diff(edges))
    high = (owner.astype(np.uint64) << np.uint64(32 + bits)) | np.arange(rows, dtype=np.uint64)
    both = np.sort(np.repeat(high, sizes) | (flat[ends[0] : ends[-1]].view(np.uint32).astype(np.uint64) << np.uint64(bits)))
    # A number for each value of a list; values that one row alone has are in no pair.
    new = np.append(True, (both[1:] ^ both[:-1]) >> np.uint64(bits) != 0)[: len(both)]
    alone = new & np.append(new[1:], True)
    value = (np.cumsum(new) - 1)[~alone]
    row = (both[~alone] & np.uint64((1 << bits) - 1)).astype(np.int64)
    by_row = np.argsort(row.astype(np.uint16) if bits <= 16 else row, kind="stable")
    value, row = value[by_row], row[by_row]
    first = np.searchsorted(row, np.arange(rows + 1))

    left, right = [], []
    seen = np.full(len(both), -1, np.int32)  # the last round in which a value was in the compared row
    reached = np.zeros(rows, bool)
    open_rows, step = np.arange(rows), 0  # rows not compared yet, of lists with rows not reached yet
    compared = np.full(n, -1)
    while len(open_rows):
        # Each list compares its first row that was reached, or else its first one.
        starts = np.flatnonzero(np.append(True, np.diff(owner[open_rows]) > 0))
        at = np.minimum.reduceat(np.where(reached[open_rows], 0, rows) + open_rows, starts) % rows
        compared[owner[at]] = at
        reached[at] = True
        seen[value[_ranges(first[at], first[at + 1])]] = step
        rest = open_rows[~reached[open_rows]]
        held = np.append(0, np.cumsum(seen[value[_ranges(first[rest], first[rest + 1])]] == step))
        each = np.append(0, np.cumsum(first[rest + 1] - first[rest]))
        common, own = held[each[1:]] - held[each[:-1]], compared[owner[rest]]
        near = common >= similarity * (sizes[rest] + sizes[own] - common)
        left.append(own[near])
        right.append(rest[near])
        reached[rest[near]] = True
        waiting = np.zeros(n, bool)
        waiting[owner[rest[~near]]] = True
        open_rows = open_rows[waiting[owner[open_rows]] & (open_rows != compared[owner[open_rows]])]
        step += 1
    return np.concatenate(left) + edges[0], np.concatenate(right) + edges[0]


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its stop, one range after the other."""
    sizes = stops - starts
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _verified(colliding: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` within the lists of ``colliding (key, paragraph, shingles)``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parts of the open list: members, their sizes, shingles

        def links(members: np.ndarray, edges: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
            left, right = similar_in_lists(edges, ends, flat, similarity)
            return pa.record_batch([pa.array(members[left]), pa.array(members[right])], names=["a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                members, sizes, flat = map(np.concatenate, zip(*held, strict=True))
                held.clear()
                if len(members) > 1:
                    yield links(members, np.array([0, len(members)]), np.append(0, np.cumsum(sizes)), flat)

        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            keys, members = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            # Only the first and the last list of a batch can reach across it.
            if len(edges) > 3:
                yield links(members, edges[1:-1], ends, flat)
            for low, high in ((0, edges[1]), (edges[-2], edges[-1]))[: len(edges) - 1]:
                if keys[low] != open_key:
                    yield from close()
                    open_key = keys[low]
                held.append((members[low:high], np.diff(ends[low : high + 1]), flat[ends[low] : ends[high]]))
        yield from close()

    dealt = colliding.repartition("key").sortWithinPartitions("key", "paragraph")
    return dealt.mapInArrow(walk, "a bigint, b bigint")


def _met(banded: DataFrame, most: int) -> DataFrame:
    """``key, paragraph, large``: the lists of at least two paragraphs with the same band key.

    Lists of up to ``most`` members get the hash of their members as key, so
    that the same list from several bands becomes one; larger ones keep their
    band key and are handed on row by row.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, large = None, np.zeros(0, np.int64), False
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add(keys: np.ndarray, members: np.ndarray, is_large: bool) -> None:
            out.append((keys, members, np.full(len(members), is_large)))

        def close() -> None:
            if large:
                add(np.full(len(held), open_key, np.int64), held, True)
            elif len(held) > 1:
                name = np.array([xxhash.xxh64_intdigest(held.tobytes())], np.uint64).view(np.int64)
                add(np.repeat(name, len(held)), held, False)

        def rows() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "paragraph", "large"])
                out.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, members = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            sizes = np.diff(edges)
            # Only the first and the last list of a batch can reach across it.
            middle = np.arange(1, len(sizes) - 1)
            two = edges[middle[sizes[middle] == 2]]
            pairs = np.stack([members[two], members[two + 1]], axis=1)
            names = np.fromiter((xxhash.xxh64_intdigest(p.tobytes()) for p in pairs), np.uint64, len(pairs)).view(np.int64)
            add(np.repeat(names, 2), pairs.ravel(), False)
            for k in [0, *middle[sizes[middle] > 2].tolist(), len(sizes) - 1][: 1 if len(sizes) == 1 else None]:
                part, key = members[edges[k] : edges[k + 1]], keys[edges[k]]
                if key == open_key:
                    held = np.concatenate([held, part])
                else:
                    close()
                    open_key, held, large = key, part, False
                if large or len(held) > most:
                    large = True
                    close()
                    held = held[:0]
            yield from rows()
        close()
        yield from rows()

    dealt = banded.repartition("key").sortWithinPartitions("key", "paragraph")
    return dealt.mapInArrow(walk, "key bigint, paragraph bigint, large boolean")


def links_of(distinct: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Links between similar paragraphs of ``distinct (paragraph, shingles)``.

    A list above ``list_rows`` is cut into blocks, and every pair of its
    blocks becomes a list, so no task holds more than about two blocks and no
    pair is lost.
    """
    met = written(_met(_banded(distinct, settings), settings.list_rows), "passage-lists")
    small = met.filter(~F.col("large")).select("key", "paragraph").distinct()
    large = met.filter("large").select("key", "paragraph")
    sizes = large.groupBy("key").agg(F.count("*").alias("n"))
    split = large.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / settings.list_rows).cast("int"))
    split = split.withColumn("block", F.pmod(F.xxhash64("paragraph"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    lists = small.unionByName(split.select(F.xxhash64("key", low, high).alias("key"), "paragraph"))
    return written(_verified(lists.join(distinct, "paragraph").select("key", "paragraph", "shingles"), settings.similarity), "passage-links")


def repeated_passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Passages that near-identically stand in several documents, one row for each place.

    ``doc_id, kept_doc_id, start, end, removed`` (and ``text_hash``): the span
    in code points, and the smallest id of the documents that the passage's
    component connects, which keeps it.  Overlapping paragraphs with the same
    keeper are one passage.  Documents without a repeated passage have no row.

    ``docs`` needs ``doc_id, text``.  Words are compared without case of A-Z;
    a text of fewer than ``length`` words has no paragraph, nor has a null or
    empty one.  Rows without an id take no part; rows that repeat with the
    same id are one document, told apart by a 32-bit hash of their texts.  Shingles are 32-bit hashes and paragraphs
    64-bit ones.
    """
    with shuffles_released(docs.sparkSession):
        every = paragraphs(docs, settings)
        # The three of a place come from one row, since a group's rows are met in one order.
        place = [F.any_value(c).alias(c) for c in ("doc_id", "text_hash", "place")]
        ends = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last")]
        distinct = written(every.groupBy("paragraph").agg(*ends, *place), "passage-distinct")
        sets = written(shingle_sets(docs, distinct, settings), "passage-shingles")
        roots = components(links_of(sets, settings))
        rooted = distinct.select("paragraph", "first", "last").join(roots, F.col("paragraph") == F.col("node"), "left")
        rooted = rooted.select("paragraph", "first", "last", F.coalesce("root", "paragraph").alias("root"))
        keepers = rooted.groupBy("root").agg(F.min("first").alias("kept_doc_id"), F.max("last").alias("last")).filter(F.col("kept_doc_id") < F.col("last"))
        kept = written(rooted.select("paragraph", "root").join(keepers.drop("last"), "root").select("paragraph", "kept_doc_id"), "passage-keepers")
    found = every.select("doc_id", "text_hash", "start", "end", "paragraph").join(kept, "paragraph")
    along = Window.partitionBy("doc_id", "text_hash", "kept_doc_id").orderBy("start", "end")
    apart = F.col("start") > F.coalesce(F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = found.withColumn("apart", apart.cast("int")).withColumn("island", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "text_hash", "kept_doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.select("doc_id", "kept_doc_id", "start", "end", (F.col("doc_id") != F.col("kept_doc_id")).alias("removed"), "text_hash")


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``text`` less the passages that another document keeps; every row stays."""
    cut = repeated_passages(docs, settings).filter("removed")
    spans = cut.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans"))

    @F.arrow_udf("string")
    def rest(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), cuts.to_pylist(), strict=True):
            parts, at = [], 0
            for span in spans:
                parts.append(text[at : max(at, span["start"])])
                at = max(at, span["end"])
            out.append("".join(parts) + text[at:])
        return pa.array(out, pa.string())

    rows = docs.withColumn("__text_hash", F.hash("text"))
    hit = rows.join(spans, (F.col("doc_id") == F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest(F.coalesce("text", F.lit("")), F.coalesce("__spans", F.array())))
    return hit.withColumn("text", text).select(*docs.columns)
