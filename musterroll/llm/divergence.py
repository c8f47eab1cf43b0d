"""How far the sources of a language differ in their words, by count-level bitmaps.

The kept terms of a language are dealt out into chunks of at most 64, so that a
set of a chunk's terms is one 64-bit word.  A group (language and source) has
one word per chunk and count: the terms that it holds so often.  For two groups
the AND of two such words has as many bits as there are terms with that pair of
counts, and each of these terms differs by the same amount.  Terms that a group
doesn't hold are the complement of all its words in the chunk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import UPPER, term_table, text_bytes
from musterroll.runtime import written

# The terms of a text, and the share of a term, with counts raised by 5.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, RAISED = 1_000_000_000, 5

_TABLE = term_table(digits=False)
_BITS = 64
GROUP = ["lang", "source"]


@dataclass(frozen=True)
class Settings:
    documents: int = 30  # of a language that a kept term must be in, at least
    ranks: int = 50  # of the terms of a group
    held: int = 200_000  # terms and groups counted in a task before it hands them on
    dealt: int = 4096  # terms that are numbered together
    sources: int = 128  # of a language, in one block of pairs


def _counted(docs: DataFrame, settings: Settings) -> DataFrame:
    """``lang, source, term, n, holders``: partial counts, and a row with term '' for each group."""
    most = settings.held

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, holders) in counts.items():
                k = len(n) + 1
                columns = [
                    pa.array([lang] * k, pa.string()),
                    pa.array([source] * k, pa.string()),
                    pa.array([b"", *n], pa.binary()).cast(pa.string()),
                    pa.array([0, *n.values()], pa.int64()),
                    pa.array([0, *map(holders.__getitem__, n)], pa.int64()),
                ]
                yield pa.record_batch(columns, names=[*GROUP, "term", "n", "holders"])
            counts.clear()

        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = raw.as_py().translate(_TABLE).split()
                size += (lang, source) not in counts
                n, holders = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(words)
                holders.update(set(words))
                size += len(n) - before
                if size >= most:
                    yield from flush()
                    size = 0
        yield from flush()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]
    return docs.select(*plain, text_bytes(F.col("text")).alias("raw")).mapInArrow(
        rows, "lang string, source string, term string, n bigint, holders bigint"
    )


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + SCALE * (n + RAISED) div (total + RAISED * terms), in decimals that no count overflows."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = (F.lit(SCALE).cast("decimal(10,0)") * wide(n + RAISED)).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", above, wide(total + F.lit(RAISED) * terms))


def _in_chunks(kept: DataFrame, settings: Settings) -> DataFrame:
    """``kept (lang, term, total)`` with ``chunk`` and ``bit``: at most 64 terms of like frequency in a chunk."""
    level = F.floor(F.log2("total")).cast("long")
    staged = kept.withColumn("level", level)
    parts = staged.groupBy("lang", "level").agg(F.ceil(F.count("*") / settings.dealt).cast("long").alias("parts"))
    staged = staged.join(written(parts, "divergence-levels"), ["lang", "level"])
    staged = staged.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    place = F.row_number().over(Window.partitionBy("lang", "level", "part").orderBy("term")) - 1
    staged = staged.withColumn("place", place.cast("long"))
    chunk = F.struct("level", "part", F.floor(F.col("place") / _BITS).alias("no")).alias("chunk")
    return staged.select("lang", "term", "total", chunk, (F.col("place") % _BITS).cast("int").alias("bit"))


def joint_sums(group: np.ndarray, share: np.ndarray, bits: np.ndarray, rest: np.ndarray, size: int, side: np.ndarray, other: np.ndarray) -> tuple:
    """Sums of |p - q| over a chunk's terms for each group of one side with each of the other.

    Rows are sorted by group, one per group and count; ``rest`` marks a
    group's row for count 0, whose bits are made here by complement.  ``side``
    and ``other`` tell which rows belong to which of the two blocks.
    """
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    whole = np.uint64((1 << size) - 1)
    held = np.bitwise_or.reduceat(np.where(rest, np.uint64(0), bits), starts)
    sizes = np.diff(np.append(starts, len(group)))
    bits = np.where(rest, whole & ~np.repeat(held, sizes), bits)

    def block(mask: np.ndarray) -> tuple:
        g, p, b = group[mask], share[mask], bits[mask]
        return g, p, b, np.flatnonzero(np.diff(g, prepend=g[0] - 1))

    ga, pa_, ba, sa = block(side)
    gb, pb, bb, sb = block(other)
    sums = np.zeros((len(sa), len(sb)), np.int64)
    owner = np.repeat(np.arange(len(sa)), np.diff(np.append(sa, len(ga))))
    step = max(1, (1 << 20) // len(gb))
    for i in range(0, len(ga), step):
        joint = np.bitwise_count(ba[i : i + step, None] & bb[None, :]).astype(np.int64)
        joint *= np.abs(pa_[i : i + step, None] - pb[None, :])
        np.add.at(sums, owner[i : i + step], np.add.reduceat(joint, sb, axis=1))
    return ga[sa], gb[sb], sums


_SUMS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _pair_sums(held: pa.Table) -> pa.Table:
    """Both orders of every pair of groups that a block pair (``i`` <= ``j``) has, for one chunk."""
    order = pa.compute.sort_indices(held, sort_keys=[("group_no", "ascending")])
    held = held.take(order)
    col = lambda name: held.column(name).to_numpy()
    block, i, j = col("block"), held.column("i")[0].as_py(), held.column("j")[0].as_py()
    empty = pa.table([pa.array([], f.type) for f in _SUMS], schema=_SUMS)
    side, other = block == i, block == j
    if not side.any() or not other.any():
        return empty
    rest, bits = col("n") == 0, col("bits").view(np.uint64)
    a, b, sums = joint_sums(col("group_no"), col("p"), bits, rest, held.column("size")[0].as_py(), side, other)
    left, right, value = np.repeat(a, len(b)), np.tile(b, len(a)), sums.ravel()
    apart = left != right
    left, right, value = left[apart], right[apart], value[apart]
    if i != j:
        left, right, value = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([value, value])
    return pa.table([pa.array(left), pa.array(right), pa.array(value)], schema=_SUMS)


def audit(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of ``docs (lang, source, text)``.

    Part ``pair`` has each other source of the language and the sum of the
    differences of all kept terms; part ``term`` has the kept terms that the
    group uses more than its language, the first ``ranks`` of them.  Null
    text, language and source are empty strings; every row counts, repeated
    rows too.  A language without kept terms has pairs of value 0.
    """
    partial = _counted(docs, settings)
    counts = written(partial.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("holders").alias("holders")), "divergence-counts")
    per_term = counts.filter(F.col("term") != "").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("holders").alias("holders"))
    kept = per_term.filter(F.col("holders") >= settings.documents).select("lang", "term", "total")
    kept = written(_in_chunks(written(kept, "divergence-kept"), settings), "divergence-chunks")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("words"))
    used = written(counts.join(kept, ["lang", "term"]).select(*GROUP, "term", "n", "total", "chunk", "bit"), "divergence-used")

    # Groups, also those without any term, numbered, with their words and their block of sources.
    words = used.groupBy(*GROUP).agg(F.sum("n").alias("group_words"))
    groups = counts.filter(F.col("term") == "").select(*GROUP).join(words, GROUP, "left").join(langs, "lang", "left")
    groups = groups.select(
        *GROUP, F.coalesce("group_words", F.lit(0)).alias("group_words"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("words", F.lit(0)).alias("words")
    )
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / settings.sources).cast("int").alias("blocks"))
    groups = groups.join(blocks, "lang").withColumns(
        {"group_no": F.monotonically_increasing_id(), "block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")}
    )
    groups = written(groups, "divergence-groups")

    # One word of bits per group, chunk and count; a row with count 0 stands for the complement.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    levels = used.groupBy(*GROUP, "chunk", "n").agg(F.bit_or(bit).alias("bits"))
    sizes = written(kept.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size")), "divergence-sizes")
    zeros = sizes.join(groups.select(*GROUP), "lang").select(*GROUP, "chunk", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bits"))
    share = _share(F.col("n"), F.col("group_words"), F.col("terms")).alias("p")
    rows = levels.unionByName(zeros).join(groups, GROUP).join(sizes, ["lang", "chunk"])
    rows = rows.select("lang", "chunk", "size", "group_no", "block", "n", "bits", share, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    rows = rows.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")}).drop("with")
    sums = rows.groupBy("lang", "chunk", "i", "j").applyInArrow(_pair_sums, "a bigint, b bigint, value bigint")
    sums = written(sums.groupBy("a", "b").agg(F.sum("value").alias("value")), "divergence-sums")

    mine, theirs = groups.select(*GROUP, F.col("group_no").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("group_no").alias("b"))
    pairs = mine.join(theirs, "lang").filter(F.col("a") != F.col("b")).join(sums, ["a", "b"], "left")
    pairs = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    over = used.join(groups, GROUP).withColumn("p", _share(F.col("n"), F.col("group_words"), F.col("terms")))
    over = over.withColumn("value", F.col("p") - _share(F.col("total"), F.col("words"), F.col("terms"))).filter(F.col("value") > 0)
    over = over.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")).alias("rank")
    top = over.select("*", place).filter(F.col("rank") <= settings.ranks)
    return pairs.select("*", place).unionByName(top)


_P = f"1 + ({SCALE} * ({{n}} + {RAISED})) // ({{total}} + {RAISED} * v)"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
words AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM g LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n='coalesce(c.n, 0)', total='w.total')} AS p, {_P.format(n='k.n', total='l.total')} AS q
  FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) JOIN words w ON w.lang = g.lang AND w.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
