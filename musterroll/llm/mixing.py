"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled and queued, once for each time they may
be taken; a document's virtual finish time is the running number of words in
its source's queue divided by the source's target.  All queues merge in order
of finish time, and the mix ends at the total budget.  DataFrame functions
only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import word_count
from musterroll.runtime import written


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (5, 2, 1)  # for the sources in order, repeating
    share: float = 1.5  # budget as a share of all words
    repeats: int = 2  # times a document may be taken


# Columns of an internal table; documents may have columns of any other name.
_KEYS = ["__src", "__cell"]
_ORDER = ["__shuffle", "__id", "__size", "__text"]


def _prepared(docs: DataFrame) -> DataFrame:
    """Size, source key (never null), and shuffled place of every row."""
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.withColumns(
        {
            "__src": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
            "__id": F.col("doc_id"),
            "__size": word_count(F.col("text")),
            "__shuffle": md5,
            "__text": F.xxhash64("text"),
        }
    )


def _cell(cells: int) -> Column:
    """The first eight digits of the shuffle hash, scaled to so many cells in its order."""
    return F.floor(F.conv(F.substring("__shuffle", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.lit(cells))


def targets(sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``__src`` with number, size, target and budget, one row per source.

    Targets share the budget by weight; one that would be above ``repeats``
    times its source's size stops there, and the excess goes to the others by
    weight.  That is a common level: with sources ordered by size per weight,
    the level is the greatest of (budget - what the smaller ones hold) / (the
    weight of the rest).  The window's one task holds a row per source.
    """
    weights = F.array(*[F.lit(w) for w in settings.weights])
    ordered = Window.orderBy(F.col("__src") == "", "__src")
    known = sizes.withColumn("__source_no", F.row_number().over(ordered))
    known = known.withColumn("weight", F.get(weights, (F.col("__source_no") - 1) % len(settings.weights)))
    known = known.withColumn("most", F.col("__source_size") * settings.repeats)
    by_room = Window.orderBy(F.col("most") / F.col("weight"), "__source_no")
    all_rows = Window.partitionBy()
    stopped = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("__source_size").over(all_rows) * F.lit(float(settings.share))
    known = known.withColumn("level", (budget - stopped) / rest).withColumn("__budget", budget)
    level = F.max("level").over(all_rows)
    target = F.least(F.col("most").cast("double"), level * F.col("weight"))
    return known.select("__src", "__source_no", "__source_size", target.alias("__target"), "__budget")


def _finished(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds the running words of each row in its source's queue, the row included."""
    within = Window.partitionBy(*_KEYS).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__run", F.sum("__size").over(within)).join(offsets, _KEYS).withColumn("__run", F.col("__run") + F.col("__before"))


def _finish(copy: Column | int) -> Column:
    """Virtual finish time of a row's copy; null where the target is 0."""
    run = F.col("__run") + F.col("__source_size") * copy
    return F.when(F.col("__target") > 0, run / F.col("__target"))


_PLACE = ["finish", "__source_no", *_ORDER, "copy"]


def _cut(finished: DataFrame, cells: int, settings: Settings) -> tuple | None:
    """Place of the last copy that the budget covers; None where it covers none.

    Words are added up per slice of virtual time first, where all queues run
    evenly, and row by row only in the slice in which the budget ends.
    """
    copies = finished.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(settings.repeats - 1))))
    copies = copies.withColumn("finish", _finish(F.col("copy"))).filter(F.col("finish").isNotNull())
    copies = copies.withColumn("slice", F.least(F.floor(F.col("finish") * cells), F.lit(4 * cells)))
    per_slice = copies.groupBy("slice").agg(F.sum("__size").alias("words"), F.max("__budget").alias("__budget"))
    upto = F.sum("words").over(Window.orderBy("slice"))
    ends = per_slice.withColumn("upto", upto).filter((F.col("upto") > F.col("__budget")))
    last = ends.orderBy("slice").limit(1).first()
    if last is None:
        inside, room = copies, None
    else:
        inside, room = copies.filter(F.col("slice") == last["slice"]), last["__budget"] - (last["upto"] - last["words"])
    if room is not None:
        running = F.sum("__size").over(Window.partitionBy("slice").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, 0))
        taken = inside.withColumn("running", running).filter(F.col("running") <= room)
        found = taken.orderBy(*[F.col(c).desc_nulls_last() for c in _PLACE]).select(*_PLACE).first()
        if found is not None:
            return tuple(found)
        inside = copies.filter(F.col("slice") < last["slice"])
    found = inside.orderBy(*[F.col(c).desc_nulls_last() for c in _PLACE]).select(*_PLACE).first()
    return tuple(found) if found is not None else None


def _not_after(copy: int, cut: tuple) -> Column:
    """Whether a row's copy comes no later than the cut, in the order of ``_PLACE`` (nulls first)."""
    here = [_finish(copy), *[F.col(c) for c in _PLACE[1:-1]], F.lit(copy)]
    out = F.lit(True)
    for mine, last in reversed(list(zip(here, cut, strict=True))):
        edge = F.lit(last)
        less = F.lit(False) if last is None else mine.isNull() | (mine < edge)
        out = less | (mine.eqNullSafe(edge) & out)
    return F.coalesce(_finish(copy).isNotNull() & out, F.lit(False))


def _plan(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, int, tuple | None]:
    """The rows' keys by cell (written, without texts), what precedes each cell, the number of cells, and the mix's end."""
    slim = written(rows.select("__src", *_ORDER), "mix-rows")
    cells = max(1, int(slim.count() ** 0.5))
    celled = slim.withColumn("__cell", _cell(cells))
    per_cell = written(celled.groupBy(*_KEYS).agg(F.sum("__size").alias("words")), "mix-cells")
    sizes = per_cell.groupBy("__src").agg(F.sum("words").alias("__source_size"))
    aims = written(targets(sizes, settings), "mix-targets")
    along = Window.partitionBy("__src").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = per_cell.select(*_KEYS, F.coalesce(F.sum("words").over(along), F.lit(0)).alias("__before"))
    offsets = written(before.join(aims, "__src"), "mix-offsets")
    return celled, offsets, cells, _cut(_finished(celled, offsets), cells, settings)


def _copies(cut: tuple | None, settings: Settings) -> Column:
    """How often the mix takes a row."""
    copies = F.lit(0)
    if cut is not None:
        for copy in range(settings.repeats):
            copies = copies + _not_after(copy, cut).cast("int")
    return copies


def _queued(docs: DataFrame, settings: Settings) -> DataFrame:
    """``docs`` with columns of the queues and ``__copies``, how often the mix takes a row."""
    rows = _prepared(docs)
    _, offsets, cells, cut = _plan(rows, settings)
    out = _finished(rows.withColumn("__cell", _cell(cells)), offsets)
    return out.withColumn("__copies", _copies(cut, settings))


def mixed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every row of ``docs``.

    ``docs`` needs ``doc_id, text, source``; a null text has no words, null
    sources form one source, the last.  Documents are shuffled by a hash of
    their id, so reruns agree; rows that are equal take places next to each
    other.  A source without words has target 0 and none of its documents is
    taken.  A document without words is taken where the mix passes it.

    A source may hold any share of the rows: its queue is cut into cells by
    the shuffle hash, about as many as the square root of the number of rows,
    and words are added up by cell first.  Texts are read once, to count words.
    """
    celled, offsets, _, cut = _plan(_prepared(docs.select("doc_id", "text", "source")), settings)
    out = _finished(celled, offsets).withColumn("__copies", _copies(cut, settings))
    return out.select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__copies").alias("copies"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def stream(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, in order of finish time."""
    rows = _queued(docs, settings).filter(F.col("__copies") > 0)
    each = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    each = each.withColumn("__at", _finish(F.col("__copy")))
    order = ["__at", "__source_no", "__shuffle", "__id"]
    return each.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


# The plain form: one running sum over everything.
SQL = r"""
WITH rows AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no
  FROM rows GROUP BY source),
weighed AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS most FROM sizes),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
      - coalesce(CAST(sum(most) OVER (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
      / CAST(sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed),
aims AS (SELECT *, least(CAST(most AS DOUBLE), max(level) OVER () * weight) AS target FROM levels),
queued AS (
  SELECT r.*, a.source_no, a.source_size, a.target, a.budget,
    CAST(sum(size) OVER (PARTITION BY a.source_no ORDER BY shuffle, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
  FROM rows r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source),
copies AS (
  SELECT q.*, c.copy, (run + source_size * c.copy) / target AS finish
  FROM queued q, (VALUES (0), (1)) AS c(copy) WHERE target > 0),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_no, shuffle, doc_id NULLS FIRST, size, run, copy ROWS UNBOUNDED PRECEDING) AS used FROM copies),
counted AS (SELECT source_no, shuffle, doc_id, size, run, count(*) AS n FROM merged WHERE used <= budget GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(c.n, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN counted c
  ON q.source_no = c.source_no AND q.run = c.run AND q.shuffle = c.shuffle AND q.size = c.size
     AND q.doc_id IS NOT DISTINCT FROM c.doc_id
"""
