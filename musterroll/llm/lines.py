"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending ids.  The keys of a batch are reduced
to one row each, sorted, and merge-joined with the runs that earlier batches
left; what no run holds becomes a new run.  When a level has ``fan_out`` runs
they are merged into one run of the next level.  Runs are tables bucketed and
sorted by both hashes, by which the keys are grouped, so a run is never shuffled again.  DataFrame functions only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from musterroll.llm.common import BLANKS, ascii_lower
from musterroll.runtime import new_folder, written

MIN_KEY = 10  # code points


@dataclass(frozen=True)
class Settings:
    min_key: int = MIN_KEY
    batches: int = 4
    fan_out: int = 2


def lines_of(text: Column) -> Column:
    """Lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


_HASH = ["h1", "h2"]


def hashed_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``doc_id, text_hash, line_no, h1, h2`` of the lines that can be dropped.

    The two hashes have different seeds and make 128 bits together.  Rows
    without an id take no part.
    """
    # The text's hash is made below the explode, or else it would be made again for every line.
    hashed = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), lines_of(F.col("text")).alias("lines"))
    rows = hashed.select("doc_id", "text_hash", F.posexplode("lines").alias("line_no", "line"))
    keyed = rows.select("doc_id", "text_hash", "line_no", line_key(F.col("line")).alias("key"))
    long = keyed.filter(F.char_length("key") >= min_key)
    return long.select("doc_id", "text_hash", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


class Runs:
    """Levels of sorted runs ``h1, h2, owner``, every key in one run only.

    ``owner`` is the smallest id that holds the key.  Runs live in the shared
    folder as bucketed tables; ``close`` takes their names out of the catalog.
    """

    def __init__(self, spark: SparkSession, buckets: int, fan_out: int = 2):
        self.spark, self.buckets, self.fan_out = spark, buckets, fan_out
        self.folder, self.id = new_folder(spark, "line-runs"), uuid.uuid4().hex
        self.levels: list[list[str]] = [[]]
        self.names: list[str] = []

    def _save(self, rows: DataFrame) -> str:
        name = f"line_run_{self.id}_{len(self.names)}"
        self.names.append(name)
        spread = rows.repartition(self.buckets, *_HASH)
        spread.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def merged(self, keys: DataFrame) -> DataFrame:
        """``keys`` (one row per h1, h2) with ``owner`` from the runs, null for new keys."""
        out = keys.withColumn("owner", F.lit(None).cast("bigint"))
        for k, run in enumerate(self.tables()):
            held = run.select(*_HASH, F.col("owner").alias(f"owner_{k}"))
            out = out.join(held.hint("merge"), _HASH, "left")
            out = out.withColumn("owner", F.coalesce("owner", f"owner_{k}")).drop(f"owner_{k}")
        return out

    def add(self, new: DataFrame) -> None:
        """Add a run of new keys, and merge the levels that are full."""
        self.levels[0].append(self._save(new))
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            parts = [self.spark.table(name) for name in self.levels[level]]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._save(whole))
            level += 1

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def add_batch(runs: Runs, lines: DataFrame, last: bool = False) -> DataFrame:
    """Merge a batch of hashed lines with the runs; returns the keys that make lines drop.

    ``h1, h2, owner`` of every key that two documents hold, one of them in
    this batch.  A batch's ids must be above those of earlier ones.  The last
    batch's new keys need no run.
    """
    keys = lines.groupBy(*_HASH).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final"))
    keys = written(runs.merged(keys), "line-keys")
    if not last:
        runs.add(keys.filter(F.col("owner").isNull()).select(*_HASH, F.col("first").alias("owner")))
    shared = keys.filter(F.col("owner").isNotNull() | (F.col("first") < F.col("final")))
    return shared.select(*_HASH, F.coalesce("owner", "first").alias("owner"))


def dropped_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, text_hash, line_no`` of every line to drop, over all documents."""
    spark = docs.sparkSession
    lines = written(hashed_lines(docs, settings.min_key), "line-hashes")
    # Bounds of the batches: a handful of ids.
    shares = [k / settings.batches for k in range(1, settings.batches)]
    cuts = sorted(set(lines.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or [])) if shares else []
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), settings.fan_out)
    try:
        return _batched(runs, lines, [None, *cuts, None])
    finally:
        runs.close()


def _batched(runs: Runs, lines: DataFrame, bounds: list[int | None]) -> DataFrame:
    shared = None
    for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        batch = lines
        if low is not None:
            batch = batch.filter(F.col("doc_id") > low)
        if high is not None:
            batch = batch.filter(F.col("doc_id") <= high)
        found = written(add_batch(runs, batch, k == len(bounds) - 2), "line-shared")
        hit = _hits(batch, found)
        shared = hit if shared is None else shared.unionByName(hit)
    return shared


class KeptRuns(Runs):
    """Runs under a folder of their own, to which later sessions add batches.

    ``keep`` ends a batch by one row of a manifest: the levels, and the largest
    id so far.  What a batch that was not kept has written is never read, so it
    can be given again.  Ids of a batch must be above those of the kept ones.
    """

    MANIFEST = "version bigint, buckets int, fan_out int, top bigint, levels array<array<string>>"

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fan_out: int):
        super().__init__(spark, buckets, fan_out)
        self.folder = folder.rstrip("/")
        self.version, self.top = 0, None

    @classmethod
    def new(cls, spark: SparkSession, folder: str, fan_out: int = 2) -> KeptRuns:
        """No runs, in a folder that has none yet."""
        runs = cls(spark, folder, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_out)
        runs._note("errorifexists")
        return runs

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> KeptRuns:
        """The runs as they were last kept."""
        rows = spark.read.schema(cls.MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
        last = rows.orderBy(F.desc("version")).first()
        runs = cls(spark, folder, last.buckets, last.fan_out)
        runs.version, runs.top, runs.levels = last.version, last.top, last.levels
        for name in (name for level in runs.levels for name in level):
            runs.names.append(name)
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {runs.buckets} BUCKETS LOCATION '{runs.folder}/{name}'"
            )
        return runs

    def _note(self, mode: str) -> None:
        row = [(self.version, self.buckets, self.fan_out, self.top, self.levels)]
        self.spark.createDataFrame(row, self.MANIFEST).coalesce(1).write.mode(mode).parquet(f"{self.folder}/manifest")

    def batch(self, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
        """``docs`` without the lines that earlier batches or smaller ids hold; see ``deduped``.

        Write the result, and then ``keep`` the batch.
        """
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if low is not None and self.top is not None and low <= self.top:
            raise ValueError(f"Ids of a batch must be above {self.top}, not {low}")
        lines = written(hashed_lines(docs, settings.min_key), "line-hashes")
        found = written(add_batch(self, lines), "line-shared")
        self.top = self.top if high is None else high
        return _kept_lines(docs, _hits(lines, found))

    def keep(self) -> None:
        self.version += 1
        self._note("append")


def _hits(lines: DataFrame, shared: DataFrame) -> DataFrame:
    return lines.join(shared, _HASH).filter(F.col("doc_id") != F.col("owner")).select("doc_id", "text_hash", "line_no")


def _rested(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with ``__rest``, ``__n_lines`` and ``__n_dropped``."""
    gone = dropped.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set("line_no").alias("__gone"))
    rows = docs.withColumn("__text_hash", F.xxhash64("text"))
    joined = rows.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left")
    # Lines and marks of the places to drop, sorted: a dropped line comes right after its mark.  Both columns
    # are made once; lookups in them take no longer the more lines a text has.
    staged = joined.withColumn("__lines", lines_of(F.col("text")))
    line = F.transform("__lines", lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("kind"), x.alias("line")))
    mark = F.transform("__gone", lambda i: F.struct(i.alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line")))
    staged = staged.withColumn("__marked", F.when(F.col("__gone").isNotNull(), F.sort_array(F.concat(line, mark))))
    stays = lambda x, i: (x.kind == 1) & ((i == 0) | (F.get("__marked", i - 1).kind == 1))
    rest = F.array_join(F.transform(F.filter("__marked", stays), lambda x: x.line), "\n")
    return staged.select(
        *docs.columns,
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest).alias("__rest"),
        F.size("__lines").cast("long").alias("__n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_dropped"),
    )


def deduped(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, kept_text, n_lines`` (before) and ``n_dropped`` of every row of ``docs``.

    A key of at least ``min_key`` code points that two documents hold loses
    all its lines except in the smallest ``doc_id``; lines that repeat within
    one document only stay.  Rows without an id keep all lines and own none.
    Rows that repeat with the same id are one document: none loses a line to
    the other.  A null text is kept as an empty one.
    """
    return _kept_lines(docs, dropped_lines(docs.select("doc_id", "text"), settings))


def _kept_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return _rested(docs.select("doc_id", "text"), dropped).select(
        "doc_id",
        F.coalesce("__rest", F.lit("")).alias("kept_text"),
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
    )


def cleaned(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and ``n_chars`` to match.

    Documents that lose no line are as they were; one whose lines all go
    keeps its row, with an empty text.
    """
    out = _rested(docs, dropped_lines(docs, settings))
    changed = F.col("__n_dropped") > 0
    out = out.withColumn("text", F.col("__rest"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
keyed AS (
  SELECT doc_id, line_no, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.*, coalesce(k.doc_id <> s.owner, false) AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
