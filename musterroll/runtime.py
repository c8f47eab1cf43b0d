"""Shared folder, written intermediate tables and chunked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one file are addressed in chunks of 2^20, so that a join on
# (file, chunk) spreads a very large file over many tasks.
CHUNK_BITS = 20

# Wide projections over twenty fields make one whole-stage method larger than
# the 8000 bytes of bytecode that the JVM will still compile to machine code.
# Below that limit Spark falls back to projections split into small methods.
# Tables that are partitioned by a few values are written with one open file
# for each, so that wide rows are not sorted by those values first.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.maxConcurrentOutputFileWriters": "4"}

_fallback_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the library's plans want; safe to call again."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


class NoSharedFolder(RuntimeError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one named by ``spark.checkpoint.dir``, or else the context's
    checkpoint folder.  Only a master that runs in this one process may fall
    back on a local folder; anywhere else each executor would write to a disk
    of its own, so that is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if context.master.partition("[")[0] != "local":
        raise NoSharedFolder("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _fallback_dirs:
        _fallback_dirs[app] = tempfile.mkdtemp(prefix="musterroll-")
    return _fallback_dirs[app]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and gives
    Catalyst the real size of the table, so that joins against it are
    broadcast only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action are removed when it ends.

    Otherwise they stay until the driver happens to collect its garbage.  For
    steps that end in written tables, whose shuffles nothing reads again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def short_lived(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``written`` whose tables are deleted on leaving.

    For steps that end in another written table: what is made of the tables
    inside has to be written inside too.
    """
    folder = new_folder(spark, "short-lived")

    def put(df: DataFrame, label: str) -> DataFrame:
        df.write.parquet(f"{folder}/{label}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{label}")

    try:
        yield put
    finally:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table that is cut in fewer pieces than there are cores.

    Only small tables are: a large one has more splits than cores and is left
    as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def file_uri(path: Column) -> Column:
    """One spelling of local file names, which Spark writes in two ways."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def chunk_of(row_idx: Column) -> Column:
    return F.shiftright(row_idx, CHUNK_BITS)


def per_chunk(per_file: DataFrame, last_row: str) -> DataFrame:
    """Repeat each file's row once for every chunk the file has."""
    return per_file.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunk_of(F.col(last_row)))))


def with_file_facts(rows: DataFrame, per_file: DataFrame, last_row: str, how: str = "inner") -> DataFrame:
    """Attach per-file columns to rows that carry ``file`` and ``row_idx``."""
    facts = per_chunk(per_file, last_row)
    return rows.withColumn("chunk", chunk_of(F.col("row_idx"))).join(facts, ["file", "chunk"], how).drop("chunk")


def one_row_each(df: DataFrame, keep: list[str], items: str | Column, name: str = "item") -> DataFrame:
    """One row per array item.

    The outer form is used on purpose: for a plain ``explode`` Catalyst adds a
    filter on the array's size and pushes it below the projections that make
    the array, which then compute everything twice.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
