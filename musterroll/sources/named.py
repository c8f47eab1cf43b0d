"""A data source that writes files under names of their own, as one commit.

``rows.write.format("named_files").option("path", folder)`` takes ``name,
part, place, content``: the bytes of each part of each file, in pieces.  Rows
of a part must stand together and in order; :func:`write_named` sees to it.

Every task attempt writes into a staging folder of its own, and a list of what
it wrote.  The commit moves the folders and lists of the attempts that count to
``data`` and ``manifest``, removes the staging folder, and writes ``_SUCCESS``
last.  So a killed task leaves nothing in sight, a second attempt never meets
the first one's files, and the driver handles one short message per task,
whatever the number of files.  What a killed driver moved without ``_SUCCESS``
is removed by the next commit; a committed folder is never written again.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "named_files"
MANIFEST = "name string, part bigint, output string, rows bigint, bytes bigint, sha256 string"
_STAGED, _DONE = "_staged", "_SUCCESS"
_LONGEST = 180  # bytes of an output's name; the digest in it keeps longer ones apart


def output_name(name: str, part: int) -> str:
    """A file name for part of an input: its own last name as far as that is safe, and a digest of all of it."""
    last = re.split(r"[/\\]", name)[-1]
    stem, dot, suffix = last.rpartition(".")
    stem, suffix = (stem, dot + suffix) if dot and len(suffix) < 16 else (last, "")
    safe = lambda s: re.sub(r"[^A-Za-z0-9._-]", "_", s)
    mark = hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest()[:16]
    number = f"-{part:05d}" if part else ""
    return f"{safe(stem)[:_LONGEST].lstrip("._") or "file"}-{mark}{number}{safe(suffix)}"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    outputs: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, header: bytes):
        self.path, self.header, self.run = path, header, uuid.uuid4().hex

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self._opened()
        own = uuid.uuid4().hex
        where = f"{root}/{_STAGED}/{self.run}/{own}"
        listed, at, out, digest, rows, size = [], None, None, None, 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                entry = {"name": at[0], "part": at[1], "output": f"data/{own}/{output_name(*at)}", "rows": rows, "bytes": size, "sha256": digest.hexdigest()}
                listed.append(json.dumps(entry))

        for batch in iterator:
            columns = [batch.column(n).to_pylist() for n in ("name", "part", "content")]
            for name, part, content in zip(*columns, strict=True):
                if (name, part) != at:
                    close()
                    if not listed and at is None:
                        files.create_dir(where, recursive=True)
                    at, digest, rows, size = (name, part), hashlib.sha256(self.header), 0, len(self.header)
                    out = files.open_output_stream(f"{where}/{output_name(name, part)}")
                    out.write(self.header)
                out.write(content or b"")
                digest.update(content or b"")
                rows, size = rows + 1, size + len(content or b"")
        close()
        if listed:
            with files.open_output_stream(f"{where}.json") as f:
                f.write("\n".join(listed).encode())
        return Written(own, len(listed))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._opened()
        for name in ("data", "manifest"):
            files.create_dir(f"{root}/{name}", recursive=True)
            files.delete_dir_contents(f"{root}/{name}")  # of a run that was never committed
        for m in messages:
            if m is not None and m.outputs:
                staged = f"{root}/{_STAGED}/{self.run}/{m.folder}"
                files.move(staged, f"{root}/data/{m.folder}")
                files.move(f"{staged}.json", f"{root}/manifest/{m.folder}.json")
        self._unstage(files, root)
        files.open_output_stream(f"{root}/{_DONE}").close()

    def abort(self, messages: list[Written | None]) -> None:
        self._unstage(*self._opened())

    def _unstage(self, files: fs.FileSystem, root: str) -> None:
        where = f"{root}/{_STAGED}/{self.run}"
        if files.get_file_info(where).type != fs.FileType.NotFound:
            files.delete_dir(where)  # attempts that don't count


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("header", "").encode())


class AlreadyCommitted(FileExistsError):
    pass


class NotCommitted(FileNotFoundError):
    pass


def _uri(path: str) -> str:
    return path if re.match("[a-z0-9]+:", path) else f"file://{path}"


def committed(path: str) -> bool:
    files, root = fs.FileSystem.from_uri(_uri(path))
    return files.get_file_info(f"{root}/{_DONE}").type == fs.FileType.File


def write_named(pieces: DataFrame, path: str, header: str = "") -> None:
    """Write ``pieces (name, part, place, content)`` as files under ``path``, each beginning with ``header``.

    A part of a file is written by one task; parts of one file may be written
    by several.  A file without content is one piece with empty content.
    """
    if committed(path):
        raise AlreadyCommitted(f"{path} holds a committed result")
    pieces.sparkSession.dataSource.register(NamedFiles)
    ready = pieces.select("name", F.col("part").cast("bigint").alias("part"), "place", F.col("content").cast("binary").alias("content"))
    ordered = ready.repartition("name", "part").sortWithinPartitions("name", "part", "place")
    ordered.write.format(FORMAT).mode("append").option("path", _uri(path)).option("header", header).save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, part, output, rows, bytes, sha256`` of a committed folder; ``output`` is a whole path."""
    if not committed(path):
        raise NotCommitted(f"Nothing was committed in {path}")
    listed = spark.read.schema(MANIFEST).json(f"{_uri(path)}/manifest")
    return listed.withColumn("output", F.concat(F.lit(_uri(path) + "/"), "output"))
