"""Byte-level BPE: texts to ids and ids back to bytes, with the tiktoken library.

Long texts are cut at places where the splitting pattern always ends a match,
so that the pieces give the same ids as the whole text would.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from musterroll.llm.common import text_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# A rank file is sent to the executors whole, so its size is bounded.
MAX_RANK_BYTES = 64 << 20

# Ids that are handed on at once.
BATCH_BYTES = 4 << 20

# Texts above this many characters are cut; white space above LONG_BLANK is a
# match of its own, which the library's pattern engine can't step through.
CHUNK = 1 << 16
LONG_BLANK = 4096

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK_RUN = re.compile(f"[{_SPACE}]{{{LONG_BLANK},}}")

# Between these no match can reach across: only an optional leading space joins
# two classes, and a contraction begins with its apostrophe.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])")


def pieces(text: str, chunk: int = CHUNK) -> Iterator[tuple[bool, str]]:
    """Parts of a text as (is one match, part), which give its ids one after the other.

    Of a long run of white space the pattern takes all but the last character
    where something follows, and all of it at the end of the text.
    """
    start = 0
    for run in _BLANK_RUN.finditer(text) if len(text) >= LONG_BLANK else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((False, part) for part in _parts(text[start : run.start()], chunk))
        yield True, text[run.start() : end]
        start = end
    yield from ((False, part) for part in _parts(text[start:], chunk))


def _parts(text: str, chunk: int) -> Iterator[str]:
    start = 0
    while len(text) - start > chunk:
        found = _BOUNDARY.search(text, start + chunk)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:]


@lru_cache(maxsize=4)
def _encodings(rank_file: bytes, pattern: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The tokenizer, and one that takes a whole text for a single match."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
    make = lambda name, p: tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
    return make("split", pattern), make("whole", r"(?s).+")


def encode_text(text: str, split: tiktoken.Encoding, whole: tiktoken.Encoding, chunk: int = CHUNK) -> np.ndarray:
    """Ids of one text as 32-bit integers."""
    found = [np.array((whole if one else split).encode_ordinary(part), dtype=np.int32) for one, part in pieces(text, chunk)]
    return np.concatenate(found) if found else np.zeros(0, np.int32)


class Tokenizer:
    """Column functions over one rank file and one splitting pattern.

    The file is read by the driver and broadcast (at most ``MAX_RANK_BYTES``),
    so that executors need no copy at the same path.
    """

    def __init__(self, spark: SparkSession, rank_path: str = RANKS, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK):
        with open(rank_path, "rb") as f:
            data = f.read(MAX_RANK_BYTES + 1)
        if len(data) > MAX_RANK_BYTES:
            raise ValueError(f"The rank file has more than {MAX_RANK_BYTES} bytes")
        self._data, self._pattern, self._chunk = spark.sparkContext.broadcast(data), pattern, chunk

    def _opened(self) -> Callable[[], tuple[tiktoken.Encoding, tiktoken.Encoding]]:
        data, pattern = self._data, self._pattern
        return lambda: _encodings(data.value, pattern)

    def encode(self, text: Column) -> Column:
        """Ids of a text as an array of integers; null and empty texts have none.

        Bytes that are not UTF-8 are read as U+FFFD.
        """
        opened, chunk = self._opened(), self._chunk

        @F.arrow_udf("array<int>")
        def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            split, whole = opened()
            for batch in texts:
                ids = [encode_text(raw.as_py().decode("utf-8", "replace"), split, whole, chunk) for raw in batch]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

        return encoded(text_bytes(text))

    def decode(self, ids: Column) -> Column:
        """Raw bytes of an array of ids; null ids give none.

        An id without a token raises, as in the library.
        """
        opened = self._opened()

        @F.arrow_udf("binary")
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            split, _ = opened()
            for batch in batches:
                yield pa.array([split.decode_bytes(x.values.to_pylist()) for x in batch], pa.binary())

        return decoded(F.coalesce(ids, F.array().cast("array<int>")))


def tokenized(docs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``documents`` with ``ids`` and ``n_tokens``, in place of columns of those names.

    Every row gives one row, repeated rows too; a null or empty text has no ids.
    """
    tokenizer = tokenizer or Tokenizer(docs.sparkSession)
    return docs.withColumn("ids", tokenizer.encode(F.col("text"))).withColumn("n_tokens", F.size("ids").cast("long"))


def coded(docs: DataFrame, columns: list[str], with_ids: bool = True, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``columns`` of ``docs`` with ``n_tokens``, ``ids`` and digests of the ids and of the bytes that they decode to.

    Texts are encoded, decoded and digested in one pass, and handed on in
    batches of bounded size; without ``with_ids`` the ids stay in the task.
    Every row gives one row; null and empty texts have no ids.
    """
    tokenizer = tokenizer or Tokenizer(docs.sparkSession)
    opened, chunk = tokenizer._opened(), tokenizer._chunk
    plain = docs.select(*columns, text_bytes(F.col("text")).alias("__raw"))
    schema = T.StructType(plain.schema.fields[:-1]).add("n_tokens", T.LongType())
    schema = (schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema).add("ids_sha256", "string").add("decoded_sha256", "string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, whole = opened()
        for batch in batches:
            first, ids, sizes, shown, read, held = 0, [], [], [], [], 0
            for k, raw in enumerate(batch.column(batch.num_columns - 1)):
                found = encode_text(raw.as_py().decode("utf-8", "replace"), split, whole, chunk)
                numbers = found.tolist()
                sizes.append(len(numbers))
                shown.append(hashlib.sha256(" ".join(map(str, numbers)).encode()).hexdigest())
                read.append(hashlib.sha256(split.decode_bytes(numbers)).hexdigest())
                if with_ids:
                    ids.append(found)
                    held += found.nbytes
                if held < BATCH_BYTES and k + 1 < batch.num_rows:
                    continue
                out = [batch.column(c).slice(first, k + 1 - first) for c in range(batch.num_columns - 1)]
                out.append(pa.array(sizes, pa.int64()))
                if with_ids:
                    ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
                    out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32())))
                out += [pa.array(shown, pa.string()), pa.array(read, pa.string())]
                yield pa.record_batch(out, names=schema.names)
                first, ids, sizes, shown, read, held = k + 1, [], [], [], [], 0

    return plain.mapInArrow(rows, schema)


def digests(docs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Digest of the ids, and of the bytes that they decode to, per document."""
    return coded(docs, ["doc_id"], with_ids=False, tokenizer=tokenizer)
