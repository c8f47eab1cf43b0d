"""Mixture-controlled packing: deficit round robin over source queues.

Every source's documents are tokenized, shuffled and queued.  A window is a
number of sequences.  In each window a source earns its quantum, its target
share of the window's tokens; what it can't spend stays as its deficit and is
carried to the next window, whatever partition that is made in.  Documents are
cut where a quantum ends, so every window has the target proportions to the
token.  A source whose quantum is smaller than a worthwhile piece saves its
deficit until it covers one.

Because no queue waits, the deficit counters have a closed form: after j turns
a source has spent floor(j * spent each turn), and turn j falls into the window
in which its credit reaches that.  So each document finds its windows by
itself, and only running sums (of queues, and of windows) cross partitions.
The windows follow each other in one stream, which is cut into sequences.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from musterroll.llm.common import text_bytes
from musterroll.runtime import new_folder, written

MODEL = public_tokenizers.path("byte_bpe_50k.json")
MAX_MODEL_BYTES = 64 << 20  # the model file is sent to the executors whole

# Before white space that follows something else, and between a letter and ASCII
# punctuation or a digit, the splitting pattern always ends a match.  Parts that
# are cut there give their ids one after the other.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_CUT = "\x01"
_CUTS = [f"([{_LETTER}])([!-/0-9:-@\\[-`{{-~])", f"([^{_SPACE}])([{_SPACE}])"]
_ONE_MATCH = re.compile(f" ?[{_LETTER}]+")


def _shown_bytes() -> dict[int, int]:
    """The character that byte-level models show for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + others.index(b) if b in others else b for b in range(256)}


_UNIT = 1 << 16  # quanta are counted in parts of a token
_CHUNK = 4096  # windows whose totals are added up together


@dataclass(frozen=True)
class Settings:
    sequence: int = 1024  # tokens
    window: int = 64  # sequences
    piece: int = 256  # tokens that a source saves up, at least, before it is served
    weights: tuple[tuple[str, float], ...] | None = None  # of sources ('' for null); others weigh 1.  None: shares of all tokens
    end: int = 0  # id put after every document
    cached: int = 500_000  # parts whose ids a task remembers
    batch_bytes: int = 8 << 20  # of text, encoded and handed on at once


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, by a byte-level model of the ``tokenizers`` library.

    Each distinct part of the texts is encoded once while it is remembered; a
    part that is one match goes to the model itself.  Names of special tokens
    in a text are ordinary text.
    """

    def __init__(self, model: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core already
        self.library = tokenizers.Tokenizer.from_str(model)
        self.library.encode_special_tokens = True
        self.model, self.shown = self.library.model, _shown_bytes()
        split = self.library.pre_tokenizer
        # Only the known splitting pattern says where a text can be cut.
        self.cuts = isinstance(split, tokenizers.pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and self.library.normalizer is None
        self.cached, self.known = cached, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(found.ids, "<u4").tobytes() for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        new = [part for part in parts if part not in self.known]
        if len(self.known) + len(new) > self.cached:
            self.known, new = {}, parts
        rest = []
        tokens, shown, one = self.model.tokenize, self.shown, _ONE_MATCH.fullmatch
        blank = chr(shown[0x20])
        for part in new:
            if one(part):
                if part.isascii():  # letters are shown as they are
                    seen = blank + part[1:] if part[0] == " " else part
                else:
                    seen = part.encode().decode("latin-1").translate(shown)
                self.known[part] = array("I", [t.id for t in tokens(seen)]).tobytes()
            else:
                rest.append(part)
        self.known.update(zip(rest, self._whole(rest), strict=True))

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        if not len(texts):
            return []
        if not self.cuts or pc.any(pc.match_substring(texts, _CUT)).as_py():
            return self._whole(texts.to_pylist())
        marked = texts
        for cut in _CUTS:
            marked = pc.replace_substring_regex(marked, cut, f"\\1{_CUT}\\2")
        lists = pc.split_pattern(marked, _CUT)
        coded = pc.dictionary_encode(lists.flatten())
        parts = coded.dictionary.to_pylist()
        self._learn(parts)
        found = [self.known[part] for part in parts]
        ids, own = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = coded.indices.to_numpy()
        sizes, first = own[index], (np.cumsum(own) - own)[index]
        ends = np.cumsum(sizes)
        flat = ids[np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)]
        edges = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [flat[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _as_text(raws: pa.BinaryArray) -> pa.StringArray:
    try:
        return raws.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([raw.as_py().decode("utf-8", "replace") for raw in raws], pa.string())


@lru_cache(maxsize=2)
def _encoder(model: bytes, cached: int) -> Encoder:
    return Encoder(model.decode(), cached)


def tokenized(docs: DataFrame, settings: Settings = Settings(), path: str = MODEL) -> DataFrame:
    """``row, doc_id, source, n_tokens, ids`` of every row of ``docs``: ids with the end id, 4 bytes each.

    A null text is an empty one and has the end id alone; a null source is ''.
    """
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"The model file has more than {MAX_MODEL_BYTES} bytes")
    model = docs.sparkSession.sparkContext.broadcast(data)
    end = np.array([settings.end], "<u4").tobytes()
    cached, most = settings.cached, settings.batch_bytes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value, cached)
        for batch in batches:
            raws = batch.column(3)
            sizes = np.cumsum(pc.binary_length(raws).to_numpy())
            first = 0
            while first < batch.num_rows:  # texts of so many bytes at once, or a single longer one
                past = int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, side="right"))
                past = max(past, first + 1)
                ids = [x + end for x in encoder.encode(_as_text(raws[first:past]))]
                plain = [batch.column(c).slice(first, past - first) for c in range(3)]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.record_batch([*plain, counts, pa.array(ids, pa.binary())], names=["row", "doc_id", "source", "n_tokens", "ids"])
                first = past

    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), source, text_bytes(F.col("text")))
    return plain.mapInArrow(rows, "row bigint, doc_id bigint, source string, n_tokens bigint, ids binary")


# --- queues and turns ----------------------------------------------------------------


def _queued(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows (row, doc_id, source, n_tokens)`` with ``at``, the tokens before each in its source's queue.

    The queue's order is that of a hash.  It is summed in cells of it, about
    the root of the rows many, and then along each cell.
    """
    bits = max(1, int(n_rows).bit_length() // 2)
    shuffle = F.xxhash64("doc_id", "row")
    staged = rows.withColumn("shuffle", shuffle).withColumn("cell", F.shiftright("shuffle", 64 - bits))
    per_cell = staged.groupBy("source", "cell").agg(F.sum("n_tokens").alias("words"))
    along = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = per_cell.select("source", "cell", F.coalesce(F.sum("words").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "cell").orderBy("shuffle", "row").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    placed = staged.withColumn("run", run).join(written(before, "packing-cells"), ["source", "cell"])
    return placed.select("row", "source", "n_tokens", (F.col("run") + F.col("before")).alias("at"))


def quanta(sizes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``source, earned, spent, start`` for ``sizes (source, tokens)``, in parts of a token.

    A source earns ``earned`` a window, and spends ``spent`` each turn, which
    is at least a piece; ``start`` is the credit it begins with, so that small
    sources don't all wait for the same window.
    """
    weight = F.col("tokens").cast("double")
    if settings.weights is not None:
        weight = F.lit(1.0)
        for source, w in settings.weights:
            weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    whole = float(settings.sequence * settings.window * _UNIT)
    totals = sizes.withColumn("weight", weight)
    sums = totals.agg(F.sum("weight").alias("all"))
    earned = F.greatest(F.ceil(F.col("weight") / F.col("all") * F.lit(whole)), F.lit(1)).cast("bigint")
    spent = F.greatest("earned", F.lit(settings.piece * _UNIT))
    staged = totals.join(F.broadcast(sums)).withColumn("earned", earned).withColumn("spent", spent)  # one row
    return staged.select("source", "tokens", "earned", "spent", F.pmod(F.xxhash64("source"), F.col("spent")).alias("start"))


def _turn_of(token: Column) -> Column:
    """The turn in which a source's token (from 0) is spent."""
    return F.call_function("div", (token + 1) * _UNIT - 1, F.col("spent"))


def _spent_before(turn: Column) -> Column:
    return F.call_function("div", turn * F.col("spent"), F.lit(_UNIT).cast("bigint"))


def _in_windows(queued: DataFrame, facts: DataFrame) -> DataFrame:
    """``row, start, length, window, source, at``: the parts of each document that its source's turns take."""
    staged = queued.join(facts, "source")
    turns = F.sequence(_turn_of(F.col("at")), _turn_of(F.col("at") + F.col("n_tokens") - 1))
    each = staged.withColumn("turn", F.explode(turns))
    low = F.greatest("at", _spent_before(F.col("turn")))
    high = F.least(F.col("at") + F.col("n_tokens"), _spent_before(F.col("turn") + 1))
    window = F.call_function("div", F.col("turn") * F.col("spent") + F.col("start"), F.col("earned"))
    cut = each.select("row", "source", (low - F.col("at")).alias("start"), (high - low).alias("length"), window.alias("window"), low.alias("at"))
    return cut.filter(F.col("length") > 0)


def _streamed(parts: DataFrame) -> DataFrame:
    """``row, start, length, at``: ``at`` is now the place in the stream of all windows."""
    totals = parts.groupBy("window").agg(F.sum("length").alias("tokens")).withColumn("chunk", F.floor(F.col("window") / _CHUNK))
    totals = written(totals, "packing-windows")
    chunks = totals.groupBy("chunk").agg(F.sum("tokens").alias("tokens"))
    upto = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per 4,096 windows
    before = chunks.select("chunk", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("chunk").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("run", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, "chunk")
    starts = written(starts.select("window", (F.col("run") + F.col("before")).alias("first")), "packing-starts")
    along = Window.partitionBy("window").orderBy("source", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("run", F.coalesce(F.sum("length").over(along), F.lit(0)))
    return placed.join(starts, "window").select("row", "start", "length", (F.col("first") + F.col("run")).alias("at"))


def _in_sequences(streamed: DataFrame, total: int, settings: Settings) -> DataFrame:
    """``row`` and its pieces: ``start, length, sequence_id, offset``.

    All sequences are full but the last ones, which are as long as the powers
    of two that make up the rest, and so need no padding either.
    """
    size = settings.sequence
    full, rest = divmod(total, size)
    edges = [full * size]
    for power in reversed(range(rest.bit_length())):
        if rest >> power & 1:
            edges.append(edges[-1] + (1 << power))
    end = F.col("at") + F.col("length")
    tail = F.array(*[F.struct(F.lit(full + i).cast("bigint").alias("id"), F.lit(a).cast("bigint").alias("low"), F.lit(b).cast("bigint").alias("high")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    last = F.least(F.floor((end - 1) / size), F.lit(full - 1))
    whole = F.when(F.floor(F.col("at") / size) <= last, F.sequence(F.floor(F.col("at") / size).cast("bigint"), last.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    spans = F.transform(whole, lambda s: F.struct(s.alias("id"), (s * size).alias("low"), ((s + 1) * size).alias("high")))
    if rest:
        spans = F.concat(spans, F.filter(tail, lambda t: (t.low < end) & (t.high > F.col("at"))))
    each = streamed.withColumn("s", F.explode(spans))
    low, high = F.greatest("at", F.col("s.low")), F.least(end, F.col("s.high"))
    return each.select(
        "row", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"), F.col("s.id").alias("sequence_id"), (low - F.col("s.low")).alias("offset")
    )


def packed(docs: DataFrame, settings: Settings = Settings(), path: str = MODEL) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: the pieces of all rows of ``docs (doc_id, source, text)``.

    ``ids`` are the piece's token ids, 4 bytes each, little-endian.  Every id
    of every row lies in one piece, and the pieces of a sequence follow each
    other without a gap.  Every row is a document of its own, repeated rows
    and rows without an id too; null text is empty, null source is ''.
    """
    made = tokenized(docs, settings, path)
    folder = new_folder(docs.sparkSession, "packing-ids")
    made.write.parquet(folder, compression="zstd")  # half the size of the default
    texts = docs.sparkSession.read.schema(made.schema).parquet(folder)
    rows = texts.select("row", "doc_id", "source", "n_tokens")
    sizes = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "packing-sources")
    all_rows = sizes.agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).first()
    facts = written(quanta(sizes.select("source", "tokens"), settings).drop("tokens"), "packing-quanta")
    parts = written(_in_windows(_queued(rows, all_rows["rows"] or 1), facts), "packing-parts")
    pieces = _in_sequences(_streamed(parts), all_rows["tokens"] or 0, settings)
    lists = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    joined = texts.join(lists.hint("shuffle_hash"), "row")
    # Slices are taken before the pieces become rows, which would repeat all ids for each.
    slices = F.transform(
        "pieces",
        lambda p: F.struct(p.start, p.length, p.sequence_id, p.offset, F.substring(F.col("ids"), (p.start * 4 + 1).cast("int"), (p.length * 4).cast("int")).alias("ids")),
    )
    each = joined.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(slices).alias("p"))
    return each.select("doc_id", "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")
