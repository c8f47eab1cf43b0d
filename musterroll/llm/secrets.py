"""Secret scan with a worklist of decoded layers.

Every text is a layer.  A layer is scanned, and what it encodes gives further
layers: percent escapes, Unicode escapes, base64 tokens, and compressed data
inside base64.  Each layer maps its spans to its parent's, so every find has a
span in the text itself.

Four characters of base64 are three bytes, so a find in a token has the span of
the characters that encode it, through any number of nested layers.  What a
token holds in compressed form has the token's span.

A token is opened once, however often it stands in a text, and its finds are
mapped to every place.  Cycles are told along a token's own chain of ancestors:
a token that turns up inside itself is not opened again.  Among the unescaped
forms of one text, a form that was seen before is not taken up again.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.llm.common import text_bytes

# Fixed values of the query's contract: kinds in order, patterns, least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# One of these is in every text that an assignment can match.
_WORDS = ("passw", "secret", "token", "api")

Span = tuple[int, int]
Find = tuple[int, int, int]  # start, kind, end
Held = tuple[int, int, int, int]  # and the hash of the decompressed text that has it, 0 without such


def base_finds(text: str) -> list[Find]:
    """Secrets that stand in a text as they are, leftmost and without overlap per kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= MIN_VALUE:
                out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                out.append((m.start(), 1, m.end()))
    for m in _LONG_HEX.finditer(text):
        out.append((m.start(), 2, m.end()))
    return sorted(out)


# Whole runs of at least so many characters: the same as all runs, less the short ones.
_LONG_HEX = re.compile(rf"{HEX.pattern[:-1]}{{{MIN_HEX},}}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]++(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
_BREAKS = re.compile(r"[/_-]")


@dataclass(frozen=True)
class Settings:
    inflated: int = 1 << 24  # bytes of decompressed data that are held and scanned at once
    opened: int = 1 << 30  # bytes to which a token's compressed data is followed
    window: int = 1 << 20  # characters of a text that are unescaped at once, and up to the next cut
    shortest: int = 8  # characters of a decoded token worth scanning


@dataclass
class Layer:
    """An unescaped form of a whole text."""

    text: str
    parent: Layer | None = None
    back: Callable[[int, int], Span] | None = None  # to a span of the parent

    def found(self, start: int, kind: int, end: int) -> Find:
        """A find with its span in the text itself."""
        layer = self
        while layer.parent:
            start, end = layer.back(start, end)
            layer = layer.parent
        return start, kind, end


def _unescaped(text: str, pattern: re.Pattern[str], decode: Callable[[str], str]) -> tuple[str, Callable[[int, int], Span]] | None:
    """A text with its escapes decoded, and the map of spans back to it.

    A span that cuts into an escape takes the whole of it.
    """
    parts, starts, origins = [], [], []  # origin: (start, end, whether it is an escape)
    at = length = 0

    def add(part: str, start: int, end: int, escape: bool) -> None:
        nonlocal length
        if part:
            parts.append(part)
            starts.append(length)
            origins.append((start, end, escape))
            length += len(part)

    changed = False
    for m in pattern.finditer(text):
        plain = decode(m.group())
        if plain == m.group():
            continue
        changed = True
        add(text[at : m.start()], at, m.start(), False)
        add(plain, m.start(), m.end(), True)
        at = m.end()
    if not changed:
        return None
    add(text[at:], at, len(text), False)

    def back(start: int, end: int) -> Span:
        first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
        a, _, escape = origins[first]
        low = a if escape else a + start - starts[first]
        b, c, escape = origins[last]
        return low, c if escape else b + end - starts[last]

    return "".join(parts), back


def _percent(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _code_point(escape: str) -> str:
    digits = re.sub(r"[^0-9A-Fa-f]", "", escape.removeprefix("\\x")) if escape[0] == "\\" else escape.strip("&#;x")
    value = int(digits, 10 if escape[0] == "&" and escape[2] not in "x" else 16)
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else escape


class TooLarge(Exception):
    pass


# Blanks and marks which no secret, escape or token reaches across in any layer:
# escapes end in other characters than those before, and begin with others than those after.
_CUT = r"(?:[G-Zg-z.,)!?] |[,()!?<>|~*^@$]\n?)(?=[A-Za-z])"
_CUT_TEXT, _CUT_BYTES = re.compile(_CUT), re.compile(_CUT.encode())
_OVERLAP = 1 << 16  # of windows that have no such place
_STEP = 1 << 20  # bytes


def _format(data: bytes) -> Callable[[], object] | None:
    """A decompressor for the format that the first bytes name."""
    if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return lambda: zlib.decompressobj(47)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return lambda: zstandard.ZstdDecompressor().decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _steps(one: object, data: bytes) -> Generator[bytes, None, bytes]:
    """What a decompressor makes of some more input, about ``_STEP`` bytes at a time; returns what it left."""
    if isinstance(one, _ZSTD):  # can't be bounded but by its input
        for low in range(0, len(data), 1024):
            yield one.decompress(data[low : low + 1024])
            if one.eof:
                return one.unused_data + data[low + 1024 :]
        return b""
    yield one.decompress(data, _STEP)
    if isinstance(one, bz2.BZ2Decompressor | lzma.LZMADecompressor):
        while not one.eof and not one.needs_input:
            yield one.decompress(b"", _STEP)
    else:
        while not one.eof and one.unconsumed_tail:
            yield one.decompress(one.unconsumed_tail, _STEP)
    return one.unused_data


_ZLIB, _ZSTD = type(zlib.decompressobj()), type(zstandard.ZstdDecompressor().decompressobj())
_BROKEN = (zlib.error, zstandard.ZstdError, OSError, EOFError, lzma.LZMAError, ValueError)


def _inflated(data: Iterator[bytes]) -> Iterator[bytes]:
    """Data in pieces with all its members, frames or streams decompressed, one after the other.

    What follows the last of them, and the rest of broken data, stays as it is.
    """
    held = b""
    while True:
        while len(held) < 6 and (piece := next(data, None)) is not None:
            held += piece
        make = _format(held)
        if make is None:
            yield held
            yield from data
            return
        one, piece = make(), held
        try:
            while not one.eof:
                held = yield from _steps(one, piece)
                if not one.eof and (piece := next(data, None)) is None:
                    if isinstance(one, _ZLIB):
                        yield one.flush()
                    return
        except _BROKEN:
            yield piece
            yield from data
            return
        held = held.lstrip(b"\0")  # padding


def _windows(pieces: Iterator[bytes], most: int) -> Iterator[tuple[bytes, bool]]:
    """Data cut in parts of up to ``most`` bytes, each with whether the cut may go through something."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) > most:
            cuts = [m.end() for m in _CUT_BYTES.finditer(held, most // 2, most)]
            end = cuts[-1] if cuts else most
            yield bytes(held[:end]), not cuts
            del held[: end if cuts else end - min(_OVERLAP, end // 2)]
    yield bytes(held), False


def _text_windows(text: str, most: int) -> Iterator[tuple[int, str]]:
    """Parts of a text with their starts, cut at the first place after ``most`` characters."""
    start = 0
    while len(text) - start > most and (cut := _CUT_TEXT.search(text, start + most)):
        yield start, text[start : cut.end()]
        start = cut.end()
    yield start, text[start:]


# Every secret, escape and token is of printable characters; the shortest secret has twelve.
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_PRINTED = re.compile(rb"[\t-\r -~]{12}")
_WIDE = re.compile(rb"(?:[\t-\r -~]\0){11,}[\t-\r -~]?")


_BROKEN_BYTE = re.compile("[\udc80-\udcff]")


class _Utf8:
    """Places of a text's characters among its bytes."""

    step = 1024

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()
        self.marks: list[int] = []  # bytes before every ``step``-th character

    def _bytes(self, low: int, high: int) -> int:
        return len(self.text[low:high].encode("utf-8", "surrogateescape"))

    def __call__(self, place: int) -> int:
        if self.plain:
            return place
        if not self.marks:
            self.marks.append(0)
            for low in range(0, len(self.text), self.step):
                self.marks.append(self.marks[-1] + self._bytes(low, low + self.step))
        whole = place // self.step
        return self.marks[whole] + self._bytes(whole * self.step, place)


def _texts(data: bytes) -> Iterator[tuple[str, Callable[[int], int]]]:
    """Data as UTF-8, and its runs of UTF-16, each with the places of its characters among the bytes.

    Bytes that are no text are lone surrogates.  Data with such bytes or with
    control characters has a text only if it has a run that is long enough for
    a find.
    """
    text = data.decode("utf-8", "surrogateescape")
    if _PRINTED.search(data) or not _CONTROL.search(text) and (text.isascii() or not _BROKEN_BYTE.search(text)):
        yield text, _Utf8(text)
    if b"\0" in data:
        for m in _WIDE.finditer(data):
            yield m.group()[::2].decode("ascii"), lambda place, at=m.start(): min(at + 2 * place, len(data))


def _from_base64(token: str) -> bytes | None:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unescaped_forms(text: str) -> Iterator[tuple[str, Callable[[int, int], Span]]]:
    """A text with its percent escapes decoded, and with its Unicode escapes decoded."""
    for marks, pattern, decode in ((("%",), _PERCENT, _percent), (("\\u", "\\x", "&#"), _UNICODE, _code_point)):
        if any(m in text for m in marks) and (found := _unescaped(text, pattern, decode)):
            yield found


Lines = list[tuple[int, int]]  # where a token's lines start in it and in the text


def _tokens_in(text: str) -> Iterator[list[tuple[str, Lines]]]:
    """What may be base64 with its lines, each with the parts of it after it."""
    for m in _BASE64.finditer(text):
        pieces = [m.span()]
        if _BREAKS.search(m.group()):  # a path or a name may stand before the token
            at = m.start()
            for part in _BREAKS.split(m.group()):
                pieces.append((at, at + len(part)))
                at += len(part) + 1
        yield [(text[a:b], [(0, a)]) for a, b in pieces if b - a >= 16]
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            lines = [(m.start() + line.start(), m.start() + line.end()) for line in _LINE.finditer(m.group())]
            for first, last in _blocks([b - a for a, b in lines]):
                starts, length = [], 0
                for a, b in lines[first : last + 1]:
                    starts.append((length, a))
                    length += b - a
                if length >= 16:
                    yield [("".join(text[a:b] for a, b in lines[first : last + 1]), starts)]


def _in_text(lines: Lines, start: int, end: int) -> Span:
    """A span of a token in the text where it stands."""
    first, last = (bisect_right(lines, at, key=itemgetter(0)) - 1 for at in (start, end - 1))
    return lines[first][1] + start - lines[first][0], lines[last][1] + end - lines[last][0]


def _blocks(widths: list[int]) -> Iterator[tuple[int, int]]:
    """First and last of the lines that may be one wrapped token.

    These are lines of one width, without and with a shorter one at their end,
    and all lines together: a name may stand before the first one.
    """
    first, whole = 0, False
    while first < len(widths):
        last = first
        while last + 1 < len(widths) and widths[last + 1] == widths[first]:
            last += 1
        shorter = last + 1 < len(widths) and widths[last + 1] < widths[first]
        # Four characters are three bytes, so a shorter last line never changes what the others give.
        if shorter and (sum(widths[first : last + 2]) % 4 != 1):
            yield first, last + 1
            whole |= first == 0 and last + 2 == len(widths)
        elif last > first:
            yield first, last
            whole |= first == 0 and last + 1 == len(widths)
        first = last + 1
    if not whole:
        yield 0, len(widths) - 1


class _Document:
    """What the layers of one document hold.

    ``scan`` and ``_open`` hand out the tokens that they meet and are given what
    those hold, so that nesting of any depth needs no recursion.
    """

    def __init__(self, settings: Settings):
        self.settings, self.cut, self.room = settings, False, settings.opened
        self.layers: set[int] = set()  # hashes of the layers' texts
        self.opened: dict[str, frozenset[Held]] = {}  # finds by token; only spares work
        self.held = 0  # characters of these tokens

    def finds(self, text: str) -> set[Held]:
        """Finds of a text's layers, less those of the text itself."""
        scans, tokens, answer = [self.scan(text, False)], [""], None
        depth: dict[str, int] = {}  # of the tokens that are being opened
        lows = [0]  # the outermost token that a scan met again inside itself
        while True:
            try:
                token = scans[-1].send(answer)
            except StopIteration as done:
                if len(scans) == 1:
                    return done.value
                scans.pop()
                token, low, answer = tokens.pop(), lows.pop(), frozenset(done.value)
                del depth[token]
                if low < len(scans):  # not all that the token holds is known yet
                    lows[-1] = min(lows[-1], low)
                else:
                    self._keep(token, answer)
                continue
            answer = self.opened.get(token)
            if answer is None and token in depth:
                lows[-1] = min(lows[-1], depth[token])
                answer = frozenset()
            elif answer is None:
                if len(scans) == 1:
                    self.room = self.settings.opened
                depth[token] = len(scans)
                lows.append(len(scans))
                tokens.append(token)
                scans.append(self._open(token))

    def _keep(self, token: str, found: frozenset[Held]) -> None:
        self.held += len(token)
        if self.held > self.settings.inflated:
            self.opened.clear()
            self.held = len(token)
        self.opened[token] = found

    def scan(self, text: str, decoded: bool) -> Generator[str, frozenset[Held], set[Held]]:
        """Finds of a text's unescaped forms and tokens, and of the text itself where it was decoded."""
        found: set[Held] = set()
        seen, work = {hash(text)}, [Layer(text)]
        while work:
            layer = work.pop()
            if decoded or layer.parent:
                found.update((*layer.found(*find), 0) for find in base_finds(layer.text))
            for parts in _tokens_in(layer.text):
                known: set[tuple[int, int]] = set()  # a part may decompress to what the whole does
                for token, lines in parts:
                    held = yield token
                    for start, kind, end, source in held:
                        if (kind, source) not in known:
                            start, end = _in_text(lines, start, end)
                            found.add((*layer.found(start, kind, end), source))
                    known.update((kind, source) for _, kind, _, source in held if source)
            for plain, back in _unescaped_forms(layer.text):
                if hash(plain) not in seen:
                    seen.add(hash(plain))
                    work.append(Layer(plain, layer, back))
        self.layers |= seen
        return found

    def _open(self, token: str) -> Generator[str, frozenset[Held], set[Held]]:
        """Finds of what a token encodes, by its characters.

        A long layer is scanned in windows, and those that are equal once.
        """
        found: set[Held] = set()
        data = _from_base64(token)
        if data is None:
            return found
        seen: set[int] = set()
        try:
            for part, exact in self._plain(data):
                for text, place in _texts(part):
                    if len(text) < self.settings.shortest or not exact and hash(text) in seen:
                        continue
                    seen.add(hash(text))
                    for start, kind, end, source in (yield from self.scan(text, True)):
                        if exact:
                            low, high = place(start), place(end)
                            found.add((low * 8 // 6, kind, len(token) if high == len(data) else -(-high * 8 // 6), source))
                        else:
                            found.add((0, kind, len(token), hash(text)))
        except TooLarge:
            self.cut = True
        return found

    def _plain(self, data: bytes) -> Iterator[tuple[bytes, bool]]:
        """Data as it is, or windows of it decompressed as often as the first bytes name a format.

        Each comes with whether it is the data as it is.
        """
        seen, pieces = {data}, iter([data])
        head = data
        while _format(head):
            pieces = self._charged(_inflated(pieces))
            head = b""
            while len(head) <= _STEP and (piece := next(pieces, None)) is not None:
                head += piece
            pieces = chain([head], pieces)
            if head in seen:  # data that decompresses to itself, or is none of the formats
                break
            seen.add(head)
        if head == data:
            yield data, True
            return
        for part, through in _windows(pieces, self.settings.inflated):
            self.cut |= through
            yield part, False

    def _charged(self, pieces: Iterator[bytes]) -> Iterator[bytes]:
        for piece in pieces:
            self.room -= len(piece)
            if self.room < 0:
                raise TooLarge
            yield piece


def all_finds(text: str, settings: Settings = Settings()) -> tuple[list[Find], list[Find], int, bool]:
    """Base finds, all finds, the number of different layers, and whether a layer was too large to open.

    Finds of decoded layers have the span of the characters that encode them.
    The windows of a long text or layer count as layers.
    """
    base = base_finds(text)
    every = set(base)
    document = _Document(settings)
    for offset, part in _text_windows(text, settings.window):
        every.update((start + offset, kind, end + offset) for start, kind, end, _ in document.finds(part))
    return base, sorted(every), len(document.layers), document.cut


def _written(finds: list[Find]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in finds)


FOUND = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base:string,spans:string,n_layers:bigint,incomplete:boolean>"
_TYPES = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string()), ("n_layers", pa.int64()), ("incomplete", pa.bool_())]


def scanned_text(text: str, settings: Settings = Settings()) -> tuple[int, int, int, str, str, int, bool]:
    base, every, layers, cut = all_finds(text, settings)
    counts = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
    return *counts, _written(base), _written(every), layers, cut


def found_in(text: Column, settings: Settings = Settings()) -> Column:
    """Finds of a text as a struct of the fields in ``FOUND``."""

    @F.arrow_udf(FOUND)
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [scanned_text(raw.as_py().decode("utf-8", "replace"), settings) for raw in batch]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _TYPES]
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _TYPES, strict=True)]
            yield pa.StructArray.from_arrays(arrays, [name for name, _ in _TYPES])

    return found(text_bytes(text))


def scan(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id`` and the finds of every row of ``docs``, which needs ``doc_id, text``.

    Counts and ``base`` are of the text as it stands; ``spans`` has the finds
    of all layers too, written as kind:start:end in code points.  A null or
    empty text has none.  Compressed data is scanned in windows of up to ``inflated``
    bytes.  ``incomplete`` tells where a window could only be cut inside a run
    that a secret or a token may reach across (windows overlap there), or where
    a token's data went on for more than ``opened`` bytes; what comes after such
    a token is scanned all the same.  Rows that repeat give a row each.
    """
    return docs.select("doc_id", found_in(F.col("text"), settings).alias("f")).select("doc_id", "f.*")
