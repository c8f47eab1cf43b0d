"""Workbooks in the old format, made for the queries and tests that read them back."""

from __future__ import annotations

import struct

from musterroll.sources import oldbook

_MOST = 8224  # bytes of a record


def record(kind: int, data: bytes) -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def shared_strings(texts: list[str]) -> bytes:
    """The table of texts; a text that a record can't hold goes on in the next, after a byte that tells its width."""
    out, held, kind = b"", bytearray(struct.pack("<II", len(texts), len(texts))), oldbook.SST
    for text in texts:
        raw = text.encode("utf-16-le")
        if len(held) + 5 > _MOST:
            out, held, kind = out + record(kind, bytes(held)), bytearray(), oldbook.CONTINUE
        held += struct.pack("<HB", len(raw) // 2, 1)
        while raw:
            room = (_MOST - len(held)) // 2 * 2
            held += raw[:room]
            raw = raw[room:]
            if raw:
                out, held, kind = out + record(kind, bytes(held)), bytearray(b"\x01"), oldbook.CONTINUE
    return out + record(kind, bytes(held))


def stream(cells: list[bytes], texts: list[str], styles: bytes = b"") -> bytes:
    """A workbook of one sheet with the given cell records."""
    begin = lambda part: record(oldbook.BOF, struct.pack("<HHHHII", 0x600, part, 0, 0, 0, 0))
    end = record(oldbook.EOF, b"")
    table = shared_strings(texts)
    place = len(begin(5)) + len(styles) + 4 + 9 + len(table) + len(end)
    sheet = record(oldbook.BOUNDSHEET, struct.pack("<IBBBB", place, 0, 0, 1, 0) + b"s")
    return begin(5) + styles + sheet + table + end + begin(0x10) + b"".join(cells) + end


def compound(data: bytes) -> bytes:
    """A compound file with the one stream Workbook, in the short or the ordinary sectors."""
    big, short = 512, len(data) < 4096
    padded = data + bytes(-len(data) % big)
    n_small = -(-len(data) // 64)
    small_links = struct.pack(f"<{n_small}I", *range(1, n_small), 0xFFFFFFFE) if short else b""
    small_links += b"\xff" * (-len(small_links) % big)
    n_data, n_mini = len(padded) // big, len(small_links) // big
    n_fat = 1
    while n_fat * 128 < n_data + 1 + n_mini + n_fat:
        n_fat += 1
    n_more = -(-max(0, n_fat - 109) // 127)
    while n_fat * 128 < n_data + 1 + n_mini + n_fat + n_more:
        n_fat += 1
        n_more = -(-max(0, n_fat - 109) // 127)
    at_dir, at_mini, at_fat, at_more = n_data, n_data + 1, n_data + 1 + n_mini, n_data + 1 + n_mini + n_fat
    run = lambda first, n: [*range(first + 1, first + n), 0xFFFFFFFE] if n else []
    links = run(0, n_data) + [0xFFFFFFFE] + run(at_mini, n_mini) + [0xFFFFFFFD] * n_fat + [0xFFFFFFFC] * n_more
    links += [0xFFFFFFFF] * (n_fat * 128 - len(links))

    def entry(name: str, kind: int, child: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII36xIQ", len(raw) if name else 0, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child, start, size)

    root = entry("Root Entry", 5, 1, 0 if short else 0xFFFFFFFE, len(padded) if short else 0)
    folder = root + entry("Workbook", 2, 0xFFFFFFFF, 0, len(data)) + bytes(256)
    fats = list(range(at_fat, at_fat + n_fat))
    more = b""
    for k in range(n_more):
        some = fats[109 + 127 * k : 109 + 127 * (k + 1)]
        last = 0xFFFFFFFE if k + 1 == n_more else at_more + k + 1
        more += struct.pack("<128I", *some, *[0xFFFFFFFF] * (127 - len(some)), last)
    header = oldbook.MAGIC + bytes(16) + struct.pack("<HHHHH6xIIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, at_dir, 0, 4096, at_mini if n_mini else 0xFFFFFFFE, n_mini, at_more if n_more else 0xFFFFFFFE, n_more, 0)[:-4]
    header += struct.pack("<109I", *fats[:109], *[0xFFFFFFFF] * max(0, 109 - n_fat))
    return header.ljust(big, b"\0") + padded + folder + small_links + struct.pack(f"<{len(links)}I", *links) + more


def old_workbook(rows: list[list[str]]) -> bytes:
    """All cells as shared texts."""
    texts = list(dict.fromkeys(c for row in rows for c in row if c))
    number = {t: i for i, t in enumerate(texts)}
    cells = [record(oldbook.LABELSST, struct.pack("<HHHI", r, c, 0, number[t])) for r, row in enumerate(rows) for c, t in enumerate(row) if t]
    return compound(stream(cells, texts))
