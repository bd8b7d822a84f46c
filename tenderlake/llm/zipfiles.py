"""ZIP packages of stored members: written from memory, read by ranges.

Only what stands in the directories is read: the end record (with its ZIP64 form, where there is
one), the central directory in pieces, and the 30 bytes of a member's own header. Members are found
as (offset, size) in the package; nothing is extracted. Data before the package is allowed for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR = b"PK\x06\x06", b"PK\x06\x07"
_WIDE = 0xFFFFFFFF
_PIECE = 1 << 20
_TAIL = 22 + 0xFFFF  # an end record with the longest comment

Read = Callable[[int, int], bytes]  # (offset, size) -> bytes


class BrokenZip(ValueError):
    """The bytes are no ZIP package, or one cut off."""


@dataclass(frozen=True)
class Entry:
    name: str
    stored: bool  # neither compressed nor encrypted
    size: int
    header: int  # where the member's own header starts


def _wide_fields(extra: bytes, fields: list[int]) -> list[int]:
    """The 64-bit values that replace fields too large for 32 bits (extra field 1)."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(values, f) if f == _WIDE else f for f in fields]
        at += 4 + size
    return fields


def _end_record(read: Read, size: int) -> tuple[int, int, int, int]:
    """Where the directory ends in the file, then its entries, size and stated offset."""
    start = max(0, size - _TAIL)
    tail = read(start, size - start)
    at = tail.rfind(_END)
    while at >= 0 and not (at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise BrokenZip("no end record")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end = start + at
    locator = read(end - 20, 20) if end >= 20 else b""
    if locator[:4] == _LOCATOR:
        stated = struct.unpack_from("<Q", locator, 8)[0]
        # Data before the package moves the record away from where it is said to be.
        for place in (stated, end - 20 - 56):
            record = read(place, 56) if 0 <= place <= end - 76 else b""
            if record[:4] == _END64:
                entries, length, offset = struct.unpack_from("<QQQ", record, 32)
                return place, entries, length, offset
        if _WIDE in (length, offset) or entries == 0xFFFF:
            raise BrokenZip("no ZIP64 end record")
    return end, entries, length, offset


def directory(read: Read, size: int) -> Iterator[Entry]:
    """The members of a package, from its central directory."""
    end, entries, length, offset = _end_record(read, size)
    start = end - length
    before = start - offset
    if start < 0 or before < 0:
        raise BrokenZip("directory out of place")
    data, at, place = b"", 0, start
    for _ in range(entries):
        while len(data) - at < 46 + 3 * 0xFFFF and place < end:
            piece = read(place, min(_PIECE, end - place))
            if not piece:
                raise BrokenZip("directory cut off")
            data, at, place = data[at:] + piece, 0, place + len(piece)
        if data[at : at + 4] != _CENTRAL or len(data) - at < 46:
            raise BrokenZip("directory cut off")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full, named, extras, comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + named]
        extra = data[at + 46 + named : at + 46 + named + extras]
        full, packed, header = _wide_fields(extra, [full, packed, header])
        text = name.decode("utf-8", "replace") if flags & 0x800 else name.decode("cp437")
        yield Entry(text, method == 0 and not flags & 1, packed, header + before)
        at += 46 + named + extras + comment


def data_offset(read: Read, entry: Entry) -> int:
    """Where a member's bytes start; its own header may be longer than the directory says."""
    header = read(entry.header, 30)
    if header[:4] != _LOCAL or len(header) < 30:
        raise BrokenZip(f"no header of {entry.name}")
    return entry.header + 30 + sum(struct.unpack_from("<HH", header, 26))


def package(members: list[tuple[str, bytes]], *, wide: bool = True, comment: bytes = b"") -> bytes:
    """A ZIP package of stored members; ``wide`` adds ZIP64 fields and end records."""
    out, central, at = [], [], 0
    for name, data in members:
        named, crc = name.encode(), zlib.crc32(data)
        large = wide or len(data) >= _WIDE or at >= _WIDE
        sizes = (_WIDE, _WIDE) if large else (len(data), len(data))
        need = 45 if large else 20
        fixed = struct.pack("<HHHHHIII", need, 0x800, 0, 0, 0x21, crc, *sizes)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        local = _LOCAL + fixed + struct.pack("<HH", len(named), len(extra)) + named + extra
        more = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if large else b""
        central.append(
            _CENTRAL + struct.pack("<H", 45) + fixed
            + struct.pack("<HHHHHII", len(named), len(more), 0, 0, 0, 0, _WIDE if large else at) + named + more
        )
        out += [local, data]
        at += len(local) + len(data)
    listing = b"".join(central)
    large = wide or len(members) >= 0xFFFF or at + len(listing) >= _WIDE
    if large:
        n = len(members)
        record = _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(listing), at)
        out_end = record + _LOCATOR + struct.pack("<IQI", 0, at + len(listing), 1)
        counts = (0xFFFF, 0xFFFF, _WIDE, _WIDE)
    else:
        out_end, counts = b"", (len(members), len(members), len(listing), at)
    return b"".join([*out, listing, out_end, _END + struct.pack("<HHHHIIH", 0, 0, *counts, len(comment)), comment])
