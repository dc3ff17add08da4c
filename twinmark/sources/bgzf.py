"""BGZF: gzip members of at most 64 KiB that carry their own size."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

# A member's first bytes, and the empty member that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAX_DATA = 0xFF00


def read_block(f: BinaryIO, check_crc: bool = True) -> bytes | None:
    """The data of the member at f, or None at the end; ValueError if it is damaged."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or head[:4] != MAGIC:
        raise ValueError("not a BGZF block")
    extra = f.read(struct.unpack_from("<H", head, 10)[0])
    size, at = None, 0
    while at + 4 <= len(extra):
        tag, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
        if tag == b"BC" and n == 2:
            size = struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    if size is None:
        raise ValueError("a BGZF block has no size")
    rest = f.read(size - 12 - len(extra))
    if len(rest) < size - 12 - len(extra):
        raise ValueError("a BGZF block is cut off")
    body, (crc, length) = rest[:-8], struct.unpack("<II", rest[-8:])
    if length > 1 << 16:
        raise ValueError("a BGZF block is too large")
    # a single stored block needs no inflating
    data = body[5 : 5 + length] if body[:1] == b"\x01" and len(body) == length + 5 else zlib.decompress(body, -15)
    if len(data) != length:
        raise ValueError("a BGZF block has the wrong length")
    if check_crc and zlib.crc32(data) != crc:
        raise ValueError("a BGZF block has the wrong checksum")
    return data


def blocks(f: BinaryIO) -> Iterator[tuple[int, int]]:
    """(offset, size) of each member, by hopping over headers."""
    at = f.seek(0)
    while head := f.read(18):
        if head[:4] != MAGIC:
            raise ValueError("not a BGZF block")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        yield at, size
        at = f.seek(at + size)


def write_block(data: bytes, level: int = 0) -> bytes:
    """One member. Level 0 stores; 10 to 12 are the largest that zlib has, 9."""
    if level == 0:
        body = b"\x01" + struct.pack("<HH", len(data), len(data) ^ 0xFFFF) + data
    else:
        z = zlib.compressobj(min(level, 9), zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        if len(body) + 26 > 1 << 16:
            return write_block(data, 0)
    head = MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, level: int = 0) -> bytes:
    return b"".join(write_block(data[i : i + MAX_DATA], level) for i in range(0, len(data), MAX_DATA))
