"""BAM files as a Spark data source, format "bam", and as a sink.

A file is read in byte ranges: a range starts at its first BGZF block, and there at the first byte from which a chain of
plausible records leads far enough. The range before, which knows where its records end, checks that place, so no record
is lost or read twice without an error. Paths are local or on a shared mount.
"""

from __future__ import annotations

import os
import shutil
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.taskcontext import TaskContext

from . import bam_codec, bgzf

SCHEMA = "split int, row long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, aux array<string>"
MAGIC = b"BAM\x01"
#: A start is where plausible records lead through this many bytes, and at least this many of them.
CHAIN_BYTES, CHAIN_RECORDS = 4 << 16, 3
# Fixed value: bytes of a record's fixed fields and longest name.
HEAD = 36 + 255


def detect_format(path: str) -> str:
    """"bam" or "sam", by the first byte; ValueError for other and empty files."""
    with open(path, "rb") as f:
        first = f.read(1)
    if first in (b"\x1f", b"@"):
        return "bam" if first == b"\x1f" else "sam"
    raise ValueError(f"{path} is empty or neither BAM nor SAM")


class _Stream:
    """Decoded bytes from a block's offset on."""

    def __init__(self, f, offset: int, check_crc: bool):
        self.f, self.check_crc, self.data, self.place = f, check_crc, b"", 0
        self.base = 0  # bytes of the stream before data
        self.begun: list[tuple[int, int]] = []  # where blocks begin: in the stream, in the file
        f.seek(offset)

    def more(self, n: int = 1) -> bool:
        """Read at least n further bytes; False if the file has fewer."""
        parts, self.base, self.place = [self.data[self.place :]], self.base + self.place, 0
        size = len(parts[0])
        wanted = size + n
        while size < wanted:
            offset = self.f.tell()
            block = bgzf.read_block(self.f, self.check_crc)
            if block is None:
                break
            if block:
                self.begun.append((self.base + size, offset))
                parts.append(block)
                size += len(block)
        self.data = b"".join(parts)
        return size >= wanted

    def ended(self) -> bool:
        """No byte is left."""
        while self.place == len(self.data):
            if not self.more():
                return True
        return False

    def block(self) -> int:
        """The file's offset of the block that the next byte is in."""
        while len(self.begun) > 1 and self.begun[1][0] <= self.base + self.place:
            self.begun.pop(0)
        return self.begun[0][1]

    def where(self) -> tuple[int, int]:
        """The next byte's block, and its place in there."""
        block = self.block()
        return block, self.base + self.place - self.begun[0][0]

    def take(self, n: int) -> bytes:
        missing = n - (len(self.data) - self.place)
        if missing > 0 and not self.more(missing):
            raise ValueError("the BAM file is cut off")
        self.place += n
        return self.data[self.place - n : self.place]


def read_header(path: str, check_crc: bool = True) -> tuple[list[str], list[tuple[str, int]], int]:
    """Header lines, the references, and the number of bytes before the first record. ValueError if text and references disagree."""
    with open(path, "rb") as f:
        s = _Stream(f, 0, check_crc)
        if s.take(4) != MAGIC:
            raise ValueError(f"{path} is not BAM")
        number = lambda: struct.unpack("<i", s.take(4))[0]
        size = number()
        lines = s.take(size).rstrip(b"\0").decode().splitlines() if size else []
        refs, used = [], 12 + size
        for _ in range(number()):
            n = number()
            name = s.take(n)[:-1].decode()
            refs.append((name, number()))
            used += 8 + n
    said = []
    for line in lines:
        if line.startswith("@SQ"):
            tags = dict(x.split(":", 1) for x in line.split("\t")[1:])
            said.append((tags["SN"], int(tags["LN"])))
    if any(n <= 0 for _, n in refs) or (said and said != refs):
        raise ValueError(f"{path}: the references don't match the header's @SQ lines")
    return lines, refs, used


class _Range(InputPartition):
    def __init__(self, number: int, start: int, stop: int):
        self.number, self.start, self.stop = number, start, stop


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.size = int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.check_crc = options.get("checkcrc", options.get("checkCrc", "true")).lower() != "false"
        _, self.refs, self.skip = read_header(self.path, self.check_crc)

    def partitions(self):
        total = os.path.getsize(self.path)
        return [_Range(i, s, min(s + self.size, total)) for i, s in enumerate(range(0, max(total, 1), self.size))]

    def _start(self, f, start: int) -> int | None:
        """The first block at or after start."""
        if start == 0:
            return 0
        f.seek(start)
        data = f.read((1 << 16) * 2 + 32)
        at = data.find(bgzf.MAGIC)
        while at >= 0:
            try:
                f.seek(start + at)
                bgzf.read_block(f, True)
                return start + at
            except Exception:  # noqa: BLE001 - any failure to decode means that no block starts here
                at = data.find(bgzf.MAGIC, at + 1)
        return None

    def _stream(self, f, part: _Range) -> _Stream | None:
        """The file from the range's first record on; None if no record starts in the range."""
        first = self._start(f, part.start)
        if first is None or first >= part.stop:
            return None
        s = _Stream(f, first, self.check_crc)
        if first == 0:
            s.take(self.skip)
            return s
        return s if self._align(s, part.stop) else None

    def read(self, part: _Range) -> Iterator[tuple]:
        names = [n for n, _ in self.refs]
        with open(self.path, "rb") as f:
            s = self._stream(f, part)
            if s is None:
                return
            row = 0
            # a record belongs to the range in which the block of its first byte begins
            while not s.ended() and s.block() < part.stop:
                size = struct.unpack("<I", s.take(4))[0]
                if size > bam_codec.MAX_RECORD:
                    raise ValueError("a BAM record is too large")
                yield (part.number, row, *bam_codec.decode(s.take(size), names))
                row += 1
            self._check(part, None if s.ended() else s.where())

    def _check(self, part: _Range, place: tuple[int, int] | None) -> None:
        """ValueError if the ranges after part, up to that of the next record's place (None: the file's end), would start elsewhere."""
        with open(self.path, "rb") as f:
            for later in self.partitions()[part.number + 1 :]:
                s = self._stream(f, later)
                here = place is not None and place[0] < later.stop
                if (None if s is None else s.where()) != (place if here else None):
                    raise ValueError(f"{self.path}: the first record after byte {later.start} can't be told; read the file with a larger splitBytes")
                if here:
                    return

    def _align(self, s: _Stream, stop: int) -> bool:
        """Move to the first record that starts in the stream; False if none does before the block at stop.

        Its chain of plausible records leads through CHAIN_BYTES and CHAIN_RECORDS, however far these reach, or to the file's end.
        """
        going = True
        while not s.ended() and s.block() < stop:
            end, n = 0, 0
            while end is not None and (end < CHAIN_BYTES or n < CHAIN_RECORDS):
                left = len(s.data) - s.place
                if going and left < end + HEAD:
                    going = s.more(max(end + HEAD - left, left))
                    left = len(s.data)
                if end >= left:
                    break
                next_end = bam_codec.plausible(s.data, s.place + end, len(self.refs))
                end, n = None if next_end is None else next_end - s.place, n + 1
            if end is not None and (n >= CHAIN_RECORDS or end == left):
                return True
            s.place += 1
        return False


class BamWriter(DataSourceWriter):
    """Each partition writes its records as BGZF; the driver puts header, parts and end together."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.level = int(options.get("compressionlevel", options.get("compressionLevel", 0)))
        if not 0 <= self.level <= 12:
            raise ValueError("compressionLevel must be 0 to 12")
        if not self.path.endswith(".bam"):
            raise ValueError("the output's name must end with .bam")
        self.header = options.get("header", "")

    def _refs(self) -> list[tuple[str, int]]:
        tags = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in self.header.splitlines() if line.startswith("@SQ")]
        return [(t["SN"], int(t["LN"])) for t in tags]

    def write(self, rows):
        number = TaskContext.get().partitionId()
        os.makedirs(f"{self.path}.parts", exist_ok=True)
        name = f"{self.path}.parts/{number:06d}-{TaskContext.get().taskAttemptId()}"
        tids, held = {n: i for i, (n, _) in enumerate(self._refs())}, bytearray()
        with open(name, "wb") as f:
            for row in rows:
                held += bam_codec.encode(row.asDict(), tids)
                while len(held) >= bgzf.MAX_DATA:
                    f.write(bgzf.write_block(bytes(held[: bgzf.MAX_DATA]), self.level))
                    del held[: bgzf.MAX_DATA]
            if held:
                f.write(bgzf.write_block(bytes(held), self.level))
        message = WriterCommitMessage()
        message.part = (number, name)
        return message

    def commit(self, messages):
        refs, text = self._refs(), self.header.encode()
        head = MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
        for n, length in refs:
            head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", length)
        with open(self.path, "wb") as out:
            out.write(bgzf.compress(head, self.level))
            for _, name in sorted(m.part for m in messages if m is not None):
                with open(name, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(bgzf.EOF)
        shutil.rmtree(f"{self.path}.parts", ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(f"{self.path}.parts", ignore_errors=True)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return BamWriter(dict(self.options))


FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "aux")


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").options(**options).load(path)


def write(records: DataFrame, path: str, header: list[str], level: int = 0) -> None:
    """records in output order (with FIELDS) to one file."""
    records.sparkSession.dataSource.register(BamSource)
    text = "".join(x + "\n" for x in header)
    records.select(*FIELDS).write.format("bam").mode("append").option("header", text).option("compressionLevel", str(level)).save(path)
