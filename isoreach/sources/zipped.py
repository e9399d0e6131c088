"""Members of zip archives in pieces, which many tasks deflate, join and inflate.

A piece is whole lines, deflated by itself and flushed to a byte, so a member is
its pieces one after another and an end.  The archive's directory tells where
they lie, in a field that other readers skip.
"""

from __future__ import annotations

import csv
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.csv as pcsv

#: Bytes of text in a piece, and of a block that is copied or parsed.
PIECE_BYTES = BLOCK_BYTES = 4 << 20
#: The directory's field of pieces, what it holds of each, and how many fit beside the field of long sizes.
FIELD, ENTRY, MOST = 0x6F69, struct.Struct("<QI"), 5_000
#: The last block of a deflated stream, without content.
END = b"\x03\x00"
BATCH_ROWS = 10_000


class Piece(NamedTuple):
    """Deflated bytes in a file, and the size and checksum of their text."""

    file: str
    at: int
    size: int
    text: int
    crc: int


class Deflater:
    """Text that becomes one piece."""

    def __init__(self) -> None:
        self.out, self.made, self.text, self.crc = zlib.compressobj(wbits=-15), [], 0, 0

    def add(self, text: bytes | memoryview) -> None:
        self.made.append(self.out.compress(text))
        self.text += len(text)
        self.crc = zlib.crc32(text, self.crc)

    def end(self) -> bytes:
        return b"".join([*self.made, self.out.flush(zlib.Z_FULL_FLUSH)])


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of the checksum, bits reversed."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """Checksum of two texts one after another, from theirs and the size of the second."""
    power, bits = 1 << 23, size  # x to the 8th moves by a byte
    while bits:
        if bits & 1:
            first = _times(power, first)
        power, bits = _times(power, power), bits >> 1
    return first ^ second


def add_member(out: zipfile.ZipFile, name: str, pieces: Sequence[Piece], copied: Callable[[Piece], Iterator[bytes]]) -> None:
    """A member made of pieces; ``copied`` gives the bytes of one."""
    info = zipfile.ZipInfo(name)
    info.compress_type, info.header_offset = zipfile.ZIP_DEFLATED, out.fp.tell()
    info.compress_size, info.file_size = sum(p.size for p in pieces) + len(END), sum(p.text for p in pieces)
    for p in pieces:
        info.CRC = joined_crc(info.CRC, p.crc, p.text) if p is not pieces[0] else p.crc
    out.fp.write(info.FileHeader(zip64=True))
    for p in pieces:
        for block in copied(p):
            out.fp.write(block)
    out.fp.write(END)
    told = [(p.size, p.text, p.crc) for p in pieces]
    while len(told) > MOST:  # the first, which is the header, stays by itself
        told = told[:1] + [a if b is None else (a[0] + b[0], a[1] + b[1], joined_crc(a[2], b[2], b[1])) for a, b in zip(told[1::2], [*told[2::2], None])]
    info.extra = struct.pack("<HH", FIELD, len(told) * ENTRY.size) + b"".join(ENTRY.pack(size, crc) for size, _, crc in told)
    out.filelist.append(info)
    out.NameToInfo[name] = info
    out.start_dir, out._didModify = out.fp.tell(), True


def pieces_of(raw: BinaryIO, info: zipfile.ZipInfo) -> list[tuple[int, int, int]]:
    """(offset, size, checksum) of the pieces of a member, its header first; none if the archive does not tell them."""
    extra, told = info.extra, []
    while len(extra) >= 4:
        kind, size = struct.unpack_from("<HH", extra)
        if kind == FIELD and size % ENTRY.size == 0:
            told = list(ENTRY.iter_unpack(extra[4 : 4 + size]))
        extra = extra[4 + size :]
    if not told or info.compress_type != zipfile.ZIP_DEFLATED or sum(n for n, _ in told) + len(END) != info.compress_size:
        return []
    raw.seek(info.header_offset + 26)
    at = info.header_offset + 30 + sum(struct.unpack("<HH", raw.read(4)))
    out = []
    for size, crc in told:
        out.append((at, size, crc))
        at += size
    return out


def inflated(data: bytes, crc: int) -> bytes:
    """Text of a piece; an error if it is not what was written."""
    text = zlib.decompressobj(-15).decompress(data)
    if zlib.crc32(text) != crc:
        raise zipfile.BadZipFile("a piece of a member has another checksum")
    return text


def parsed(stream: Callable[[], BinaryIO], width: int, at: Sequence[int], header: bool) -> Iterator[list[pa.Array]]:
    """Columns ``at`` of lines with comma-separated values, as text by batches; -1 and empty values are null.

    Lines are parsed by column; from the first batch with a line of another
    ``width`` than the header's on, or with one longer than a block, row by row.
    """
    done = 0
    if width:
        used = sorted({i for i in at if i >= 0}) or [0]
        names = [f"c{i}" for i in used]
        convert = pcsv.ConvertOptions(column_types={n: pa.string() for n in names}, include_columns=names, null_values=[""], strings_can_be_null=True)
        try:
            reader = pcsv.open_csv(stream(), pcsv.ReadOptions(use_threads=False, block_size=BLOCK_BYTES, column_names=[f"c{i}" for i in range(width)]), pcsv.ParseOptions(newlines_in_values=True), convert)
            left = int(header)
            for batch in reader:
                gone = min(left, batch.num_rows)
                left -= gone
                batch = batch.slice(gone)
                for i in range(0, batch.num_rows, BATCH_ROWS):
                    some = batch.slice(i, BATCH_ROWS)
                    done += some.num_rows
                    yield [some.column(used.index(c)) if c >= 0 else pa.nulls(some.num_rows, pa.string()) for c in at]
            return
        except pa.ArrowInvalid:
            pass
    lines = csv.reader(io.TextIOWrapper(stream(), "utf-8-sig" if header else "utf-8", newline=""))
    if header:
        next(lines, None)
    rows = islice((r for r in lines if r), done, None)
    while some := list(islice(rows, BATCH_ROWS)):
        yield [pa.array([r[i] if 0 <= i < len(r) and r[i] != "" else None for r in some], pa.string()) for i in at]
