"""Best-fit-decreasing packing of token ids into fixed-width matrices.

Documents longer than a row are split without loss; pieces go, longest first,
to the fullest open row that still holds them.  A segment tree over remaining
capacities finds that row in logarithmic time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.tokens import default_vocabulary, encoded

SCHEMA = "sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


class CapacityTree:
    """Segment tree over capacities 0..width; a leaf is on if an open row has it."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.on = [0] * (2 * self.size)

    def change(self, capacity: int, by: int) -> None:
        """Count one row more or less with this capacity."""
        at = capacity + self.size
        while at:
            self.on[at] += by
            at >>= 1

    def at_least(self, capacity: int) -> int:
        """The smallest capacity on that is not less; -1 if there is none."""
        at = capacity + self.size
        if self.on[at]:
            return capacity
        while at > 1:
            if at % 2 == 0 and self.on[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    if not self.on[at]:
                        at += 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; no row exceeds ``width``; every piece is in one row."""
    tree, open_rows, rows = CapacityTree(width), {}, []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.at_least(lengths[piece])
        if room < 0:
            rows.append([piece])
            row, left = len(rows) - 1, width - lengths[piece]
        else:
            row = open_rows[room].pop()
            tree.change(room, -1)
            rows[row].append(piece)
            left = room - lengths[piece]
        if left:
            open_rows.setdefault(left, []).append(row)
            tree.change(left, 1)
    return rows


def pack_rows(docs: DataFrame, width: int = 2048, block_tokens: int = 1 << 20, vocabulary: str | None = None) -> DataFrame:
    """One row per packed sequence of at most ``width`` ids.

    ``ids`` holds ``width`` little-endian unsigned 32-bit ids (the end id pads
    the tail), ``positions`` the position of each id in its piece, restarting
    at every boundary (0 in the tail); ``cu_seqlens`` has the boundaries from 0
    to ``n_tokens``; ``doc_ids`` and ``starts`` name each piece.  Blocks of
    about ``block_tokens`` are packed at a time, so memory is bounded.  A null
    text is the end id alone; null doc_ids and repeated rows are packed too.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 40, 0
        pieces: list[tuple[int | None, int, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            rows = best_fit_decreasing([len(p[2]) // 4 for p in pieces], width)
            out: list[list] = [[], [], [], [], [], [], []]
            for row in rows:
                sizes = [len(pieces[i][2]) // 4 for i in row]
                ids = b"".join(pieces[i][2] for i in row).ljust(4 * width, b"\0")
                positions = np.zeros(width, "<u4")
                positions[: sum(sizes)] = np.concatenate([np.arange(n) for n in sizes])
                made = (base + number, sum(sizes), [pieces[i][0] for i in row], [pieces[i][1] for i in row], [0, *np.cumsum(sizes).tolist()], ids, positions.tobytes())
                for column, value in zip(out, made, strict=True):
                    column.append(value)
                number += 1
            pieces.clear()
            held = 0
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[part.split()[0] for part in SCHEMA.split(", ")])

        for doc_id, ids in encoded(batches, path):
            for at in range(0, len(ids), 4 * width):
                pieces.append((doc_id, at // 4, ids[at : at + 4 * width]))
            held += len(ids) // 4
            if held >= block_tokens:
                yield flush()
        if pieces:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet files of fixed-width id matrices."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def pack_report(docs: DataFrame) -> DataFrame:
    """Packed sequences with checksums in place of their ids and positions."""
    packed = pack_rows(docs)
    return packed.select(
        "sequence_id",
        "n_tokens",
        "doc_ids",
        "starts",
        "cu_seqlens",
        F.crc32("ids").cast("long").alias("ids_crc32"),
        F.crc32("positions").cast("long").alias("positions_crc32"),
    )
