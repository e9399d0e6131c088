"""A count-min sketch of anchor grams, in bounded pieces.

Every partition counts the grams that anchor its documents' windows and emits
sparse chunks of its sketch; chunks of one place are added up one at a time.
The merged sketch never underestimates how often a window's gram anchors.  It
grows with the input, so that it always has eight cells or more per anchor: up
to ``LARGEST_BITS`` it is broadcast, beyond that its cells counted twice are a
table that segments are joined with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.repeats import Repeats, cut_segments, segments
from isoreach.llm.textrows import Rolling, changes, mix, together
from isoreach.scratch import Scratch
from isoreach.skew import join_spread

ROWS = 2  # hash rows of the sketch
CHUNK_BITS = 16  # cells per chunk, as a power of two
LARGEST_BITS = 28  # cells per row that are broadcast, at most: two rows of bits then take 64 MB
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of grams in one row of a sketch with ``2**bits`` cells."""
    return (mix(grams ^ SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def wanted_bits(text_bytes: int, bytes_per_anchor: int) -> int:
    """Cells per row for an amount of text: eight or more per expected anchor."""
    return int(max(CHUNK_BITS, np.ceil(np.log2(max(text_bytes, 1) / bytes_per_anchor * 8))))


def sketch_bits(text_bytes: int, bytes_per_anchor: int) -> int:
    """Cells per row of a sketch that is broadcast."""
    return min(LARGEST_BITS, wanted_bits(text_bytes, bytes_per_anchor))


def chunk_bits(bits: int) -> int:
    """Cells per chunk: more in a large sketch, up to what a task adds up in 16 MB."""
    return CHUNK_BITS if bits <= LARGEST_BITS else min(24, max(CHUNK_BITS, bits - 12))


def partial_sketches(docs: DataFrame, what: Repeats, bits: int) -> DataFrame:
    """Chunks (row, chunk, once, twice) of the sketch of every partition.

    A gram counts once per document where only other documents matter.
    """
    width = chunk_bits(bits)

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        grams = np.concatenate(held)
        for row in range(ROWS):
            cell, n = np.unique(cells(grams, row, bits), return_counts=True)
            chunk = cell >> width
            inside = (cell & ((1 << width) - 1)).astype("<u4" if width > 16 else "<u2")
            cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(chunk)], strict=True):
                many = n[a:b] > 1
                for column, value in zip(out, (row, int(chunk[a]), inside[a:b][~many].tobytes(), inside[a:b][many].tobytes()), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["row", "chunk", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, raw, cuts in together(batches, "text", what.together):
            x, cuts = what.symbols(raw, cuts)
            if np.diff(cuts).max() < what.window:
                continue
            owner, _, _, places = cut_segments(what, Rolling(x), cuts)
            if what.earlier:
                order = np.lexsort((places, owner))
                places = places[order][changes(places[order], owner[order])]
            held.append(places)
            n += len(places)
            if n > 1 << 20:
                yield emit(held)
                held, n = [], 0
        if held:
            yield emit(held)

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "row int, chunk int, once binary, twice binary")


def merged_sketch(partial: DataFrame, width: int = CHUNK_BITS) -> DataFrame:
    """Chunks (row, chunk, bits) with a bit for every cell counted twice or more.

    Partial chunks arrive sorted, so a task adds them up one chunk at a time.
    """
    kind = "<u4" if width > 16 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, np.zeros(1 << width, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(sums > 1).tobytes()], pa.binary())], names=["row", "chunk", "bits"])

        for batch in batches:
            for row, chunk, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, chunk) != key:
                    if key is not None:
                        yield done()
                    key = (row, chunk)
                    sums[:] = 0
                at = np.frombuffer(once, kind)
                sums[at] = np.minimum(sums[at] + 1, 2)
                sums[np.frombuffer(twice, kind)] = 2
        if key is not None:
            yield done()

    return partial.repartition("row", "chunk").sortWithinPartitions("row", "chunk").mapInArrow(run, "row int, chunk int, bits binary")


def crowded_cells(merged: DataFrame, width: int) -> DataFrame:
    """(row, cell) of every cell that the merged sketch counts twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, chunk, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cell = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))) + (chunk << width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), row, np.int32)), pa.array(cell.astype(np.int64))], names=["row", "cell"])

    return merged.mapInArrow(run, "row int, cell long")


def repeated_segments(docs: DataFrame, what: Repeats, bytes_per_anchor: int, scratch: Scratch) -> DataFrame:
    """The written segments whose gram the merged sketch counts twice or more."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = wanted_bits(size, bytes_per_anchor)
    if bits <= LARGEST_BITS:
        return scratch.table(segments(docs, what, repeated_grams(docs, what, bits)), "segments")
    width = chunk_bits(bits)
    crowded = scratch.table(crowded_cells(merged_sketch(partial_sketches(docs, what, bits), width), width), "cells")

    def cell_in(row: int) -> Callable[[np.ndarray], np.ndarray]:
        return lambda grams: cells(grams, row, bits)

    left = segments(docs, what, cells=[cell_in(row) for row in range(ROWS)])
    for row in range(ROWS):  # a passage that is everywhere has one cell: its rows are dealt over tasks
        left = scratch.table(left, f"segments{row}")
        left = join_spread(left, crowded.where(F.col("row") == row).select(F.col("cell").alias(f"c{row}")), [f"c{row}"]).drop(f"c{row}")
    return scratch.table(left, "segments")


def repeated_grams(docs: DataFrame, what: Repeats, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test, usable in workers, for grams that the merged sketch counts twice or more."""
    sketch = np.zeros((ROWS, 1 << (bits - 3)), np.uint8)
    for row, chunk, data in merged_sketch(partial_sketches(docs, what, bits)).toLocalIterator():  # at most 64 MB in all
        sketch[row, chunk << (CHUNK_BITS - 3) : (chunk + 1) << (CHUNK_BITS - 3)] = np.frombuffer(data, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def repeated(grams: np.ndarray) -> np.ndarray:
        table, keep = shared.value, np.ones(len(grams), bool)
        for row in range(ROWS):
            cell = cells(grams, row, bits)
            keep &= (table[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return keep

    return repeated
