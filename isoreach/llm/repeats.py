"""Exact search for repeated windows of a fixed length, in few shuffled rows.

A text is a sequence of symbols (words or bytes) and every stretch of
``window`` symbols is a window.  Each window has an anchor, its least gram
(``gram`` symbols) by hash, so equal windows have equal anchors wherever they
start.  Consecutive windows with one anchor form a segment, and its union is
the stretch they cover together.

1. Segments are grouped by union.  Where a union is repeated, all windows of
   the segment are.
2. Where not even the anchor's gram is repeated, no window of the segment is.
3. What is left are segments at the edges of repeated passages.  For their
   grams, each different union once is cut into blocks of windows (by their
   distance to the anchor), and the same two tests are made with blocks: their
   union, and the core that all windows of a block share.  Blocks that are
   still open give their windows, which are grouped one by one.

Hashes have 128 bits wherever equality decides.  Groups are only counted and
reduced to a least document, with partial aggregation, never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.textrows import Rolling, anchors, changes, covered, hashes_of_words, mix, ranges, row_key, signed, slices, together, words_of
from isoreach.scratch import Scratch

SEGMENTS = "doc_id long, fp long, a int, b int, g long, u1 long, u2 long"
PIECES = "u1 long, u2 long, piece binary"
BLOCKS = "u1 long, u2 long, lo int, hi int, c long, b1 long, b2 long"
WINDOWS = "b1 long, b2 long, at int, w1 long, w2 long"
BLOCK = 16  # windows of a block


@dataclass(frozen=True)
class Repeats:
    """What is searched: symbols, window and gram length, and which repeats count.

    ``earlier``: a window counts if it also starts in a document with a
    smaller doc_id; otherwise if it starts anywhere else.
    """

    by_words: bool
    window: int
    gram: int
    earlier: bool

    @property
    def together(self) -> int:
        """Bytes of texts that are handled as one sequence: its arrays stay in the processor's cache."""
        return 1 << 17 if self.by_words else 1 << 16

    def symbols(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit symbols of flat texts, and the place in them where each text begins (and the last ends)."""
        if not self.by_words:
            return BYTE_SYMBOLS[raw], cuts
        starts, ends, cuts = words_of(raw, cuts)
        return hashes_of_words(raw, starts, ends), cuts

    def starts(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows that lie in one text, and that text."""
        counts = np.maximum(np.diff(cuts) - self.window + 1, 0)
        return ranges(cuts[:-1], counts), np.repeat(np.arange(len(counts)), counts)

    def hashes(self, x: np.ndarray) -> tuple[Rolling, Rolling]:
        """Two independent rolling hashes of a symbol sequence."""
        with np.errstate(over="ignore"):
            return Rolling(x), Rolling(mix(x + np.uint64(0x51ED2701)), 1)

    def grams(self, first: Rolling) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every gram, and the anchor position of every window."""
        grams = first.every(self.gram)
        return grams, anchors(grams, self.window - self.gram + 1)


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=np.uint64))


def _table(columns: Sequence[np.ndarray], schema: str) -> pa.RecordBatch:
    names = [part.split() for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c).cast(kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def cut_segments(what: Repeats, first: Rolling, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, gram) of the segments of flat texts.

    Starts count over all texts; no window goes from one text into the next.
    """
    grams, anchor = what.grams(first)
    at, owner = what.starts(cuts)
    anchor = anchor[at]
    lo = changes(anchor, owner)
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    return owner[lo], at[lo], at[hi], grams[anchor[lo]]


def segments(docs: DataFrame, what: Repeats, wanted: Callable[[np.ndarray], np.ndarray] | None = None, cells: Sequence[Callable[[np.ndarray], np.ndarray]] = ()) -> DataFrame:
    """Segments of all documents; ``wanted`` keeps those whose gram it accepts.

    Each function of ``cells`` adds a column ``c0``, ``c1``, ... of its values of the gram.
    """
    schema = ", ".join([SEGMENTS, *[f"c{i} long" for i in range(len(cells))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, cuts in together(batches, "text", what.together):
            x, cuts = what.symbols(raw, cuts)
            if np.diff(cuts).max() < what.window:
                continue
            first, second = what.hashes(x)
            owner, start, end, g = cut_segments(what, first, cuts)
            if wanted is not None:
                keep = wanted(g)
                owner, start, end, g = owner[keep], start[keep], end[keep], g[keep]
            base, to = cuts[owner], end + what.window
            yield _table((_longs(batch, "doc_id")[owner], _longs(batch, "fp")[owner], start - base, end - base, signed(g), signed(first.of(start, to)), signed(second.of(start, to)), *[f(g) for f in cells]), schema)

    return docs.where("doc_id is not null").select(*row_key(), "text").mapInArrow(run, schema)


def _pieces(docs: DataFrame, chosen: DataFrame, what: Repeats) -> DataFrame:
    """The stretch of text under each chosen segment."""
    listed = chosen.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("a", "b", "u1", "u2")).alias("segs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            for text, segs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                words = raw.split() if what.by_words else None
                for s in segs:
                    to = s["b"] + what.window
                    piece = b" ".join(words[s["a"] : to]) if what.by_words else raw[s["a"] : to]
                    for column, value in zip(out, (s["u1"], s["u2"], piece), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["u1", "u2", "piece"])

    rows = docs.select(*row_key(), "text").join(listed.hint("merge"), ["doc_id", "fp"]).select("text", "segs")
    return rows.mapInArrow(run, PIECES)


def _blocks(pieces: DataFrame, what: Repeats) -> DataFrame:
    """Blocks of windows, aligned to the anchor, with the hashes of core and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, cuts in together(batches, "piece", what.together):
            x, cuts = what.symbols(raw, cuts)
            first, second = what.hashes(x)
            at, owner = what.starts(cuts)
            anchor = what.grams(first)[1][cuts[:-1]]  # one for all windows of a piece
            block = (anchor[owner] - at) // BLOCK
            lo = changes(block, owner)
            hi = np.concatenate([lo[1:], [len(at)]]) - 1
            piece = owner[lo]
            last = anchor[piece] - block[lo] * BLOCK  # start of the last window of the whole block
            core = signed(first.of(last, last - BLOCK + 1 + what.window))
            start, end, base = at[lo], at[hi], cuts[piece]
            to = end + what.window
            yield _table((_longs(batch, "u1")[piece], _longs(batch, "u2")[piece], start - base, end - base, core, signed(first.of(start, to)), signed(second.of(start, to))), BLOCKS)

    return pieces.mapInArrow(run, BLOCKS)


def _windows(pieces: DataFrame, chosen: DataFrame, what: Repeats) -> DataFrame:
    """Windows of chosen blocks, one row each; ``at`` counts from the block's start."""
    listed = chosen.groupBy("u1", "u2").agg(F.collect_list(F.struct("lo", "hi", "b1", "b2")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, cuts in together(batches, "piece", what.together):
            x, cuts = what.symbols(raw, cuts)
            first, second = what.hashes(x)
            parts = batch.column("parts")
            lo, hi, b1, b2 = (c.to_numpy(zero_copy_only=False) for c in parts.flatten().flatten())
            base = np.repeat(cuts[:-1], pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            counts = hi.astype(np.int64) - lo + 1
            start = ranges(base + lo, counts)
            part = np.repeat(np.arange(len(counts)), counts)
            to = start + what.window
            yield _table((b1[part], b2[part], start - (base + lo)[part], signed(first.of(start, to)), signed(second.of(start, to))), WINDOWS)

    return pieces.join(listed.hint("merge"), ["u1", "u2"]).select("piece", "parts").mapInArrow(run, WINDOWS)


def _still_open(groups: DataFrame, by: str, what: Repeats, wanted: Column) -> DataFrame:
    """Values of ``by`` that hold an open and wanted group with a possible partner."""
    if what.earlier:
        found = groups.groupBy(by).agg(F.min("rep.doc_id").alias("least"), F.max("rep.doc_id").alias("most"), F.bool_or(wanted).alias("any"))
        return found.where("least < most and any").select(by, "least")
    found = groups.groupBy(by).agg(F.sum("n").alias("all"), F.bool_or(wanted & (F.col("n") == 1)).alias("any"))
    return found.where("all > 1 and any").select(by)


def find(docs: DataFrame, what: Repeats, segs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, fp, marks) with marks an array of (a, b, at): repeated window starts.

    ``at`` null: all starts from ``a`` to ``b``; otherwise offsets from ``a``.
    ``segs`` is a written table of segments.
    """
    place = F.struct("doc_id", "fp", "a", "b")
    by_union = scratch.table(segs.groupBy("u1", "u2", "g").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("n")), "unions")
    # written tables on both sides of a join can be dealt anew where a key is hot
    edges = scratch.table(_still_open(by_union, "g", what, F.lit(True)), "edges")
    is_open = F.col("rep.doc_id") > F.col("least") if what.earlier else F.col("n") == 1
    chosen = scratch.table(by_union.join(edges, "g").select("u1", "u2", "rep.*", is_open.alias("open")), "chosen")
    pieces = scratch.table(_pieces(docs, chosen, what), "pieces")
    blocks = _blocks(pieces, what).join(chosen.select("u1", "u2", "doc_id", "open").hint("merge"), ["u1", "u2"])
    blocks = scratch.table(blocks, "blocks")

    spot = F.struct("doc_id", "u1", "u2", "lo", "hi")
    by_block = scratch.table(blocks.groupBy("c", "b1", "b2").agg(F.min(spot).alias("rep"), F.count(F.lit(1)).alias("n"), F.bool_or("open").alias("wanted")), "by_block")
    edges = scratch.table(_still_open(by_block, "c", what, F.col("wanted")), "block_edges")
    narrowed = by_block.join(edges, "c").select("b1", "b2", "rep.*", is_open.alias("open"))
    narrowed = scratch.table(narrowed, "narrowed")
    windows = _windows(pieces, narrowed, what).join(narrowed.select("b1", "b2", "doc_id", "open").hint("merge"), ["b1", "b2"])
    windows = scratch.table(windows, "windows")
    grouped = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1")
    grouped = scratch.table(grouped, "grouped")
    again = F.col("least") < F.col("doc_id") if what.earlier else F.lit(True)
    single = windows.where("open").select("b1", "b2", "at", "w1", "w2", "doc_id").join(grouped, ["w1", "w2"]).where(again)
    single = single.groupBy("b1", "b2").agg(F.collect_set("at").alias("some"))

    marked = blocks.where("open").join(by_block.select("b1", "b2", F.col("rep.doc_id").alias("first"), "n").hint("merge"), ["b1", "b2"]).join(single.hint("merge"), ["b1", "b2"], "left")
    all_of = F.col("doc_id") > F.col("first") if what.earlier else F.col("n") > 1
    starts = F.when(all_of, F.sequence("lo", "hi")).otherwise(F.transform("some", lambda i: F.col("lo") + i))
    hits = marked.where(all_of | F.col("some").isNotNull()).groupBy("u1", "u2").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(starts)))).alias("at"))

    # unions that mark anything: repeated ones, and those with repeated windows
    marking = by_union.join(hits.hint("merge"), ["u1", "u2"], "left").where("n > 1 or at is not null").select("u1", "u2", F.col("rep.doc_id").alias("first"), "n", "at")
    marking = scratch.table(marking, "marking")
    scratch.drop("edges", "chosen", "pieces", "blocks", "by_block", "block_edges", "narrowed", "windows", "grouped")
    whole = F.col("doc_id") > F.col("first") if what.earlier else F.col("n") > 1
    own = F.col("at").isNotNull() & (F.col("doc_id") == F.col("first"))
    placed = segs.join(marking.hint("merge"), ["u1", "u2"]).where(whole | own)
    mark = F.struct("a", "b", F.when(~whole, F.col("at")).alias("at"))
    return placed.groupBy("doc_id", "fp").agg(F.collect_list(mark).alias("marks"))


def removed(marks: list[dict], n: int, window: int) -> np.ndarray:
    """Mask of the symbols that the marked windows cover."""
    starts, ends = [], []
    for m in marks or ():
        if m["at"] is None:
            starts.append(m["a"])
            ends.append(m["b"] + window)
        else:
            starts += [m["a"] + i for i in m["at"]]
            ends += [m["a"] + i + window for i in m["at"]]
    return covered(np.array(starts, np.int64), np.array(ends, np.int64), n)


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, text, marks) of every document."""
    return docs.select(*row_key(), "text").join(marks.hint("merge"), ["doc_id", "fp"], "left").select("doc_id", "text", "marks")
