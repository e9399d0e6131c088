"""Hierarchical packing of documents into windows of several lengths.

A document goes to the tier of the smallest window that holds it (documents
longer than the longest window give whole windows first).  A window's gap is
filled with the largest documents of shorter tiers that fit, and at last with
the head of one that is cut.  Full windows of every tier need no padding.
Windows are dealt into step groups of equal token counts over all partitions.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.llm.tokens import default_vocabulary, encoded
from isoreach.scratch import Scratch

TIERS = (1024, 512, 256, 128, 64)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, part long, at_tier long"
STEP_TOKENS = 1 << 16
PARTS = 1024  # partitions that one task counts through


class TierPacker:
    """Packs pieces (document number, start, length) held in ``waiting``.

    ``waiting`` is bounded: once more than ``hold`` tokens wait, windows are
    formed until half of them are gone, so memory does not follow the input.
    """

    def __init__(self, tiers: Sequence[int] = TIERS, hold: int = 1 << 20):
        self.tiers = sorted(tiers, reverse=True)
        self.hold, self.tokens = hold, 0
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), sorted

    def add(self, document: int, length: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Take a document; yields (tier, [(document, start, length), ...]) windows."""
        top, start = self.tiers[0], 0
        while length - start >= top:
            yield top, [(document, start, top)]
            start += top
        if start < length:
            insort(self.waiting, (length - start, document, start))
            self.tokens += length - start
        if self.tokens > self.hold:
            yield from self._drain(self.hold // 2)

    def finish(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Windows of all that still waits; only the last can need padding."""
        yield from self._drain(0)

    def _take(self, at: int, most: int) -> tuple[int, int, int]:
        """Remove a piece, or the head of it if it is longer than ``most``."""
        length, document, start = self.waiting.pop(at)
        used = min(length, most)
        if used < length:
            insort(self.waiting, (length - used, document, start + used))
        self.tokens -= used
        return document, start, used

    def _drain(self, until: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        while self.waiting and self.tokens > until:
            longest = self.waiting[-1][0]
            tier = min((t for t in self.tiers if t >= longest), default=self.tiers[0])
            while tier > self.tokens and tier != self.tiers[-1]:
                tier = self.tiers[self.tiers.index(tier) + 1]  # too little is left to fill it
            window, gap = [self._take(len(self.waiting) - 1, tier)], tier
            gap -= window[0][2]
            while gap and self.waiting:
                fits = bisect_right(self.waiting, (gap, 1 << 62, 0)) - 1
                window.append(self._take(max(fits, 0), gap))
                gap -= window[-1][2]
            yield tier, window


def pack_documents(docs: DataFrame, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of a document, with its token ids and its place.

    Every document gets the end id; a null text has that id alone.  ``ids``
    are little-endian unsigned 32-bit.  ``offset`` counts from 0 inside the
    window without gaps.  ``step_group``: see :func:`step_groups`.  Each input
    partition is packed by itself in one pass with bounded memory; its windows'
    numbers carry the partition number, so a task that runs again returns the
    same rows.  A very long text gives whole windows first.  Repeated rows and
    null doc_ids are packed like others; an empty table gives no rows.
    """
    return step_groups(_packed(docs, tiers, vocabulary), step_tokens)


def step_groups(packed: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Packed pieces with ``step_group`` in place of their partition and place in the tier.

    Windows stand in one order, by tier (the longest first), partition and
    place; each ``step_tokens`` of window lengths make a group.  So all groups
    of a tier hold as many tokens, but the one where the next tier begins can
    mix both and the last of all can hold fewer.  Only counts per partition and
    tier meet, in runs of ``PARTS`` partitions.
    """
    scratch = Scratch(packed.sparkSession, "packing")
    pieces = scratch.table(packed, "pieces")
    run = F.floor(F.col("part") / PARTS)
    counts = pieces.where("offset = 0").groupBy("tier", "part").agg((F.count(F.lit(1)) * F.first("tier")).alias("tokens")).withColumn("run", run)
    ahead = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("tier", "run").agg(F.sum("tokens").alias("tokens"))
    runs = runs.withColumn("before_run", ahead(Window.partitionBy("tier").orderBy("run")))
    levels = counts.groupBy("tier").agg(F.sum("tokens").alias("tokens")).withColumn("before_tier", ahead(Window.orderBy(F.desc("tier"))))  # one row per tier
    placed = counts.withColumn("before_part", ahead(Window.partitionBy("tier", "run").orderBy("part"))).drop("tokens")
    placed = placed.join(runs.drop("tokens"), ["tier", "run"]).join(F.broadcast(levels.drop("tokens")), "tier")
    # written, so that Spark knows its size: a few rows per partition are broadcast, many are shuffled
    starts = scratch.table(placed.select("tier", "part", (F.col("before_tier") + F.col("before_run") + F.col("before_part")).alias("before")), "starts")
    group = F.floor((F.col("before") + F.col("at_tier") * F.col("tier")) / step_tokens)
    return pieces.join(starts, ["tier", "part"]).withColumn("step_group", group).drop("part", "at_tier", "before")


def _packed(docs: DataFrame, tiers: Sequence[int] = TIERS, vocabulary: str | None = None) -> DataFrame:
    """Pieces by window, with their partition and the window's place among those of its tier."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, number = TierPacker(tiers), {}, 0
        part = TaskContext.get().partitionId()
        base = part << 40
        dealt: dict[int, int] = {}
        rows: list[tuple] = []

        def place(window: tuple[int, list[tuple[int, int, int]]]) -> None:
            nonlocal number
            tier, pieces = window
            at_tier = dealt.get(tier, 0)
            dealt[tier] = at_tier + 1
            at = 0
            for document, start, length in pieces:
                doc_id, ids, left = held[document]
                rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, base + number, at, tier, part, at_tier))
                at += length
                if left == length:
                    del held[document]
                else:
                    held[document] = (doc_id, ids, left - length)
            number += 1

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return made

        for document, (doc_id, ids) in enumerate(encoded(batches, path)):
            held[document] = (doc_id, ids, len(ids) // 4)
            for window in packer.add(document, len(ids) // 4):
                place(window)
            if len(rows) >= 4096:
                yield batch()
        for window in packer.finish():
            place(window)
        if rows:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pack_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with checksums of their ids."""
    packed = _packed(docs).withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    return step_groups(packed).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
