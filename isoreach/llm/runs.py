"""Runs: maximal stretches of words with a period, from the factors of Lempel and Ziv.

Prefix doubling gives the suffix array of a text and, on the way, the classes of
equal stretches of 1, 2, 4, ... words; any two positions' longest common
extension, and so the LCP of neighbours, is read off those classes.  The
nearest smaller positions in the suffix array give the longest previous factor
(LPF) of every position, and following it the LZ blocks.

A run that touches the boundary in front of block ``h`` and ends in that block
reaches less than its period beyond the start of block ``h - 1`` (else block
``h - 1`` would have been longer).  So only periods ``p`` with ``(e - 1) * p <
len(h - 1) + len(h)`` are tried at that boundary, ``e`` being the least
exponent, each by extensions in both directions (Main).  All other runs lie
strictly inside a block, whose words are a copy of earlier ones; they are
copied from the buckets of earlier runs by start, from left to right.

Texts are handled together, some thousands of words at once, each with word
numbers of its own, so that nothing matches across texts.  Memory is about four
bytes per word and doubling round, plus the words.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.textrows import covered

BATCH_WORDS = 1 << 16  # texts are handled together up to so many words
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Repeats:
    """Suffix array of a sequence of numbers, with the classes of its stretches of 2**k."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        self.array = order.copy()
        slots, positions, keys = np.arange(n), order, symbols[order]
        rank = np.full(n + 1, n, np.int64)  # the end sorts last
        self.levels: list[np.ndarray] = []
        k = 0
        while len(slots):
            fresh = np.ones(len(keys), bool)
            fresh[1:] = keys[1:] != keys[:-1]
            rank[positions] = np.maximum.accumulate(np.where(fresh, slots, 0))
            self.array[slots] = positions
            alone = fresh & np.append(fresh[1:], True)
            slots, positions = slots[~alone], positions[~alone]
            if not k or len(slots):  # levels beyond the last repeat tell nothing
                self.levels.append(rank.astype(np.int32))
            if not k:
                self.shared = slots
            keys = rank[positions] * (n + 1) + rank[np.minimum(positions + (1 << k), n)]
            inner = np.argsort(keys, kind="stable")
            positions, keys, k = positions[inner], keys[inner], k + 1

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from positions ``i < j`` on."""
        return self._common(i, j, lambda at, length, step: at + length)

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch up to positions ``i < j``, both included."""
        return self._common(i, j, lambda at, length, step: at - length - step + 1)

    def _common(self, i: np.ndarray, j: np.ndarray, at: Callable) -> np.ndarray:
        def equal(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a >= 0) & (level[np.maximum(a, 0)] == level[np.maximum(b, 0)])

        out = equal(self.levels[0], i, j).astype(np.int64)
        if len(self.levels) == 1:
            return out
        rest = np.flatnonzero(out)
        rest = rest[equal(self.levels[1], at(i[rest], 0, 2), at(j[rest], 0, 2))]
        i, j, length = i[rest], j[rest], np.zeros(len(rest), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = equal(self.levels[k], at(i, length, 1 << k), at(j, length, 1 << k))
            length += same.astype(np.int64) << k
        out[rest] = length
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """LPF of every position and an earlier position where that factor starts."""
        slots = self.shared  # other words occur once
        here = self.array[slots].tolist()
        left, right = [-1] * len(here), [-1] * len(here)
        for k, at in enumerate(here):
            j = k - 1
            while j >= 0 and here[j] > at:
                right[j] = k
                j = left[j]
            left[k] = j
        positions = np.array(here, np.int64)
        length, source = np.zeros(self.n, np.int64), np.full(self.n, -1, np.int64)
        for side in (left, right):
            near = np.array(side, np.int64)
            has = near >= 0
            mine, other = positions[has], positions[near[has]]
            common = self.ahead(other, mine)
            better = common > length[mine]
            length[mine[better]], source[mine[better]] = common[better], other[better]
        return length, source


def blocks(factors: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks, and the end of the sequence."""
    at, starts, steps = 0, [], factors.tolist()
    while at < len(steps):
        starts.append(at)
        at += steps[at] or 1
    return np.array([*starts, at], np.int64)


def boundary_runs(repeats: Repeats, bounds: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """(start, end, period) of the runs that touch a boundary of blocks."""
    lengths = np.diff(bounds)
    both = np.append(lengths, 0) + np.insert(lengths, 0, 0)
    tries = np.maximum(both - 1, 0) // (exponent - 1)
    b = np.repeat(bounds, tries)
    p = np.arange(len(b)) - np.repeat(np.cumsum(tries) - tries, tries) + 1
    words, n = repeats.levels[0], repeats.n

    def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (i >= 0) & (j < n) & (words[np.clip(i, 0, n)] == words[np.clip(j, 0, n)])

    right = equal(b, b + p)
    left = (b - p >= 0) & (equal(b - 1 - p, b - 1) | equal(b - p, b))
    found = []
    for at, q in ((b[right], p[right]), (b[left] - p[left], p[left])):
        start = at - repeats.behind(at - 1, at + q - 1)
        end = at + q + repeats.ahead(at, at + q)
        whole = end - start >= np.maximum(exponent * q, least)
        found.append(np.stack([start[whole], end[whole], q[whole]], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of several periods the least
    return rows[first]


def find_runs(symbols: np.ndarray, exponent: int = 2, least: int = 2) -> np.ndarray:
    """(start, end, period) of all runs of a sequence of numbers, by start and period.

    A run has its smallest period, ``exponent`` (2 or more) periods and
    ``least`` symbols at least, and no neighbour extends it.
    """
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    if len(symbols) < max(exponent, least):
        return np.zeros((0, 3), np.int64)
    repeats = Repeats(symbols)
    factors, source = repeats.previous_factors()
    bounds = blocks(factors)
    rows = boundary_runs(repeats, bounds, exponent, least)
    if not len(rows):
        return rows
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for start, end, period in rows.tolist():
        buckets[start].append((end, period))
    shortest = max(exponent, least)
    copied = []
    long = np.flatnonzero(np.diff(bounds) >= shortest + 2)
    for b, e in zip(bounds[long].tolist(), bounds[long + 1].tolist(), strict=True):
        src = int(source[b])
        shift, stop = b - src, src + e - b
        for start in range(src + 1, stop - shortest):
            for end, period in buckets.get(start, ()):
                if end < stop:
                    buckets[start + shift].append((end + shift, period))
                    copied.append((start + shift, end + shift, period))
    if copied:
        rows = np.concatenate([rows, np.array(copied, np.int64)])
    return rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that the query plants by ``doc_id`` (null: none)."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, exponent: int = 2, least: int = 2, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Every text's runs and the text without their repetitions, one row per row of ``docs``.

    Returns ``doc_id``, ``n_words``, ``runs`` (by start and period) and
    ``collapsed``: the words (between ASCII white space) joined by one space,
    without those that a run holds after its first period.  ``change`` may
    replace the words of a document first.  A null, empty or blank text has no
    words, no runs and an empty ``collapsed``; equal rows give equal rows; other
    columns are not read.  There is no shuffle.
    """

    def results(rows: list[tuple[int | None, list[bytes]]], codes: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(words) for _, words in rows], np.int64)
        ends = np.cumsum(sizes)
        found = find_runs(np.concatenate(codes), exponent, least) if codes else np.zeros((0, 3), np.int64)
        cuts = np.searchsorted(found[:, 0], ends, side="left")  # a run starts in its text
        columns: list[list] = [[], [], [], []]
        at = 0
        for (doc_id, words), size, end, cut in zip(rows, sizes.tolist(), ends.tolist(), cuts.tolist(), strict=True):
            mine = found[at:cut] - [end - size, end - size, 0]
            at = cut
            kept = words
            if len(mine):
                gone = covered(mine[:, 0] + mine[:, 2], mine[:, 1], size)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            runs = [{"start": s, "length": e - s, "period": p} for s, e, p in mine.tolist()]
            for column, value in zip(columns, (doc_id, size, runs, b" ".join(kept).decode(errors="replace")), strict=True):
                column.append(value)
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind, pa.string()), strict=True)], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, codes, offset, held = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                words = change(doc_id, words) if change else words
                numbers: dict[bytes, int] = {}
                code = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                rows.append((doc_id, words))
                codes.append(code + offset)
                offset, held = offset + len(numbers), held + len(words)
                if held >= BATCH_WORDS or len(rows) >= 1000:
                    yield results(rows, codes)
                    rows, codes, offset, held = [], [], 0, 0
        if rows:
            yield results(rows, codes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def _strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equal ones the first by start, then period."""

    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def report(docs: DataFrame) -> DataFrame:
    """The digest of every document's runs of six words and four periods or more, planted ones included."""
    found = periodic_runs(docs, 4, 6, planted).withColumn("best", _strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
