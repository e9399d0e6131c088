"""Benchmark passages in documents, by SimHash of item-sized windows.

A window of an item's length gets a 64-bit SimHash of its shingles.  It is
compared with the fingerprints of all items that share a shingle with the text
(others cannot reach the similarity), and candidates within the radius are
verified by the exact weighted similarity of their shingles.

The bits of a pair at similarity J differ with p = acos(2J / (1 + J)) / pi.  By
the binomial tail a pair at 0.8 is beyond the radius with probability 1e-5
(0.85: 6e-7).

Windows without any shingle of the benchmark are passed over first.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.textrows import WordHashes, covered, mix, runs_of, slices

SHINGLE, SIMILARITY = 5, 0.8
RADIUS = 23
STRETCH = 1 << 15  # windows whose votes are held at once
BLOCK_BYTES = 16 << 20  # benchmark text per pass over the documents, at most
FILTER_BITS = 22


class _Plain(WordHashes):
    """Hashes of words in lower case without punctuation at their ends."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word.decode().lower().strip(string.punctuation).encode())
        if len(self) < self.LIMIT and len(word) <= 64:
            self[word] = value
        return value


plain_words = _Plain()


def words(text: str | None) -> np.ndarray:
    """One 64-bit hash per word."""
    return plain_words.of((text or "").encode().split())


def shingles(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of ``k`` words."""
    n = len(x) - k + 1
    out = np.full(max(n, 0), np.uint64(k))
    for i in range(k):
        out = mix(out + x[i : i + max(n, 0)])
    return out


def votes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the +1 and -1 votes of each bit, from 0."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(2 * bits - 1, axis=0, dtype=np.int32)])


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from vote sums, one row each."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class Items:
    """The items of one pass, their shingles and fingerprints, in flat arrays."""

    ids: list[int]
    sizes: np.ndarray  # words
    prints: np.ndarray
    bounds: np.ndarray  # item -> its stretch of ``grams`` and ``counts``
    grams: np.ndarray  # distinct shingles of each item, sorted
    counts: np.ndarray  # how often the item has each
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # words per shingle -> sorted hashes, filter, item of each

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        ids, sizes, prints, grams, counts = [], [], [], [], []
        by_step: dict[int, list[int]] = {}
        for item_id, text in rows:
            x = words(text)
            if not len(x):
                continue
            k = min(SHINGLE, len(x))
            h = shingles(x, k)
            one, n = np.unique(h, return_counts=True)
            by_step.setdefault(k, []).append(len(ids))
            ids.append(item_id)
            sizes.append(len(x))
            grams.append(one)
            counts.append(n)
            prints.append(fingerprint(votes(h)[-1:])[0])
        known = {}
        for k, members in by_step.items():
            g, owner = np.concatenate([grams[i] for i in members]), np.repeat(members, [len(grams[i]) for i in members])
            order = np.argsort(g, kind="stable")
            table = np.zeros(1 << FILTER_BITS, bool)
            table[(g >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            known[k] = (g[order], table, owner[order])
        bounds = np.cumsum([0, *map(len, grams)])
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return Items(ids, np.array(sizes), np.array(prints, np.uint64), bounds, flat(grams, np.uint64), flat(counts, np.int64), known)

    def candidates(self, value: int, rows: np.ndarray | None = None) -> dict[int, int]:
        """Items (by row, of ``rows`` or all) within the radius of a fingerprint, with their distance."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        far = np.bitwise_count(self.prints[rows] ^ np.uint64(value))
        near = far <= RADIUS
        return dict(zip(rows[near].tolist(), far[near].tolist(), strict=True))

    def search(self, text: str | None) -> dict[int, tuple[float, int, int, int]]:
        """Best (similarity, start, words, distance) of each matching item in a text."""
        best: dict[int, tuple[float, int, int, int]] = {}
        x = words(text)
        for k, (g, table, owner) in self.known.items():
            h = shingles(x, k)
            at = np.flatnonzero(table[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(g, h[at], "left"), np.searchsorted(g, h[at], "right")
            at, low, high = at[low < high], low[low < high], high[low < high]
            if not len(at):
                continue
            owners = np.unique(np.concatenate([owner[a:b] for a, b in sorted(set(zip(low.tolist(), high.tolist(), strict=True)))]))
            for size in np.unique(self.sizes[owners]).tolist():
                self._windows(h, at, k, min(size, len(x)), owners[self.sizes[owners] == size], best)
        return best

    def _windows(self, h: np.ndarray, at: np.ndarray, k: int, width: int, rows: np.ndarray, best: dict) -> None:
        """Windows of ``width`` words that hold one of the shingles ``at``, against the items ``rows``."""
        n = width - k + 1
        last = len(h) - n
        starts, ends = runs_of(covered(np.clip(at - n + 1, 0, last), np.minimum(at, last) + 1, last + 1))
        for begin, end in zip(starts.tolist(), ends.tolist(), strict=True):
            for base in range(begin, end, STRETCH):  # long stretches in parts, so that memory is bounded
                to = min(base + STRETCH, end)
                sums = votes(h[base : to + n - 1])
                prints = fingerprint(sums[n:] - sums[: to - base])
                for row in rows.tolist():
                    far = np.bitwise_count(prints ^ self.prints[row])
                    near = np.flatnonzero(far <= RADIUS)
                    if not len(near):
                        continue
                    shared = self._shared(h[base + near[0] : base + near[-1] + n], n, row)[near - near[0]]
                    total = int(self.counts[self.bounds[row] : self.bounds[row + 1]].sum())
                    similarity = shared / (n + total - shared)
                    i = int(similarity.argmax())
                    if similarity[i] >= SIMILARITY and (row not in best or similarity[i] > best[row][0]):
                        best[row] = (float(similarity[i]), base + int(near[i]), width, int(far[near[i]]))

    def _shared(self, h: np.ndarray, n: int, row: int) -> np.ndarray:
        """Shingles that each window of ``n`` shares with an item, as often as both have them."""
        grams, counts = (x[self.bounds[row] : self.bounds[row + 1]] for x in (self.grams, self.counts))
        at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
        at = np.where(grams[at] == h, at, -1).tolist()
        room, inside, now, out = counts.tolist(), [0] * len(counts), 0, []
        for i, g in enumerate(at):
            if g >= 0:
                now += inside[g] < room[g]
                inside[g] += 1
            if i >= n - 1:
                out.append(now)
                first = at[i - n + 1]
                if first >= 0:
                    inside[first] -= 1
                    now -= inside[first] < room[first]
        return np.array(out, np.int64)


def passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of bounded size, dealt by a hash of item_id."""
    used = benchmark.where("text is not null").select("item_id", "text").distinct()
    total = used.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + total // BLOCK_BYTES
    for part in range(n):
        yield [(r[0], r[1]) for r in used.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity) of every match.

    One row per document and item with the most similar window, the first of
    equals.  Null and empty texts and items match nothing; an item of fewer
    than five words is one shingle; a document shorter than an item is one
    window.  Repeated rows give repeated matches.  Whole texts of any length are
    searched, in stretches of bounded memory.  A benchmark beyond
    ``BLOCK_BYTES`` takes several passes over the documents; an item's arrays
    take about three times its text.
    """
    schema = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
    out = None
    for rows in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _built(shared)
            for batch in slices(batches):
                found = [(doc_id, items.ids[row], start, width, distance, similarity) for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row, (similarity, start, width, distance) in items.search(text).items()]
                if found:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[p.split()[0] for p in schema.split(", ")])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


_items: list[tuple[list, Items]] = []


def _built(shared) -> Items:
    """The index of a broadcast part, built once per worker."""
    rows = shared.value
    if not _items or _items[0][0] is not rows:
        _items[:] = [(rows, Items.of(rows))]
    return _items[0][1]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage; columns stay, nothing is shuffled."""
    at, names = docs.columns.index("text"), docs.columns
    for rows in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _built(shared)
            for batch in slices(batches):
                clean = pa.array([not items.search(text) for text in batch.column(at).to_pylist()], pa.bool_())
                yield batch.filter(clean)

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*names)
