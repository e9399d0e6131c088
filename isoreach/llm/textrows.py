"""Helpers shared by the operators that read whole texts in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROWS = 256  # rows handled at once, so that memory stays small whatever the Arrow batch


def row_key() -> list[Column]:
    """(doc_id, fingerprint of the text): rows equal in both are the same document."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("fp")]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short slices."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after another, and where each begins (and the last ends); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    cuts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and cuts[-1] > cuts[0] else np.zeros(0, np.uint8)
    return raw, cuts - cuts[0]


def together(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``size`` bytes of their column ``text`` (a longer text is alone), with that column laid flat."""
    for batch in batches:
        raw, cuts = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), raw[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at]
            at = to


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` whole numbers from ``starts[i]`` on, for every ``i``."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def changes(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns differs from the place before; the first one is one."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a limit."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT and len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


word_hashes = WordHashes()

SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
EIGHT = 8
LONGEST = 64  # bytes of a word that are hashed eight at a time over all words; longer words are hashed alone
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(EIGHT + 1)], np.uint64)
LENGTHS = mix(np.arange(1, LONGEST + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of flat texts start and end, and the number of words before each text (and in all)."""
    inside = ~SPACES[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = cuts[(cuts > 0) & (cuts < len(raw))]  # no word goes on in the next text
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, cuts)


def hashes_of_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by their length and bytes."""
    padded = np.concatenate([raw, np.zeros(EIGHT, np.uint8)])
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from any place on
    size = ends - starts
    x = mix((eights[starts] & FIRST_BYTES[np.minimum(size, EIGHT)]) ^ LENGTHS[np.minimum(size, LONGEST)])
    more = np.flatnonzero((size > EIGHT) & (size <= LONGEST))
    done = EIGHT
    while len(more):
        part = eights[starts[more] + done] & FIRST_BYTES[np.minimum(size[more] - done, EIGHT)]
        with np.errstate(over="ignore"):
            x[more] = mix((x[more] * MIX_B) ^ part)
        done += EIGHT
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONGEST).tolist():
        x[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


BASES = (Powers(0x9E3779B97F4A7C15 | 1), Powers(0xC2B2AE3D27D4EB4F | 1))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit symbols, from prefix sums.

    The hash of ``[a, b)`` is ``sum x[i] * base**(i - a)`` modulo 2**64, mixed.
    """

    def __init__(self, symbols: np.ndarray, which: int = 0):
        with np.errstate(over="ignore"):
            up, self.down = BASES[which].to(len(symbols) + 1)
            self.sums = np.zeros(len(symbols) + 1, np.uint64)
            np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def of(self, a, b) -> np.ndarray:
        """Hashes of the stretches from ``a`` (inclusive) to ``b`` (exclusive)."""
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * self.down[a])

    def every(self, width: int) -> np.ndarray:
        """Hashes of all stretches of one width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of every window of ``width`` values.

    ``values`` must leave the low 24 bits free; arrays are shorter than 2**24.
    Running minima from both ends of blocks give each window in two lookups.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    keyed = values | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


HIGH = np.uint64(0xFFFFFFFFFF000000)
SEGMENT = (1 << 24) - 1


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` grams the position of its least gram.

    Long inputs are handled in overlapping stretches.
    """
    out = []
    for at in range(0, max(len(grams) - width + 1, 0), SEGMENT - width):
        part = grams[at : at + SEGMENT] & HIGH
        found = window_minima(part, width) + at
        out.append(found[: SEGMENT - width])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed integers."""
    return x.view(np.int64)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions inside any of the stretches."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
