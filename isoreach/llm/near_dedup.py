"""Near-duplicate documents by fast similarity sketches, banding and exact checks.

A sketch has one coordinate per bin.  In each of the first ``BINS`` rounds
every shingle is thrown into one random bin; later rounds serve one bin each,
so every coordinate fills.  A coordinate keeps its value of the earliest round.
Sketches of sets with Jaccard similarity J agree in a share J of coordinates,
with the concentration of independent samples.

Bands of coordinates propose links, and each link is confirmed on the full sets.
Only links that join components matter, so the members of a bucket are compared

1. with the least class of equal sets in it,
2. where they are not of its largest component, with the member of that
   component that has most links so far (the text that others are copies of),
3. where components are still apart, block by block: a pair of blocks is one
   row, compared inside one call.

Before any text is read, parity bitmaps drop pairs that cannot reach the
similarity: a bit of the bitmap is the parity of the shingles that fall on it,
so two bitmaps differ in no more bits than their sets in shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.graph.components import components
from isoreach.llm.textrows import mix, row_key, signed, slices, word_hashes
from isoreach.scratch import Scratch
from isoreach.skew import join_spread

BANDS, WIDTH = 40, 6  # a link at 0.8 shares no band with probability below 6e-6
BINS = BANDS * WIDTH
SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64))
LOW = np.uint64(0xFFFFFFFF)
PARITY_BITS = 8  # bits of a parity bitmap per shingle, at least
BLOCK_BYTES = 1 << 15  # bitmaps in a block, about


def shingles(text: str | None, words_each: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A-Z count as lower case.  A text with fewer words is one shingle; one
    without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    x = word_hashes.of(words)
    k = min(words_each, len(x))
    out = np.full(len(x) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out + x[i : len(x) - k + 1 + i])
    return np.unique(out)


def sketch(x: np.ndarray) -> np.ndarray:
    """The similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.full(BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    step = max(1, 2048 // len(x))
    for r in range(0, BINS, step):
        to = min(r + step, BINS)
        h = mix(x[None, :] ^ SEEDS[r:to, None])
        bins = ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
        value = (np.arange(r, to, dtype=np.uint64)[:, None] << np.uint64(32)) | (h & LOW)
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        if int(out.max()) >> 32 < to:
            return out
    for b in np.flatnonzero(out == np.uint64(0xFFFFFFFFFFFFFFFF)):
        h = mix(x ^ SEEDS[BINS + b]) & LOW
        out[b] = (np.uint64(BINS + b) << np.uint64(32)) | h.min()
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of coordinates."""
    rows = values.reshape(BANDS, WIDTH)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(WIDTH):
        key = mix(key ^ rows[:, i])
    return key


def parity(x: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set: 64-bit words, as many as the next power of two holds."""
    words = 1 << max(0, int(PARITY_BITS * len(x) - 1).bit_length() - 6)
    at = (x >> np.uint64(17)) & np.uint64(64 * words - 1)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps (rows) that the same sets have with fewer words."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def within(n_a, n_b, apart, percent: int):
    """Whether sets of these sizes, apart in so many elements, can have ``percent`` of similarity."""
    return (100 - percent) * (n_a + n_b) >= (100 + percent) * apart


def signatures(docs: DataFrame, words_each: int) -> DataFrame:
    """(doc_id, fp, n_shingles, s1, s2, bands, parity): set size, 128-bit digest, band keys, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, fp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = shingles(text, words_each)
                with np.errstate(over="ignore"):
                    digest = signed(np.array([mix(x).sum(dtype=np.uint64), mix(x ^ SEEDS[0]).sum(dtype=np.uint64)]))
                bands = signed(band_keys(sketch(x))) if len(x) else None
                for column, value in zip(out, (doc_id, fp, len(x), int(digest[0]), int(digest[1]), bands, parity(x).tobytes()), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "fp", "n_shingles", "s1", "s2", "bands", "parity"])

    return docs.select(*row_key(), "text").mapInArrow(run, "doc_id long, fp long, n_shingles long, s1 long, s2 long, bands array<long>, parity binary")


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def with_ends(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs(a, b)``, a written table, with ``columns`` of ``rows`` for either end (``_a``, ``_b``)."""
    for end in ("b", "a"):
        pairs = join_spread(pairs, rows.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), [end])
    return pairs


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = [], []
            for one, other, n_a, n_b, bits_a, bits_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(bits_a, "<u8")[None, :], np.frombuffer(bits_b, "<u8")[None, :]
                words = min(x.shape[1], y.shape[1])
                if within(n_a, n_b, int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()), percent):
                    a.append(one)
                    b.append(other)
            yield _pairs(a, b)

    both = with_ends(pairs, sets, ["n_shingles", "parity"])
    return both.select("a", "b", "n_shingles_a", "n_shingles_b", "parity_a", "parity_b").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, words_each: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` of Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            a, b = [], []
            for one, other, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text_a not in kept:
                    if len(kept) >= 64:
                        kept.clear()
                    kept[text_a] = shingles(text_a, words_each)
                x, y = kept[text_a], shingles(text_b, words_each)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both) and both:
                    a.append(one)
                    b.append(other)
            yield _pairs(a, b)

    return with_ends(pairs, texts, ["text"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _matches(left: list[dict], right: list[dict], percent: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pairs across two blocks and components that their bitmaps do not rule out."""
    for xs in _by_words(left):
        for ys in _by_words(right):
            words = min(xs[3].shape[1], ys[3].shape[1])
            bits_x, bits_y = folded(xs[3], words), folded(ys[3], words)
            step = max(1, (1 << 17) // (words * len(bits_y)))
            for at in range(0, len(bits_x), step):
                apart = np.bitwise_count(bits_x[at : at + step, None, :] ^ bits_y[None, :, :]).sum(axis=2, dtype=np.int64)
                n_a, n_b = xs[1][at : at + step, None], ys[1][None, :]
                near = within(n_a, n_b, apart, percent) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
                near &= xs[2][at : at + step, None] != ys[2][None, :]
                for i, j in zip(*np.nonzero(near), strict=True):
                    yield int(xs[0][at + i]), int(ys[0][j]), int(xs[2][at + i]), int(ys[2][j]), int(apart[i, j])


def _by_words(members: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, sizes, components and bitmaps of a block's members, by length of the bitmap."""
    lengths: dict[int, list[dict]] = {}
    for m in members:
        lengths.setdefault(len(m["parity"]), []).append(m)
    for some in lengths.values():
        bits = np.frombuffer(b"".join(m["parity"] for m in some), "<u8").reshape(len(some), -1)
        yield (*(np.array([m[c] for m in some], np.int64) for c in ("doc_id", "n_shingles", "component")), bits)


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b, c_a, c_b, apart): likely pairs across the components of each bucket.

    ``mixed(key, doc_id, n_shingles, component, parity, minor)``, ``minor``
    marks members outside of their bucket's largest component.  A bucket's
    members are dealt by hash into blocks of bounded bytes, minor and main ones
    apart; a block of minor members meets every block that is not before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [m for left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in _matches(left, right, percent)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "c_a", "c_b", "apart"])

    cost = F.octet_length("parity") + 32
    size = lambda minor: F.ceil(F.coalesce(F.sum(F.when(F.col("minor") == minor, cost)), F.lit(0)) / BLOCK_BYTES).cast("int")
    sizes = mixed.groupBy("key").agg(size(True).alias("minors"), size(False).alias("mains"), F.count(F.lit(1)).alias("n"))
    dealt = join_spread(mixed, sizes.select("key", "minors", "mains"), ["key"], sizes)
    block = F.pmod(F.xxhash64("doc_id"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("mains"))).cast("int")
    member = F.struct("doc_id", "n_shingles", "component", "parity")
    blocks = dealt.groupBy("key", "minor", block.alias("block"), "minors", "mains").agg(F.collect_list(member).alias("members"))
    # minor block i and any block j: the minor ones from i on, and after them those of the main component
    meets = F.sequence(F.col("block"), F.col("minors") + F.col("mains") - 1)
    left = blocks.where("minor").select("key", F.col("block").alias("i"), F.explode(meets).alias("j"), F.col("members").alias("left"))
    before = F.sequence(F.lit(0), F.when(F.col("minor"), F.col("block")).otherwise(F.col("minors") - 1))
    right = blocks.select("key", F.explode(before).alias("i"), (F.col("block") + F.when(F.col("minor"), 0).otherwise(F.col("minors"))).alias("j"), F.col("members").alias("right"))
    met = left.hint("merge").join(right, ["key", "i", "j"]).select("left", "right")
    return met.mapInArrow(run, "a long, b long, c_a long, c_b long, apart long").distinct()


def near_duplicates(docs: DataFrame, words_each: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents whose sets of ``words_each``-word shingles reach ``percent`` are
    linked; ``component_id`` is the least doc_id that links reach and ``kept``
    marks it.  Empty and null texts are linked with nothing.  Rows that share a
    doc_id are one document with the links of all its texts.  A row without
    doc_id has no component and is kept.
    """
    scratch = Scratch(docs.sparkSession, "near")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    signed_docs = scratch.table(signatures(docs, words_each), "signatures")
    full = signed_docs.where("doc_id is not null and n_shingles > 0")
    digest = ["s1", "s2", "n_shingles"]
    classes = scratch.table(full.groupBy(*digest).agg(F.min(F.struct("doc_id", "fp")).alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    copies = classes.where("n > 1")
    same = join_spread(full.select(*digest, "doc_id"), copies.select(*digest, F.col("rep.doc_id").alias("b")), digest, copies)
    same = scratch.table(same.where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct(), "same")
    reps = full.join(classes.select("rep.*", F.col("s1").alias("_1"), F.col("s2").alias("_2")).hint("merge"), ["doc_id", "fp"])
    reps = reps.where("s1 = _1 and s2 = _2").select("doc_id", "n_shingles", "bands", "parity").dropDuplicates(["doc_id", "n_shingles", "parity"])
    reps = scratch.table(reps, "reps")

    rows = reps.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    shared = rows.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.table(shared, "shared")
    buckets = scratch.table(join_spread(rows, shared.select("key", "lead"), ["key"], shared), "buckets")
    comparable = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    stars = buckets.where("doc_id <> lead.doc_id").select(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("lead.n_shingles").alias("n_a"), F.col("n_shingles").alias("n_b"))
    stars = scratch.table(stars.where(comparable).select("a", "b").distinct(), "stars")
    ids = buckets.select("doc_id").distinct()
    sets = scratch.table(reps.select("doc_id", "n_shingles", "parity").join(ids.hint("merge"), "doc_id", "left_semi"), "sets")
    texts = scratch.table(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi"), "texts")

    def check(pairs: DataFrame, tag: str) -> DataFrame | None:
        """Confirmed links of likely pairs, if there are any."""
        pairs = scratch.table(pairs, f"likely_{tag}")
        if pairs.isEmpty():
            return None
        links = scratch.table(confirmed(pairs, texts, words_each, percent), f"links_{tag}")
        return None if links.isEmpty() else links

    def joined(labels: DataFrame, links: DataFrame, tag: str) -> DataFrame:
        """Labels after more links, which are followed between whole components."""
        ends = renamed(links, labels)
        moved = components(ends, "now_a", "now_b").select(F.col("node").alias("component"), F.col("component").alias("_to"))
        nodes = labels.union(links.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("component")).join(labels.hint("merge"), "node", "left_anti").distinct())
        return scratch.table(nodes.join(moved.hint("merge"), "component", "left").select("node", F.coalesce("_to", "component").alias("component")), f"labels_{tag}")

    def renamed(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """``pairs`` with the components of both ends (``now_a``, ``now_b``)."""
        for end in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"now_{end}")).hint("merge"), end, "left").withColumn(f"now_{end}", F.coalesce(f"now_{end}", end))
        return pairs

    def placed(labels: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        """Members of buckets that hold several components, and those buckets."""
        member = buckets.join(labels.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
        member = scratch.table(member, f"members_{tag}")
        parts = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
        parts = scratch.table(parts.where("parts > 1").select("key", F.col("top.component").alias("main"), "n"), f"parts_{tag}")
        mixed = join_spread(member, parts.select("key", "main"), ["key"], parts)
        return scratch.table(mixed.withColumn("minor", F.col("component") != F.col("main")).drop("main"), f"mixed_{tag}"), parts

    found = check(likely(stars, sets, percent), "stars")
    links = same if found is None else same.union(found)
    labels = scratch.table(components(links, "a", "b"), "labels")
    mixed, parts = placed(labels, "first")
    degrees = links.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("degree"))
    hubs = mixed.where(~F.col("minor")).join(degrees.hint("merge"), "doc_id").groupBy("key").agg(F.max(F.struct("degree", "doc_id", "n_shingles")).alias("hub"))
    spokes = join_spread(mixed.where("minor"), hubs, ["key"], parts).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("hub.n_shingles").alias("n_a"), F.col("n_shingles").alias("n_b"))
    spokes = scratch.table(spokes.where(comparable).select(*pair).distinct().join(stars.select(*pair).hint("merge"), ["a", "b"], "left_anti"), "spokes")
    found = check(likely(spokes, sets, percent), "spokes")
    if found is not None:
        labels = joined(labels, found, "spokes")
        mixed, _ = placed(labels, "second")

    mixed = scratch.table(mixed.join(sets.drop("n_shingles").hint("merge"), "doc_id"), "blocks")
    across = scratch.table(_across(mixed, percent), "across")
    tested = stars.select(*pair).union(spokes)
    across = across.select(*pair, F.least("c_a", "c_b").alias("c_a"), F.greatest("c_a", "c_b").alias("c_b"), "apart").distinct()
    across = scratch.table(across.join(tested.hint("merge"), ["a", "b"], "left_anti"), "untested")
    # the closest pair of two components first; the others only where these do not join them
    best = across.groupBy("c_a", "c_b").agg(F.min(F.struct("apart", "a", "b")).alias("m")).select("m.a", "m.b")
    found = check(best, "best")
    if found is not None:
        labels = joined(labels, found, "best")
    rest = across.select("a", "b").join(best.hint("merge"), ["a", "b"], "left_anti")
    found = check(renamed(rest, labels).where("now_a <> now_b").select("a", "b"), "rest")
    if found is not None:
        labels = joined(labels, found, "rest")
    out = signed_docs.join(labels.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies: the least doc_id; columns stay.

    Rows that repeat a kept doc_id with the same text are one row afterwards.
    """
    kept = near_duplicates(docs, words_each, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
