"""Removal of 50-word windows that an earlier document has, by a count-min prefilter.

First pass: every partition counts the grams that anchor its documents'
windows in a sketch of its own; the merged sketch never underestimates in how
many documents a window occurs.  Second pass: only windows estimated to occur
twice are grouped exactly (:mod:`isoreach.llm.repeats`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm import repeats
from isoreach.llm.sketch import repeated_segments
from isoreach.llm.textrows import slices
from isoreach.scratch import Scratch

WHAT = repeats.Repeats(by_words=True, window=50, gram=8, earlier=True)
BYTES_PER_ANCHOR = 120  # about 22 words


def remove_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed): words covered by repeated windows removed.

    Kept words are joined by one space.  A window counts if its words also
    start in a document with a smaller doc_id, judged on the input.  A null
    text has no words; texts under 50 words lose none; rows that repeat a
    doc_id are no earlier than each other; a row without doc_id is neither
    searched nor cleaned.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    segs = repeated_segments(docs, WHAT, BYTES_PER_ANCHOR, scratch)
    marks = repeats.find(docs, WHAT, segs, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], [], []]
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode().split()
                gone = repeats.removed(found, len(words), WHAT.window)
                kept = words if not found else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for column, value in zip(out, (doc_id, b" ".join(kept).decode(), len(words), int(gone.sum())), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "text", "n_words", "n_removed"])

    return repeats.with_marks(docs, marks).mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def remove_repeated_windows(docs: DataFrame) -> DataFrame:
    """Word counts and the digest of the kept words of every document."""
    return remove_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
