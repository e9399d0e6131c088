"""Removal of 400-byte strings that start anywhere else, by sparse prefix ranks.

Ranks double sparsely: positions are ranked by their 32-byte anchor gram (a
merged sketch lets most of the unique ones go), then pairs of that rank and the fingerprint of the stretch around it (400 bytes and
more) are ranked again, and at last the single 400-byte windows at the edges
of repeated passages.  Positions that are unique leave after each round, and a
rank past 400 bytes needs no further one (:mod:`isoreach.llm.repeats`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm import repeats
from isoreach.llm.sketch import repeated_segments
from isoreach.llm.textrows import runs_of, slices
from isoreach.scratch import Scratch

WHAT = repeats.Repeats(by_words=False, window=400, gram=32, earlier=False)
BYTES_PER_ANCHOR = 185
SCHEMA = "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"


def remove_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, spans) of every document.

    ``kept`` are the remaining UTF-8 bytes and ``spans`` the maximal removed
    runs.  Strings are judged on the input and never cross documents; a null
    text is empty; rows that repeat a document repeat all its strings.  A row
    without doc_id is neither searched nor cleaned.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    segs = repeated_segments(docs, WHAT, BYTES_PER_ANCHOR, scratch)
    marks = repeats.find(docs, WHAT, segs, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                gone = repeats.removed(found, len(raw), WHAT.window)
                starts, ends = runs_of(gone)
                spans = [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                for column, value in zip(out, (doc_id, raw[~gone].tobytes(), len(raw), int(gone.sum()), spans), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    return repeats.with_marks(docs, marks).mapInArrow(run, SCHEMA)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Byte counts, number of removed runs and the digest of the kept bytes."""
    return remove_strings(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
