"""Language identification by a byte-level recurrent network trained here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.llm.recurrent import STEPS, Network, segments, train
from isoreach.llm.textrows import slices

FOLDS = 5
BUCKETS = 112  # training documents per language, at most
SEGMENTS = 4  # stretches of a training document, at most
AT_ONCE = 4096  # segments that go through the network together, fewer beyond CLASSES_AT_ONCE
CLASSES_AT_ONCE = 64
UNDETERMINED = "und"


def held_out() -> Column:
    """Whether a row's doc_id belongs to the fold that is never learned from.

    A missing doc_id counts as the empty string.
    """
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame) -> Network | None:
    """Train on a bounded sample of labelled documents outside the held-out fold.

    Every language is learned.  Its documents with a letter fall into
    ``BUCKETS`` buckets by a hash of their doc_id, and each bucket gives its
    least hash: partial aggregation finds them, whatever the size of a
    language.  Of each document ``SEGMENTS`` stretches of ``STEPS`` characters
    are learned from (of each the first ``STEPS`` bytes), which begin anywhere
    in its whole text.  None without any labelled text.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = known.select("lang", F.xxhash64("doc_id").alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    picked = hashed.groupBy("lang", "bucket").agg(F.min("h").alias("h"))
    room = F.greatest(F.length("text") - STEPS, F.lit(0)) + 1
    stretches = F.array_distinct(F.array(*[F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(i)), room).cast("int") + 1, F.lit(STEPS)) for i in range(SEGMENTS)]))
    rows = known.select("lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("fp"), stretches.alias("parts"))
    # a doc_id can repeat: the least text hash of each picked doc_id alone is taken
    parts = rows.join(F.broadcast(picked.select("lang", "h")), ["lang", "h"])  # at most BUCKETS rows per language
    parts = parts.groupBy("lang", "h").agg(F.min(F.struct("fp", "parts")).alias("m")).orderBy("lang", "h").collect()
    learned = [(r["lang"], part.lower().encode()[:STEPS]) for r in parts for part in r["m"]["parts"]]
    return train([text for _, text in learned], [lang for lang, _ in learned]) if learned else None


def predict(docs: DataFrame, net: Network | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score (the pooled probability).

    Every byte of the lower-cased text is read; the probabilities of all positions are
    averaged.  ``und`` with score 0 where the text is null or has no letter, or
    where nothing was learned.  Other columns stay; columns that have one of
    ``names`` are replaced.
    """
    lang, score_name = names
    rest = [c for c in docs.columns if c not in names]
    unknown = [F.lit(UNDETERMINED).alias(lang), F.lit(0.0).alias(score_name)]
    if net is None:
        return docs.select(*[F.col(f"`{c}`") for c in rest], *unknown)
    at = rest.index("text")
    at_once = max(1, AT_ONCE * CLASSES_AT_ONCE // max(CLASSES_AT_ONCE, len(net.classes)))
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema.add(lang, "string").add(score_name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            totals = np.zeros((len(texts), len(net.classes)), np.float64)
            held, owner, n = [], [], 0

            def read(held: list, owner: list) -> None:
                x, real = (np.concatenate(part) for part in zip(*held, strict=True))
                np.add.at(totals, np.concatenate(owner), net.probabilities(x, real))  # noqa: B023

            for i, text in enumerate(texts):
                x, real = segments((text or "").lower().encode())
                for part in range(0, len(x), at_once):
                    held.append((x[part : part + at_once], real[part : part + at_once]))
                    owner.append(np.full(len(held[-1][0]), i))
                    n += len(held[-1][0])
                    if n >= at_once:
                        read(held, owner)
                        held, owner, n = [], [], 0
            if held:
                read(held, owner)
            share = totals / np.maximum(totals.sum(axis=1, keepdims=True), 1e-9)
            best = share.argmax(axis=1)
            named = pa.array([net.classes[b] for b in best], pa.string())
            score = pa.array(share[np.arange(len(best)), best], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, named, score], names=[*rest, lang, score_name])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    made = docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)
    return made.withColumn(score_name, F.when(letters, F.col(score_name)).otherwise(0.0)).withColumn(lang, F.when(letters, F.col(lang)).otherwise(UNDETERMINED))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float) -> DataFrame:
    """The documents with a predicted language of at least this score; columns stay."""
    lang, score = "_lang_pred", "_score"
    while lang in docs.columns or score in docs.columns:
        lang, score = f"_{lang}", f"_{score}"
    found = predict(docs, fit(docs), (lang, score))
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
