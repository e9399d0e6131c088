"""Sharding by weighted rendezvous hashing (DataFrame functions only).

Every shard scores every key, ``-ln(u(key, shard)) / weight``, and the lowest
score wins.  Adding a shard only adds one more score per key, so a key either
stays where it was or goes to the new shard; the share that moves is the new
shard's share of the weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.scratch import Scratch

HASH_DIGITS = 13  # hexadecimal digits of md5: 52 bits, exact in a double


def unit_hash(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone."""
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16**HASH_DIGITS))


def _scores(key: Column, weights: Sequence[float]) -> Column:
    """(cost, shard) of a key for every shard."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    even = len(set(weights)) == 1
    table = None if even else F.array(*[F.lit(float(w)) for w in weights])

    def score(shard: Column) -> Column:
        cost = -F.ln(unit_hash(text, shard))
        return F.struct((cost if even else cost / F.get(table, shard)).alias("cost"), shard.alias("shard"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key among ``len(weights)`` shards; ties go to the lower shard.

    A null key is treated as the empty string, so it has one fixed shard.
    """
    return F.array_min(_scores(key, weights))["shard"].cast("int")


def assign_shards(
    df: DataFrame,
    key: str = "doc_id",
    weights: Sequence[float] = (1.0,) * 40,
    grown_weight: float = 1.0,
    order: Sequence[str] = (),
    rows_per_run: int = 20_000,
) -> DataFrame:
    """Add ``shard``, ``slot`` and ``grown_shard`` to every row.

    ``shard`` follows from the key and the weights; ``grown_shard`` is the
    shard with one more shard of ``grown_weight``.  ``slot`` numbers the rows
    of a shard from 0 without gaps, ordered within runs by key and ``order``.

    Every row is scored once, for all shards and the further one, and written;
    counts and numbers come from the written rows.  Rows of a shard are
    numbered in runs (a hash of the key) of about ``rows_per_run`` rows, and
    runs are offset by a running sum of their counts, so no task holds a whole
    shard.  A key that holds a large share of the rows is spread over runs by
    ``order`` as well.  Null keys share one shard; repeated rows get different
    slots.  Columns of ``df`` named ``shard``, ``slot`` or ``grown_shard`` are
    replaced, all others stay, whatever their names.  An empty table stays
    empty.
    """
    added = ("shard", "slot", "grown_shard")
    rest = [c for c in df.columns if c not in added]
    clear = "_"
    while any(c.startswith(clear) for c in rest):  # helper columns that clash with none
        clear += "_"
    row, best, last, run, before_run, number = (f"{clear}{n}" for n in ("row", "best", "last", "run", "before", "number"))
    # the further shard is the last of the scores, so the least of the others decides without it
    scores = _scores(F.col(f"`{key}`"), [*weights, grown_weight])
    kept = F.struct(*[F.col(f"`{c}`") for c in rest]).alias(row)
    scored = df.select(kept, scores.alias(best)).select(row, F.array_min(F.slice(best, 1, len(weights))).alias(best), F.element_at(best, -1).alias(last))
    scored = scored.select(row, F.col(f"{best}.shard").cast("int").alias("shard"), F.least(best, last)["shard"].cast("int").alias("grown_shard"))
    scored = Scratch(df.sparkSession, "shards").table(scored, "scored")
    runs = max(1, -(-scored.count() // (rows_per_run * len(weights))))
    field = lambda c: F.col(row).getField(c)
    placed = scored.withColumn(run, F.pmod(F.xxhash64(field(key), *[field(c) for c in order]), F.lit(runs)))
    before = Window.partitionBy("shard").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", run).count().select("shard", run, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(before_run))
    inside = Window.partitionBy("shard", run).orderBy(field(key).asc_nulls_first(), *[field(c) for c in order])
    numbered = placed.withColumn(number, F.row_number().over(inside)).join(offsets, ["shard", run])
    slot = (F.col(before_run) + F.col(number) - 1).cast("long").alias("slot")
    return numbered.select(*[field(c).alias(c) for c in rest], "shard", slot, "grown_shard")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shards of a documents table: size, checksum, law, shard, slot, grown shard.

    ``size`` is the text's UTF-8 bytes plus 16; a null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = assign_shards(keyed, "doc_id", (1.0,) * shards, order=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
