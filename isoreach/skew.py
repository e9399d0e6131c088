"""Joins whose key can hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys above one part in ``SHARES`` of the rows are hot, so there are at most that many.
SHARES = 2000
#: Keys with fewer rows than this are never hot.
LEAST = 200


def join_spread(rows: DataFrame, other: DataFrame, keys: list[str], counts: DataFrame | None = None, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined with ``other`` on ``keys``, with the rows of hot keys dealt over several tasks.

    A hot key has more than one part in ``SHARES`` of ``rows``, which bounds
    the list of hot keys (the only thing broadcast) and the copies made of
    ``other``, whatever the input.  ``counts(keys, n)`` are the rows of each
    key and ``total`` those of all, where they are known already; else ``rows``
    should be a written table.
    """
    total = rows.count() if total is None else total
    if total <= LEAST:
        return rows.join(other.hint("merge"), keys, how)
    least = max(LEAST, total // SHARES)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*keys, "n")
    hot = F.broadcast(counts.where(F.col("n") > least).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    copies = other.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies.hint("merge"), [*keys, "_part"], how).drop("_part")
