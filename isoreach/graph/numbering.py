"""Gapless numbers in a total order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.scratch import Scratch


def numbered(df: DataFrame, name: str, order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: the place of each row from 0 in the order, within ``by``.

    Rows are dealt by ranges of the order, sorted inside them and written once
    with their place in the range; a row's number is the count of the ranges
    before its own plus that place.  Only the counts, one row a range and group,
    are summed in one task, and joined when the result is read.  Rows that tie
    in the order get numbers of their own, fixed as they are written.
    """
    scratch = Scratch(df.sparkSession, "numbers")
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place in the lower 33
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", place)
    rows = scratch.table(ranged, "ranges").withColumn("_part", F.shiftright("_at", 33))
    group = [F.col(c) for c in by] or [F.lit(0)]
    sizes = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.table(sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_range"), (before - F.col("_first")).alias("_shift")), "offsets")
    same = F.col("_part") == F.col("_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(offsets, same).withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_part", "_range", "_shift", *[f"_{c}" for c in by])
