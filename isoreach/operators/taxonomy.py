"""Category trees: closures, reverse maps and activity masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.scratch import Scratch


def from_paths(rows: DataFrame, category: str = "category", path: str = "path") -> DataFrame:
    """(child, parent) from categories and their paths; no parent for a path of one."""
    return rows.select(F.col(category).alias("child"), F.when(F.size(path) >= 2, F.element_at(path, -2)).alias("parent"))


def closure(tree: DataFrame, rounds: int = 64) -> DataFrame:
    """(category, descendant) for every category and all below it, itself included.

    Paths double in length each round, so a deep tree needs few of them.
    """
    scratch = Scratch(tree.sparkSession, "taxonomy")
    pairs = tree.select(F.col("child").alias("category"), F.col("child").alias("descendant")).union(tree.where("parent is not null").select("parent", "child")).distinct()
    known = scratch.table(pairs, "0")
    size = known.count()
    for k in range(1, rounds + 1):
        step = known.join(known.select(F.col("category").alias("descendant"), F.col("descendant").alias("below")), "descendant").select("category", F.col("below").alias("descendant"))
        known = scratch.table(known.union(step).distinct(), str(k))
        scratch.drop(str(k - 1))
        now = known.count()
        if now == size:
            return known
        size = now
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def reverse_map(pairs: DataFrame, groups: DataFrame, names: Sequence[str]) -> DataFrame:
    """Category by group matrix: ``groups(activity, category)`` over a closure.

    A group's category stands for all its descendants; one that is not in the
    tree is an error.
    """
    found = groups.join(pairs, "category", "left").withColumn("descendant", F.coalesce("descendant", F.raise_error(F.concat(F.lit("unknown category "), "category"))))
    return found.groupBy(F.col("descendant").alias("category")).agg(*[F.bool_or(F.col("activity") == n).alias(n) for n in names])


def activity_mask(rows: DataFrame, key: str, groups: DataFrame, names: Sequence[str], categories: str = "categories") -> DataFrame:
    """Per record the activities that any of its categories feeds; none gives all false."""
    each = rows.select(key, F.explode_outer(categories).alias("category")).join(groups, "category", "left")
    return each.groupBy(key).agg(*[F.coalesce(F.bool_or(F.col("activity") == n), F.lit(False)).alias(n) for n in names])
