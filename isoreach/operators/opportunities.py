"""Opportunity tables and their aggregation over reached destinations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.operators.bins import Binning, explode_bins


def wide_to_long(wide: DataFrame, key: str, activities: Sequence[str]) -> DataFrame:
    """(key, activity, count) from one column per activity."""
    pairs = ", ".join(f"'{a}', cast(`{a}` as double)" for a in activities)
    return wide.selectExpr(key, f"stack({len(activities)}, {pairs}) as (activity, count)")


def mapped_wide(wide: DataFrame, key: str, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Wide category columns mapped to activities; columns of one activity add up.

    An empty count is 0.
    """
    cells = F.array(*[F.struct(F.lit(a).alias("activity"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("count")) for c, acts in mapping.items() for a in acts])
    return wide.select(key, F.inline(cells)).groupBy(key, "activity").agg(F.sum("count").alias("count"))


def mapped_long(rows: DataFrame, key: str, category: str, count: str | None, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Long categories mapped to activities; an unmapped category is an error."""
    table = F.create_map(*[x for c, acts in mapping.items() for x in (F.lit(c), F.array(*[F.lit(a) for a in acts]))])
    found = F.coalesce(table[F.col(category)], F.raise_error(F.concat(F.lit("unmapped category: "), F.coalesce(F.col(category), F.lit("null")))))
    value = F.lit(1.0) if count is None else F.coalesce(F.col(count).cast("double"), F.lit(0.0))
    return rows.select(key, F.explode(found).alias("activity"), value.alias("count")).groupBy(key, "activity").agg(F.sum("count").alias("count"))


def parse_mapping(text: str) -> dict[str, list[str]]:
    """``c1->a-b,c2`` as {c1: [a, b], c2: [c2]}."""
    out: dict[str, list[str]] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, arrow, acts = part.partition("->")
        out[name] = acts.split("-") if arrow else [name]
    return out


def invert_mapping(rows: DataFrame, category: str, activities: str, separator: str = ";") -> DataFrame:
    """(activity, categories) from (category, separated activities)."""
    return rows.select(F.col(category).alias("c"), F.explode(F.split(activities, separator)).alias("activity")).groupBy("activity").agg(F.sort_array(F.collect_set("c")).alias("categories"))


def lodes(wac: DataFrame, segments: Mapping[str, Sequence[str]]) -> DataFrame:
    """Jobs per zone and activity; a segment may feed several activities."""
    return mapped_wide(wac, "geoid", segments)


def combine(models: Sequence[DataFrame]) -> DataFrame:
    """Several long opportunity tables as one; absent cells are filled at the pivot."""
    out = models[0]
    for model in models[1:]:
        out = out.unionByName(model)
    return out


def proportioned(zones: DataFrame, matches: DataFrame) -> DataFrame:
    """Zone counts shared evenly among the vertices matched to the zone."""
    share = 1 / F.count(F.lit(1)).over(Window.partitionBy("zone_id"))
    return matches.withColumn("share", share).join(zones, "zone_id").select("vertex_id", "activity", (F.col("count") * F.col("share")).alias("count"))


def totals(opportunities: DataFrame, require: bool = True) -> DataFrame:
    """Total per activity; a zero total is an error where required."""
    out = opportunities.groupBy("activity").agg(F.sum("count").alias("total"))
    if not require:
        return out
    return out.withColumn("total", F.when(F.col("total") != 0, F.col("total")).otherwise(F.raise_error(F.concat(F.lit("no opportunities for "), F.col("activity")))))


def aggregate(tree: DataFrame, opportunities: DataFrame, binning: Binning, label: Sequence[str] = ("origin", "vertex_id")) -> DataFrame:
    """Opportunities by origin, bin and activity over distinct destinations.

    One destination per label counts once.  Opportunities join first on the
    vertex, so the shuffle by origin carries sums.
    """
    reached = explode_bins(tree.dropDuplicates(list(label)), binning)
    return reached.join(opportunities, "vertex_id").groupBy("origin", "bin_key", "activity").agg(F.sum("count").alias("opportunities"))


def disaggregate(tree: DataFrame, opportunities: DataFrame, binning: Binning) -> DataFrame:
    """Per origin, bin and destination the map of activity to count."""
    reached = explode_bins(tree.dropDuplicates(["origin", "vertex_id"]), binning)
    return reached.join(opportunities, "vertex_id").groupBy("origin", "bin_key", "vertex_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("activity", "count")))).alias("counts"))


def zero_filled(aggregated: DataFrame, origins: DataFrame, binning: Binning, activities: Sequence[str]) -> DataFrame:
    """Every origin, bin and activity; combinations that reach nothing are 0."""
    keys = F.explode(F.array(*[F.lit(k) for k, _, _ in binning.intervals()]))
    dense = origins.select("origin").distinct().withColumn("bin_key", keys).withColumn("activity", F.explode(F.array(*[F.lit(a) for a in activities])))
    return dense.join(aggregated, ["origin", "bin_key", "activity"], "left").withColumn("opportunities", F.coalesce("opportunities", F.lit(0.0)))


def opportunity_vector(rows: DataFrame, activities: Sequence[str]) -> DataFrame:
    """One row per vertex, one column per activity (0 where absent)."""
    return rows.groupBy("vertex_id").pivot("activity", list(activities)).agg(F.sum("count")).fillna(0.0)


def places_and_buildings(places: DataFrame, buildings: DataFrame, activities: Sequence[str]) -> DataFrame:
    """Places, and the buildings with an activity that no place inside covers.

    ``places(place_id, x, y, mask)`` and ``buildings(building_id, x, y, mask,
    ring)``; masks are arrays of booleans in the order of ``activities``.  A
    building without places keeps its mask.
    """
    from isoreach.operators.spatial import points_in_rings

    inside = points_in_rings(places.select("place_id", "x", "y", "mask"), buildings.select(F.col("building_id"), "ring"), "building_id")
    flags = [F.bool_or(F.get("mask", F.lit(i))).alias(f"c{i}") for i in range(len(activities))]
    covered = inside.groupBy("building_id").agg(*flags)
    masks = F.array(*[F.get("mask", F.lit(i)) & ~F.coalesce(F.col(f"c{i}"), F.lit(False)) for i in range(len(activities))])
    kept = buildings.join(covered, "building_id", "left").withColumn("left_over", masks).where(F.exists("left_over", lambda m: m))
    return places.select("x", "y", "mask").unionByName(kept.select("x", "y", "mask"))
