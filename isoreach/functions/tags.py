"""Road tags: classes, cycling and walking predicates, stress and comfort scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes and score tables.
WALKABLE = ("residential", "unclassified", "living_street", "service", "pedestrian", "trailhead", "track", "footway", "bridleway", "steps", "corridor", "path", "elevator")
UNBIKEABLE = ("motorway", "trunk", "motorway_link", "trunk_link")
NON_MOTORIZED = ("cycleway", "path", "footway", "pedestrian", "living_street")
CLASS_RANK = {"motorway": 1, "motorway_link": 1, "trunk": 2, "trunk_link": 2, "primary": 3, "primary_link": 3, "secondary": 4, "secondary_link": 4, "tertiary": 5, "tertiary_link": 5, "unclassified": 6, "residential": 7}
EIGHTH = ("living_street", "service", "pedestrian", "track", "bus_guideway", "road", "busway", "footway", "bridleway", "steps", "corridor", "path", "sidewalk", "cycleway", "elevator", "trailhead")
#: (facility, one-way) -> speeds in mph up to which the stress level is the given one
STRESS = {
    ("lane", False): ((30, 1), (35, 2), (40, 3), (None, 4)),
    ("lane", True): ((30, 1), (40, 2), (None, 3)),
    ("facility", False): ((25, 2), (40, 3), (None, 4)),
    ("facility", True): ((35, 2), (45, 3), (None, 4)),
    ("none", False): ((25, 2), (35, 3), (None, 4)),
    ("none", True): ((30, 2), (40, 3), (None, 4)),
}
COMFORT_SPEEDS = ((25, 2), (30, 1), (40, 0), (45, -1), (None, -2))
FACILITY_COMFORT = {"buffered": 2, "lane": 2, "facility": 0, "none": -2}
NO_FACILITY_FOUND = -2
WORST_COMFORT, BEST_COMFORT = -6, 9
DEFAULT_MPH = 25.0


def highway_rank(highway: Column) -> Column:
    """Importance of a road class, 1 (motorway) to 9 (anything unknown)."""
    out = F.when(highway.isin(*EIGHTH), 8)
    for name, rank in CLASS_RANK.items():
        out = out.when(highway == name, rank)
    return out.otherwise(9)


def top_highway(values: Column) -> Column:
    """The most important class of an array; ties by name."""
    ranked = F.transform(values, lambda v: F.struct(highway_rank(v).alias("rank"), v.alias("name")))
    return F.array_min(ranked)["name"]


def facility(cycleway: Column) -> Column:
    """Cycling facility class of a cycleway tag; null for no tag."""
    return (
        F.when(cycleway.isNull(), F.lit(None).cast("string"))
        .when(cycleway == "track", "buffered")
        .when(cycleway.isin("lane", "designated"), "lane")
        .when(cycleway.isin("crossing", "shared", "shared_lane"), "facility")
        .otherwise("none")
    )


def is_sidewalk(sidewalk: Column, footway: Column) -> Column:
    """A sidewalk tag other than no/none, or a footway tagged sidewalk."""
    return F.coalesce(~sidewalk.isin("no", "none"), F.lit(False)) | F.coalesce(footway == "sidewalk", F.lit(False))


def is_footway(footway: Column) -> Column:
    """A footway tag other than no/none."""
    return F.coalesce(~footway.isin("no", "none"), F.lit(False))


def is_walkable(highway: Column, sidewalk: Column, footway: Column) -> Column:
    """Walkable by its own tags."""
    return is_sidewalk(sidewalk, footway) | is_footway(footway) | F.coalesce(highway.isin(*WALKABLE), F.lit(False))


def is_oneway(oneway: Column, junction: Column | None = None) -> Column:
    """One-way by tag or as a roundabout."""
    out = F.coalesce(oneway.isin("yes", "true", "1", "-1", "reverse", "T", "F"), F.lit(False))
    return out if junction is None else out | F.coalesce(junction == "roundabout", F.lit(False))


def is_reversed(oneway: Column) -> Column:
    """One-way against the direction of drawing."""
    return F.coalesce(oneway.isin("-1", "reverse", "T"), F.lit(False))


def _steps(value: Column, table) -> Column:
    cases = [(F.lit(True) if top is None else value <= top, result) for top, result in table]
    first, *rest = cases
    return reduce(lambda out, case: out.when(case[0], case[1]), rest, F.when(first[0], first[1]))


def _whole(mph: Column) -> Column:
    """A speed rounded to whole miles per hour, after noise of sums is rounded off."""
    return F.round(F.round(mph, 6))


def stress_level(highway: Column, cycleway: Column, oneway: Column, mph: Column, near_mph: Column) -> Column:
    """Level of traffic stress 1..4 for cycling.

    Speed is the own limit, else that of the neighbours, else 25 mph; a missing
    cycleway tag counts as no facility.
    """
    speed = _whole(F.coalesce(mph, near_mph, F.lit(DEFAULT_MPH)))
    kind = F.coalesce(facility(cycleway), F.lit("none"))
    out = F.when(F.coalesce(highway.isin(*UNBIKEABLE), F.lit(False)), 4).when(F.coalesce(highway.isin(*NON_MOTORIZED), F.lit(False)), 1).when(kind == "buffered", 1)
    for (name, one), table in STRESS.items():
        out = out.when((kind == name) & (is_oneway(oneway) == one), _steps(speed, table))
    return out.cast("int")


def speed_comfort(mph: Column) -> Column:
    """Walking comfort from traffic speed; no speed at all counts as 0 mph."""
    return _steps(_whole(F.coalesce(mph, F.lit(0.0))), COMFORT_SPEEDS).cast("int")


def facility_comfort(kind: Column) -> Column:
    """Walking comfort from a cycling facility class; null stays null."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, value in FACILITY_COMFORT.items():
        out = out.when(kind == name, value)
    return out


def signal_comfort(node_highway: Column) -> Column:
    """2 at traffic signals, 1 at a stop sign (not a bus stop), else 0."""
    tags = F.split(F.coalesce(node_highway, F.lit("")), "[#;]")
    return F.when(F.array_contains(tags, "traffic_signals"), 2).when(F.array_contains(tags, "stop"), 1).otherwise(0)


def walking_comfort(eligible, footway, sidewalk, has_neighbours, speed, cycle, signal) -> Column:
    """Walking comfort index -6..9 from its parts (boolean and integer Columns)."""
    walk = F.when(sidewalk | footway, 2).otherwise(-2)
    total = F.least(F.greatest(walk + speed + cycle + signal, F.lit(WORST_COMFORT)), F.lit(BEST_COMFORT))
    return F.when(~eligible, WORST_COMFORT).when(footway | (~has_neighbours & sidewalk), BEST_COMFORT).otherwise(total).cast("int")


def reduce_numbers(text: Column, how: str, delimiter: str = "#") -> Column:
    """Least or greatest number of a delimited string; the text itself if none parse."""
    parts = F.transform(F.split(text, delimiter), lambda v: F.trim(v).try_cast("double"))
    pick = F.array_min(parts) if how == "min" else F.array_max(parts)
    return F.when(F.exists(parts, lambda v: v.isNull()), text).otherwise(F.regexp_replace(pick.cast("string"), r"\.0$", ""))


def unique_tags(text: Column, delimiter: str = "#") -> Column:
    """Distinct values of a delimited string, in order, joined by semicolons."""
    return F.array_join(F.array_distinct(F.split(text, delimiter)), ";")


def mean_number(text: Column, delimiter: str = "#") -> Column:
    """Mean of the parts that are numbers; null if none is."""
    parts = F.filter(F.transform(F.split(text, delimiter), lambda v: F.trim(v).try_cast("double")), lambda v: v.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(parts))


MPH_KPH = 1.609344


def speed_kph(text: Column, separator: str = ";") -> Column:
    """Speed in km/h from a tag: ``45``, ``45 mph``, ``walk``; the least of a list.

    Unknown words, units and zero give null.
    """

    def one(part: Column) -> Column:
        words = F.split(F.trim(part), " ")
        number, unit = F.get(words, F.lit(0)).try_cast("double"), F.get(words, F.lit(1))
        factor = F.when(F.size(words) == 1, 1.0).when((F.size(words) == 2) & (unit == "kph"), 1.0).when((F.size(words) == 2) & (unit == "mph"), MPH_KPH)
        value = F.when(number.isNotNull() & ~F.isnan(number) & (number != 0), number * factor)
        return F.when(F.trim(part) == "walk", 5.0).when(F.trim(part) == "25mph", 25 * MPH_KPH).otherwise(value)

    return F.array_min(F.transform(F.split(text, separator), one))


def costar_activity(kind: Column, subtype: Column) -> Column:
    """Activity of a commercial property by type and subtype; null if unmapped."""
    return (
        F.when(kind == "Health Care", "healthcare")
        .when(kind == "Sports & Entertainment", "entertainment")
        .when(kind == "Retail", "retail")
        .when(kind == "Specialty", "services")
        .when(subtype.isin("Fast Food", "Restaurant", "Bar"), "food")
    )
