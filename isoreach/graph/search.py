"""Shortest-path trees of many origins under multimodal constraints.

Labels of all origins are relaxed together in rounds of joins, at every size
and under every limit.  A label is a way to reach a vertex from an origin:
its cost, distance and legs, and the sums that limits ask for.  Labels of one
origin, vertex and (where limits or the caller tell legs apart) sequence of
legs compete; one that is no better in cost nor in any limited sum is dropped,
so the cheapest valid trip is found whatever is limited.

A round takes the frontier, the labels of the lowest bucket of costs that were
not extended yet (delta stepping), joins them with the edges, and keeps those
extensions that no known label of their own key beats.  Only these are
written, as a table of their own, so what a round writes follows the frontier;
tables of many rounds are merged now and then, each label a logarithmic number
of times.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from isoreach.scratch import Scratch

#: Width of a bucket of costs, in mean costs of an edge.
EDGES_A_BUCKET = 8
#: Tables of known labels of about one size that are merged into a larger one.
MERGED = 24
#: Frontier labels whose extensions' keys are broadcast to the known labels at most.
FRONTIER = 20_000
#: Known labels that Spark may broadcast whole, as it sees fit.
FEW = 100_000
OPERATIONS = ("max_inclusive", "max_exclusive", "min_inclusive", "min_exclusive")


def within_limit(value: Column, op: str, limit: float, switching: Column) -> Column:
    """Limit test: a greatest value always holds, a least one only once the mode is left."""
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op}")
    tests = {"max_inclusive": value <= limit, "max_exclusive": value < limit, "min_inclusive": ~switching | (value >= limit), "min_exclusive": ~switching | (value > limit)}
    return tests[op]


def leg_selected(index: Column, selector: str | int, max_legs: int | None = None) -> Column:
    """Whether a leg (from 0) is ``first``, ``last`` (as many legs as allowed), ``any`` or of an index."""
    if selector == "any":
        return F.lit(True)
    if selector == "last" and max_legs is None:
        raise ValueError("the last leg needs a limit on legs")
    if selector not in ("first", "last") and not isinstance(selector, int):
        raise ValueError(f"unknown leg {selector}")
    return index == {"first": 0, "last": (max_legs or 0) - 1}.get(selector, selector)


@dataclass(frozen=True)
class Limit:
    """A bound on the ``cost`` or ``distance`` of a trip, or of the legs of a mode.

    Without ``mode`` the whole trip counts.  ``leg`` selects legs of the mode:
    ``first``, ``last``, ``any`` or an index.  ``arrival`` names a boolean edge
    column; the bound then holds only on edges that have it set.
    """

    value: float
    of: str = "distance"
    op: str = "max_inclusive"
    mode: str | None = None
    leg: str | int = "any"
    arrival: str | None = None

    @property
    def least(self) -> bool:
        return self.op.startswith("min")


@dataclass(frozen=True)
class Constraints:
    """Limits of a trip.

    ``cost``: a vertex is expanded while its cost is at most this (inclusive).
    ``max_legs``: legs, a new one at each change of mode.  ``modes``: allowed
    modes.  ``mode_counts``: legs per mode; a mode without a limit is invalid.
    ``sequences``: allowed mode sequences; a trip's legs must be a subsequence
    of one of them.  ``distance``: greatest trip distance.  ``mode_cost`` and
    ``mode_distance``: greatest sums per mode, where given.  ``leg_minimum``:
    least distance of a leg before its mode may be left.  ``limits``: further
    bounds on trips and legs.
    """

    cost: float = float("inf")
    max_legs: int | None = None
    modes: frozenset[str] | None = None
    mode_counts: Mapping[str, int] | None = None
    sequences: Sequence[Sequence[str]] | None = None
    distance: float = float("inf")
    mode_cost: Mapping[str, float] = field(default_factory=dict)
    mode_distance: Mapping[str, float] = field(default_factory=dict)
    leg_minimum: Mapping[str, float] = field(default_factory=dict)
    limits: Sequence[Limit] = ()

    def all_limits(self) -> list[Limit]:
        """The bounds on trips and legs, whichever way they were given."""
        more = [Limit(value, op="min_inclusive", mode=mode) for mode, value in self.leg_minimum.items()]
        if self.distance < float("inf"):
            more.append(Limit(self.distance))
        return [*self.limits, *more]

    def tells_legs(self) -> bool:
        """Whether labels with other legs can differ in what they may do next."""
        return any(x is not None for x in (self.max_legs, self.mode_counts, self.sequences)) or any(x.mode or x.least for x in self.all_limits())

    def subsequences(self) -> frozenset[tuple[str, ...]] | None:
        """All subsequences of the allowed sequences."""
        if self.sequences is None:
            return None
        return frozenset(c for s in self.sequences for r in range(len(s) + 1) for c in combinations(s, r))

    def allows(self, legs: Column) -> Column:
        """Whether a trip may have these legs (an array of modes)."""
        ok = F.lit(True)
        if self.max_legs is not None:
            ok &= F.size(legs) <= self.max_legs
        for mode, n in (self.mode_counts or {}).items():
            ok &= F.size(legs) - F.size(F.array_remove(legs, mode)) <= n
        if self.sequences is not None:
            ok &= F.array_join(legs, "\x01").isin(["\x01".join(s) for s in self.subsequences()])
        return ok

    def usable(self, edges: DataFrame) -> DataFrame:
        """The edges whose mode any trip may use."""
        if self.modes is not None:
            edges = edges.where(F.col("mode").isin(*self.modes))
        if self.mode_counts is not None:
            edges = edges.where(F.col("mode").isin(*self.mode_counts))
        return edges

    def rivals(self) -> list[Column]:
        """Sums beside cost that make a label worth keeping; smaller is better.

        More than a least value asks for is no better than that value.
        """
        out = [F.col("sums")[f"{what} {mode}"] for what, given in (("cost", self.mode_cost), ("distance", self.mode_distance)) for mode in given]
        for x in self.all_limits():
            value = F.col(("leg_" if x.mode else "") + x.of)
            if not x.least:
                out += [value] if (x.mode or x.of != "cost") else []
                continue
            out += [-F.least(value, F.lit(x.value))] + ([-(value > x.value).cast("int")] if x.op == "min_exclusive" else [])
        return out


@dataclass(frozen=True)
class Timetable:
    """Departures of edges, on a clock that shows ``start`` when a trip begins.

    ``departures(edge_list_id, edge_id, departure, arrival, route)`` in units
    of cost.  Of an edge's departures from now on, over all its routes, the one
    that arrives first is taken (of several the one that departs first, then
    the least route), so a later express overtakes; its cost is the wait and
    the ride.  Rides that arrive before they depart don't count.  Without a
    further departure the edge can't be used.

    ``mapping(route, target_day, picked_day)`` replaces dates without service:
    on a target day, by its number (days are ``day`` units of the clock long),
    the route runs as from the picked day on.
    """

    departures: DataFrame
    start: float = 0.0
    mapping: DataFrame | None = None
    day: float = 1440.0


@dataclass(frozen=True)
class OnDemand:
    """Zones that a mode serves on demand.

    ``zones(vertex_id, zone_id)`` and ``relations(src_zone, dst_zone, opens,
    closes)`` on a clock that shows ``start`` when a trip begins.  A leg of
    ``mode`` may begin at an edge whose end lies in a zone with an open
    relation; the tree marks the vertices where that leg may end.  Nobody waits
    for a zone to open.
    """

    mode: str
    zones: DataFrame
    relations: DataFrame
    start: float = 0.0


def _added(sums: Column, at: str, value: Column) -> Column:
    """The map of sums with a value added to one of them."""
    return F.transform_values(sums, lambda key, v: F.when(key == at, v + value).otherwise(v))


EDGE = ["edge_list_id", "edge_id"]


def profiles(timetable: Timetable, latest: float) -> DataFrame:
    """(edge_list_id, edge_id, day, times): the departures worth taking of every edge.

    ``day`` is null, or the number of a day on which one of the edge's routes
    is mapped; then the rides of mapped routes are moved back by the days that
    a look-up would be moved forward.  ``times`` are the departures, in order,
    that arrive before all later ones: so the first one from now on is the one
    that arrives first.  It ends with the first one after ``latest``, and after
    the end of its day, which bounds its length whatever the timetable's.
    """
    rides = timetable.departures.where("arrival >= departure").select(*EDGE, "departure", "arrival", "route").withColumn("day", F.lit(None).cast("long"))
    if timetable.mapping is not None:
        mapping = timetable.mapping.groupBy("route", F.col("target_day").cast("long").alias("day")).agg(F.min("picked_day").alias("picked"))
        first, last = int(timetable.start // timetable.day), latest // timetable.day
        mapping = mapping.where((F.col("day") >= first) & (F.col("day") <= last))
        days = rides.select(*EDGE, "route").distinct().join(mapping.select("route", "day"), "route").select(*EDGE, "day").distinct()
        moved = rides.drop("day").join(days, EDGE).join(mapping, ["route", "day"], "left")
        back = F.coalesce((F.col("picked") - F.col("day")) * timetable.day, F.lit(0.0))
        moved = moved.withColumn("departure", F.col("departure") - back).withColumn("arrival", F.col("arrival") - back)
        rides = rides.unionByName(moved.select(*rides.columns))
    begins = F.greatest(F.lit(float(timetable.start)), F.coalesce(F.col("day") * timetable.day, F.lit(float(timetable.start))))
    ends = F.least(F.lit(float(latest)), F.coalesce((F.col("day") + 1) * timetable.day, F.lit(float(latest))))
    ride = F.struct("arrival", "departure", "route")
    of = Window.partitionBy(*EDGE, "day")
    later = of.orderBy(F.desc("departure")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    front = rides.where(F.col("departure") >= begins).withColumn("best", F.min(ride).over(later)).where(F.col("best") == ride).dropDuplicates([*EDGE, "day", "departure"])
    near = front.withColumn("before", F.lag("departure").over(of.orderBy("departure"))).where((F.col("departure") <= ends) | F.col("before").isNull() | (F.col("before") <= ends))
    return near.groupBy(*EDGE, "day").agg(F.sort_array(F.collect_list(F.struct("departure", "arrival", "route"))).alias("times"))


def _hops(edges: DataFrame, limits: Constraints, timetable: Timetable | None, on_demand: OnDemand | None) -> DataFrame:
    """Edges by their start, with departures in order and the zone of their end."""
    flags = sorted({x.arrival for x in limits.limits if x.arrival})
    hop = limits.usable(edges).select(F.col("src").alias("vertex_id"), "dst", "edge_list_id", "edge_id", "mode", F.col("cost").alias("price"), F.col("distance").alias("length"), *flags)
    if timetable:
        found = profiles(timetable, timetable.start + limits.cost)
        every = found.where("day is null").select(*EDGE, "times")
        known = timetable.departures.select(*EDGE, F.lit(True).alias("timed")).distinct()
        hop = hop.join(known, EDGE, "left").join(every, EDGE, "left")
        if timetable.mapping is not None:
            by_day = found.where("day is not null").groupBy(*EDGE).agg(F.map_from_entries(F.collect_list(F.struct("day", "times"))).alias("days"))
            hop = hop.join(by_day, EDGE, "left")
    if on_demand:
        windows = on_demand.relations.groupBy(F.col("src_zone").alias("zone_id")).agg(F.collect_set(F.struct("opens", "closes")).alias("windows"))
        zone = on_demand.zones.groupBy(F.col("vertex_id").alias("dst")).agg(F.min("zone_id").alias("zone_id"))
        hop = hop.join(zone, "dst", "left").join(windows, "zone_id", "left").withColumnRenamed("zone_id", "to_zone")
    return hop


def _steps(frontier: DataFrame, hop: DataFrame, limits: Constraints, timetable: Timetable | None, on_demand: OnDemand | None) -> DataFrame:
    """The valid extensions of labels by one edge."""
    j = frontier.drop("edge_list_id", "edge_id", "parent", "boarding", "dwell").join(hop, "vertex_id")
    price = F.col("price")
    if timetable:
        now = timetable.start + F.col("cost")
        times = F.col("times")
        if timetable.mapping is not None:
            times = F.coalesce(F.element_at("days", F.floor(now / timetable.day).cast("long")), times)
        j = j.withColumn("next", F.get(F.filter(times, lambda t: t["departure"] >= now), F.lit(0))).where("timed is null or next is not null")
        wait = F.col("next.departure") - now
        changed = ~F.col("route").eqNullSafe(F.col("next.route"))
        timed = F.col("timed").isNotNull()
        j = j.withColumn("new_boarding", F.when(timed & changed, wait)).withColumn("new_dwell", F.when(timed & ~changed, wait)).withColumn("route", F.col("next.route"))
        price = F.when(timed, F.col("next.arrival") - now).otherwise(price)
    legs, mode = F.col("legs"), F.col("mode")
    last = F.try_element_at(legs, F.lit(-1))
    same = last.eqNullSafe(mode)
    switching = last.isNotNull() & ~same
    j = j.withColumn("price", price).withColumn("after", F.when(same, legs).otherwise(F.concat(legs, F.array(mode)))).where(limits.allows(F.col("after")))
    new = {"cost": F.col("cost") + F.col("price"), "distance": F.col("distance") + F.col("length")}
    new |= {f"leg_{of}": F.when(same, F.col(f"leg_{of}")).otherwise(0.0) + F.col(by) for of, by in (("cost", "price"), ("distance", "length"))}
    for x in limits.all_limits():
        bounded = F.lit(True) if x.arrival is None else F.coalesce(F.col(x.arrival), F.lit(False))
        if x.mode:  # a least value is asked of the leg that is left, a greatest one of the leg that goes on
            mine = (last if x.least else mode) == x.mode
            index = F.size(legs if x.least else F.col("after")) - 1
            bounded &= F.coalesce(mine, F.lit(False)) & leg_selected(index, x.leg, limits.max_legs)
        name = ("leg_" if x.mode else "") + x.of
        j = j.where(~bounded | within_limit(F.col(name) if x.least else new[name], x.op, x.value, switching))
    sums = F.col("sums")
    for what, by, given in (("cost", "price", limits.mode_cost), ("distance", "length", limits.mode_distance)):
        for m, most in given.items():
            at = f"{what} {m}"
            sums = _added(sums, at, F.when(mode == m, F.col(by)).otherwise(0.0))
            j = j.where((mode != m) | (F.col("sums")[at] + F.col(by) <= most))
    if on_demand:
        now = on_demand.start + F.col("cost")
        riding = F.col("zone").isNotNull() & (last == on_demand.mode)
        open_now = F.coalesce(F.exists("windows", lambda w: (w["opens"] <= now) & (now < w["closes"])), F.lit(False))
        j = j.where((mode != on_demand.mode) | F.coalesce(riding, F.lit(False)) | open_now)
        j = j.withColumn("zone", F.when(mode == on_demand.mode, F.when(riding, F.col("zone")).otherwise(F.col("to_zone"))))
    more = ([] if not timetable else ["route", F.col("new_boarding").alias("boarding"), F.col("new_dwell").alias("dwell")]) + (["zone"] if on_demand else [])
    return j.select("origin", F.col("dst").alias("vertex_id"), F.col("after").alias("legs"), *[c.alias(n) for n, c in new.items()], sums.alias("sums"), (F.col("round") + 1).alias("round"), "edge_list_id", "edge_id", F.col("vertex_id").alias("parent"), *more)


ORDER = ("cost", "round", "edge_list_id", "edge_id", "parent")


def _best(labels: DataFrame, keys: list[str], rivals: list[Column]) -> DataFrame:
    """The labels worth keeping: without rivals the cheapest of each key."""
    rest = [c for c in labels.columns if c not in keys and c not in ORDER]
    if not rivals:
        # maps have no order, so what follows the sort columns rides along as the value
        picked = labels.groupBy(*keys).agg(F.min_by(F.struct(*ORDER, *rest), F.struct(*ORDER)).alias("m"))
        return picked.select(*keys, "m.*").select(*labels.columns)
    rows = labels.select(*keys, F.struct(F.struct("cost", *[c.alias(f"r{i}") for i, c in enumerate(rivals)]).alias("by"), F.struct(*ORDER).alias("order"), F.struct(*ORDER, *rest).alias("row")).alias("m"))
    names = ["cost", *[f"r{i}" for i in range(len(rivals))]]

    def beaten(x: Column, y: Column) -> Column:
        no_worse, better = F.lit(True), F.lit(False)
        for n in names:
            no_worse &= y["by"][n] <= x["by"][n]
            better |= y["by"][n] < x["by"][n]
        return no_worse & (better | (y["order"] < x["order"]))

    listed = rows.groupBy(*keys).agg(F.collect_list("m").alias("all"))
    left = listed.select(*keys, F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: beaten(x, y)))).alias("m"))
    return left.select(*keys, "m.row.*").select(*labels.columns).dropDuplicates([*keys, *ORDER])


class _Known:
    """Labels written round by round, and which of them were not extended yet."""

    def __init__(self, scratch: Scratch, keys: list[str], rivals: list[Column], width: float):
        self.scratch, self.keys, self.rivals, self.width = scratch, keys, rivals, width
        self.written, self.merges, self.total = 0, 0, 0
        self.tables: list[tuple[int, str]] = []  # how often merged, and its tag
        self.open: dict[str, dict[int, int]] = {}  # labels to extend by tag and bucket

    def add(self, labels: DataFrame) -> None:
        """Write labels; those not beyond the limit (``open``) are to be extended."""
        tag = f"labels{self.written}"
        self.written += 1
        bucket = F.when(F.col("open"), F.least(F.floor(F.col("cost") / self.width), F.lit(1 << 40)) if self.width > 0 else F.lit(0)).cast("long")
        seen = Observation(tag)
        measures = (F.count(F.lit(1)).alias("n"), F.count("bucket").alias("open"), F.min("bucket").alias("least"), F.max("bucket").alias("most"))
        table = self.scratch.table(labels.withColumn("bucket", bucket).drop("open").observe(seen, *measures), tag)
        found = seen.get
        if not found.get("n"):
            self.scratch.drop(tag)
            return
        self.schema, self.total = table.schema, self.total + found["n"]
        self.tables.append((0, tag))
        if found["open"] and found["least"] == found["most"]:
            self.open[tag] = {found["least"]: found["open"]}
        elif found["open"]:
            self.open[tag] = {r["bucket"]: r["count"] for r in table.where("bucket is not null").groupBy("bucket").count().collect()}
        level = 0
        while len(same := [t for lv, t in self.tables if lv == level]) >= MERGED:
            merged, self.merges = f"merged{self.merges}", self.merges + 1
            self.scratch.table(self.read(same), merged)
            self.tables = [(lv, t) for lv, t in self.tables if lv != level] + [(level + 1, merged)]
            level += 1

    def read(self, tags: list[str]) -> DataFrame:
        return self.scratch.spark.read.schema(self.schema).parquet(*[f"{self.scratch.root}/{t}" for t in tags])

    def all(self) -> DataFrame:
        return self.read([t for _, t in self.tables]).drop("bucket")

    def frontier(self) -> tuple[DataFrame, int] | None:
        """The labels of the lowest bucket, and how many; they count as extended from now on."""
        if not self.open:
            return None
        least = min(b for counts in self.open.values() for b in counts)
        tags = [t for t, counts in self.open.items() if least in counts]
        labels, n = self.read(tags).where(F.col("bucket") == least).drop("bucket"), sum(self.open[t].pop(least) for t in tags)
        self.open = {t: counts for t, counts in self.open.items() if counts}
        return (labels if len(tags) == 1 else _best(labels, self.keys, self.rivals)), n

    def unbeaten(self, labels: DataFrame, n: int) -> DataFrame:
        """The labels that no known label of the same key beats or equals.

        ``n`` labels were extended to get them: few extensions' keys are
        broadcast, so that only known labels with such keys are shuffled.
        """
        named = [F.col(k).alias(f"known_{k}") for k in self.keys]
        values = {"cost": F.col("cost")} | {f"r{i}": c for i, c in enumerate(self.rivals)}
        known = self.all().select(*named, F.struct(*ORDER).alias("known_order"), *([v.alias(f"known_{k}") for k, v in values.items()] if self.rivals else []))
        same = F.lit(True)
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"known_{k}")) if k == "zone" else F.col(k) == F.col(f"known_{k}")
        if n <= FRONTIER and self.total > FEW:
            known = known.join(F.broadcast(labels.select(*self.keys).distinct()), same, "left_semi")
        mine = labels.select("*", F.struct(*ORDER).alias("order"), *[v.alias(f"mine_{k}") for k, v in values.items()])
        beaten = F.col("known_order") <= F.col("order")
        if self.rivals:
            no_worse, better = F.lit(True), F.lit(False)
            for k in values:
                no_worse &= F.col(f"known_{k}") <= F.col(f"mine_{k}")
                better |= F.col(f"known_{k}") < F.col(f"mine_{k}")
            beaten = no_worse & (better | beaten)
        return mine.join(known, same & beaten, "left_anti").select(*labels.columns)


def reach(
    origins: DataFrame,
    edges: DataFrame,
    limits: Constraints,
    delays: Mapping[int, float] | DataFrame | None = None,
    most: int | None = None,
    by_mode: bool = False,
    timetable: Timetable | None = None,
    on_demand: OnDemand | None = None,
    bucket: float | None = None,
) -> DataFrame:
    """The search tree of every origin: one row per vertex, or per vertex and sequence of modes.

    ``origins(origin)`` and ``edges(src, dst, edge_list_id, edge_id, mode,
    cost, distance)`` with costs of zero or more.  ``delays`` are departure
    delays by origin vertex (a mapping or ``(origin, delay)``), added once at
    the start; ``most`` leaves the cheapest labels of a tree, so many.  The
    origin's own label has no edge.  Ties go to fewer edges, then to the least
    edge.  With a ``timetable`` each row has its ``route``, and the wait as
    ``boarding`` (a new route) or ``dwell``; with ``on_demand`` there is a row per
    vertex and ``zone`` of the current ride, and whether it may end there
    (``may_alight``).

    ``bucket`` is the width of a bucket of costs, by default so many mean costs
    of an edge.  There is no limit on rounds: they end when no label is left to
    extend.  Labels are written to the shared folder; nothing is broadcast but
    the keys of a small frontier and what Spark finds small.
    """
    spark = origins.sparkSession
    scratch = Scratch(spark, "search")
    hop = scratch.table(_hops(edges, limits, timetable, on_demand), "hops")
    first = origins.select("origin").distinct()
    if isinstance(delays, Mapping):
        delays = spark.createDataFrame(list(delays.items()), "origin long, delay double") if delays else None
    first = first.withColumn("delay", F.lit(0.0)) if delays is None else first.join(delays.select("origin", "delay"), "origin", "left").fillna(0.0, ["delay"])
    sums = [F.lit(f"{what} {m}") for what, given in (("cost", limits.mode_cost), ("distance", limits.mode_distance)) for m in given]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    zero = F.lit(0.0)
    more = ([] if not timetable else [none(timetable.departures.schema["route"].dataType, "route"), none("double", "boarding"), none("double", "dwell")]) + ([none(on_demand.zones.schema["zone_id"].dataType, "zone")] if on_demand else [])
    start = first.select(
        "origin",
        F.col("origin").alias("vertex_id"),
        F.array().cast("array<string>").alias("legs"),
        F.col("delay").cast("double").alias("cost"),
        zero.alias("distance"),
        zero.alias("leg_cost"),
        zero.alias("leg_distance"),
        F.create_map(*[x for s in sums for x in (s, zero)]).cast("map<string,double>").alias("sums"),
        F.lit(0).alias("round"),
        none("int", "edge_list_id"),
        none("long", "edge_id"),
        none("long", "parent"),
        *more,
    )
    keys = ["origin", "vertex_id", *(["legs"] if by_mode or limits.tells_legs() else []), *(["zone"] if on_demand else [])]
    rivals = limits.rivals()
    if bucket is None:
        mean = hop.agg(F.avg("price")).head()[0] if limits.cost < float("inf") else None
        bucket = EDGES_A_BUCKET * mean if mean else float("inf")
    known = _Known(scratch, keys, rivals, 0.0 if bucket == float("inf") else bucket)
    known.add(start.withColumn("open", F.col("cost") <= limits.cost))
    while (found := known.frontier()) is not None:
        labels, n = found
        longer = _best(_steps(labels, hop, limits, timetable, on_demand), keys, rivals)
        known.add(known.unbeaten(longer, n).withColumn("open", F.col("cost") <= limits.cost))
    if not known.tables:
        return _tree(start, None, by_mode, timetable, on_demand)
    return _tree(known.all(), most, by_mode, timetable, on_demand)


def _tree(known: DataFrame, most: int | None, by_mode: bool, timetable: Timetable | None, on_demand: OnDemand | None) -> DataFrame:
    """The best known labels as a search tree."""
    tree = _best(known, ["origin", "vertex_id", *(["legs"] if by_mode else []), *(["zone"] if on_demand else [])], [])
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("origin").orderBy(*ORDER, "vertex_id"))
        tree = tree.withColumn("_rank", rank).where(F.col("_rank") <= most)
    extra = ["route", "boarding", "dwell"] if timetable else []
    if on_demand:
        ends = on_demand.relations.select(F.col("src_zone").alias("zone"), F.col("dst_zone").alias("zone_id")).distinct().join(on_demand.zones.select("vertex_id", "zone_id").distinct(), "zone_id")
        tree = tree.join(ends.select("zone", "vertex_id", F.lit(True).alias("may_alight")).distinct(), ["zone", "vertex_id"], "left").fillna(False, ["may_alight"])
        extra += ["zone", "may_alight"]
    return tree.select("origin", "vertex_id", F.array_join("legs", "-").alias("mode_seq"), "cost", "distance", "parent", "edge_list_id", "edge_id", *extra)


def with_costs(edges: DataFrame, speeds: Mapping[str, float | str], default: str | None = None) -> DataFrame:
    """``edges`` with their cost by mode: a fixed speed, or the name of a column of speeds.

    Cost is distance over speed.  Edges of a mode without an entry keep the
    column ``default`` as their cost, or are dropped.
    """
    cost = F.lit(None).cast("double") if default is None else F.col(default)
    for mode, speed in speeds.items():
        by = F.col(speed) if isinstance(speed, str) else F.lit(float(speed))
        cost = F.when(F.col("mode") == mode, F.col("distance") / F.nullif(by, F.lit(0.0))).otherwise(cost)
    return edges.withColumn("cost", cost).where(F.col("cost").isNotNull())
