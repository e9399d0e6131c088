"""Segment records: restrictions, headings, linear limits, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.functions import geometry as geo
from isoreach.functions.tags import MPH_KPH
from isoreach.operators.spatial import lines_in_rings
from isoreach.scratch import Scratch


def mode_access_state(restrictions: Column, modes: Sequence[str]) -> Column:
    """State after all restrictions in order: default, blanket, exception or denied.

    A denial without any condition is a blanket one, from the default only.  A
    denial for one of the modes (any or forward heading) is final.  A permit
    for the mode is an exception unless denied; one with further conditions
    (using, recognized) counts as a denial.
    """
    own = F.array(*[F.lit(m) for m in modes])

    def step(state: Column, r: Column) -> Column:
        when = r["when"]
        ours = F.coalesce(F.arrays_overlap(when["mode"], own), F.lit(False))
        forward = when["heading"].isNull() | (when["heading"] == "forward")
        conditions = when["using"].isNotNull() | when["recognized"].isNotNull()
        denied, permitted = r["access_type"] == "denied", r["access_type"].isin("allowed", "designated")
        return (
            F.when(denied & when.isNull() & (state == "default"), "blanket")
            .when(denied & ours & forward, "denied")
            .when(permitted & ours & forward & (state != "denied"), F.when(conditions, "denied").otherwise("exception"))
            .otherwise(state)
        )

    return F.aggregate(restrictions, F.lit("default"), step)


def supports_mode(restrictions: Column, modes: Sequence[str]) -> Column:
    """Whether a segment is open to the modes; without restrictions it is."""
    return F.coalesce(mode_access_state(restrictions, modes), F.lit("default")).isin("default", "exception")


def applies(when: Column, heading: str, query: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Whether a restriction's conditions hold for a heading and a query.

    Modes need any overlap, ``using`` and ``recognized`` all of the query's
    values; a condition that the query does not mention is not met.
    """
    query = query or {}
    out = when["heading"].isNull() | (when["heading"] == heading)
    for name in ("mode", "using", "recognized"):
        values = query.get(name)
        if not values:
            out = out & when[name].isNull()
        elif name == "mode":
            out = out & (when[name].isNull() | F.arrays_overlap(when[name], F.array(*[F.lit(v) for v in values])))
        else:
            out = out & (when[name].isNull() | (F.size(F.array_except(F.array(*[F.lit(v) for v in values]), when[name])) == 0))
    return when.isNull() | F.coalesce(out, F.lit(False))


def heading_valid(restrictions: Column, heading: str, query: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Whether a heading is open.

    A denial for the heading yields only to a permit for the heading; otherwise
    any permit, or no general denial, opens it.
    """
    specific = lambda r: r["when"]["heading"].isNotNull()
    denied = lambda r: r["access_type"] == "denied"
    hold = lambda r: applies(r["when"], heading, query)
    any_of = lambda test: F.exists(restrictions, lambda r: hold(r) & test(r))
    head_denied, head_open = any_of(lambda r: specific(r) & denied(r)), any_of(lambda r: specific(r) & ~denied(r))
    all_denied, all_open = any_of(lambda r: ~specific(r) & denied(r)), any_of(lambda r: ~specific(r) & ~denied(r))
    return F.coalesce(F.when(head_denied, head_open).otherwise(head_open | all_open | ~all_denied), F.lit(True))


def headings(restrictions: Column, query: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The open headings of a segment as an array."""
    both = F.array(*[F.when(heading_valid(restrictions, h, query), F.lit(h)) for h in ("forward", "backward")])
    return F.filter(both, lambda h: h.isNotNull())


def overlap(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    """Length of the overlap of two intervals."""
    return F.greatest(F.lit(0.0), F.least(hi, end) - F.greatest(lo, start))


def split_speed(limits: Column, start: Column, end: Column) -> Column:
    """Overlap-weighted speed of a stretch from linear limits (between, mph).

    A limit without ``between`` holds everywhere; null with no overlap.
    """
    part = lambda s: overlap(F.coalesce(s["between"]["lo"], F.lit(0.0)), F.coalesce(s["between"]["hi"], F.lit(1.0)), start, end)
    total = F.aggregate(F.transform(limits, part), F.lit(0.0), lambda a, v: a + v)
    weighted = F.aggregate(F.transform(limits, lambda s: part(s) * s["mph"]), F.lit(0.0), lambda a, v: a + v)
    return F.when(total >= 1e-6, weighted / total)


def class_filter(column: Column, classes: Sequence[str], include: bool = True, allow_unset: bool = False) -> Column:
    """Class membership; an unset class passes only where allowed."""
    inside = column.isin(*classes)
    return F.coalesce(inside if include else ~inside, F.lit(allow_unset))


def subclass_filter(klass: Column, subclass: Column, classes: Mapping[str, Sequence[str]], include: bool = True, allow_unset: bool = False) -> Column:
    """Class with its subclasses: an unknown class or an unset one passes only where allowed."""
    known = klass.isin(*classes)
    fits = F.lit(False)
    for name, subs in classes.items():
        fits = fits | ((klass == name) & (subclass.isin(*subs) if subs else F.lit(False)))
    without = known if include else ~known
    with_sub = F.when(known, fits if include else ~fits).otherwise(F.lit(allow_unset))
    return F.when(klass.isNull(), F.lit(allow_unset)).when(subclass.isNull(), without).otherwise(with_sub)


def taxonomy_filter(primary: Column, alternate: Column, wanted: Sequence[str]) -> Column:
    """Primary or any alternate category among the wanted ones."""
    return F.coalesce(primary.isin(*wanted), F.lit(False)) | F.coalesce(F.arrays_overlap(alternate, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def row_filter(**variants: Column) -> Column:
    """All given filters at once; each keyword is one variant, so none repeats."""
    out = F.lit(True)
    for test in variants.values():
        out = out & test
    return out


def in_extent(segments: DataFrame, connectors: DataFrame, extent: DataFrame, cell: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Segments that share a point with any ring of an extent, and the connectors that they use.

    ``extent(ring_id, ring)``.  A segment that crosses the extent between two
    of its points stays; one without points goes.
    """
    met = lines_in_rings(segments.select("id", "line"), extent, "id", "ring_id", cell).select("id").distinct()
    kept = segments.join(met, "id", "left_semi")
    used = kept.select(F.explode("connectors").alias("c")).select(F.col("c.connector_id").alias("connector_id")).distinct()
    return kept, connectors.join(used, "connector_id", "left_semi")


def stretches(segments: DataFrame, travel: Column, extra: Sequence[str] = ()) -> DataFrame:
    """The parts of segments between consecutive connectors, one row each, of segments whose array ``travel`` is not empty.

    ``segments`` are those of ``splits``.  Ends and geometry are those of the
    forward heading; ``extra`` names more columns of the result.  Every segment
    is split by itself, without a shuffle.
    """
    stop = F.array_sort(F.transform("connectors", lambda c: F.struct(c["at"].alias("at"), c["connector_id"].alias("id"))))
    pairs = F.zip_with(F.slice("_stops", F.lit(1), F.greatest(F.size("_stops") - 1, F.lit(0))), F.slice("_stops", F.lit(2), F.greatest(F.size("_stops") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = segments.withColumn("_stops", stop).where("size(_stops) > 1").withColumn("travel", travel).where("size(travel) > 0")
    cut = cut.withColumn("_legs", geo.measured(F.col("line"))).withColumn("_pair", F.explode(pairs))  # measured once a segment
    at, until = F.col("_pair.a.at"), F.col("_pair.b.at")
    return cut.select(
        "id",
        F.col("_pair.a.id").alias("src_connector"),
        F.col("_pair.b.id").alias("dst_connector"),
        at.alias("start"),
        until.alias("end"),
        (geo.measured_length(F.col("_legs")) * (until - at)).alias("distance"),
        geo.cut(F.col("_legs"), at, until).alias("geometry"),
        (split_speed(F.col("speed_limits"), at, until) * MPH_KPH).alias("kph"),
        "class",
        "travel",
        *extra,
    )


def splits(segments: DataFrame, travel: Column | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Directed splits between consecutive connectors, one row per open heading.

    ``segments(id, line, connectors array<struct<connector_id, at>>,
    access_restrictions, speed_limits, class)``.  The backward split swaps its
    ends and reverses its geometry.  ``travel`` is an array of structs with a
    ``heading``, by default the segment's open headings; ``extra`` names more
    columns of the result, those of the structs as ``travel.name``.
    """
    if travel is None:
        travel = F.transform(headings(F.col("access_restrictions")), lambda h: F.struct(h.alias("heading")))
    # cut once a stretch; every heading takes it from there
    cut = stretches(segments, travel, [c for c in extra if not c.startswith("travel.")])
    back = F.col("travel.heading") == "backward"
    return cut.withColumn("travel", F.explode("travel")).select(
        "id",
        "travel.heading",
        F.when(back, F.col("dst_connector")).otherwise(F.col("src_connector")).alias("src_connector"),
        F.when(back, F.col("src_connector")).otherwise(F.col("dst_connector")).alias("dst_connector"),
        "start",
        "end",
        "distance",
        F.when(back, F.reverse("geometry")).otherwise(F.col("geometry")).alias("geometry"),
        "kph",
        "class",
        *extra,
    )


def network(segments: DataFrame, connectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (numbered connectors in use) and edges of a set of segments.

    A connector that is not in the table is an error.
    """
    parts = Scratch(segments.sparkSession, "splits").table(splits(segments), "parts")  # read for either end of the vertices and for the edges
    used = parts.select(F.col("src_connector").alias("connector_id")).union(parts.select("dst_connector")).distinct()
    vertices = used.join(connectors, "connector_id", "left").withColumn("x", F.when(F.col("x").isNotNull(), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("unknown connector "), "connector_id")).cast("double")))
    vertices = vertices.withColumn("vertex_id", F.xxhash64("connector_id"))
    ends = vertices.select("connector_id", "vertex_id")
    edges = parts.join(ends.select(F.col("connector_id").alias("src_connector"), F.col("vertex_id").alias("src")), "src_connector").join(ends.select(F.col("connector_id").alias("dst_connector"), F.col("vertex_id").alias("dst")), "dst_connector")
    return vertices, edges.withColumn("edge_id", F.xxhash64("id", "heading", "start")).withColumn("bearing", geo.exit_bearing(F.col("geometry")))
