"""Identifiers, cell indexes, dates and nested-value paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE_ID = r"^[^-]+-[^-]+-[^-]+-[^-]+$"
DOTTED = re.compile(r"^[a-zA-Z_]+(\.[a-zA-Z_]+)*$")


def route_id(edge_list: Column, agency: Column, route: Column, service: Column) -> Column:
    """Fully qualified route id; commas become underscores, a missing agency ``()``."""
    clean = lambda c: F.replace(c.cast("string"), F.lit(","), F.lit("_"))
    return F.concat_ws("->", clean(edge_list), F.coalesce(clean(agency), F.lit("()")), clean(route), clean(service))


def zone_id(agency: Column, route: Column, trip: Column, location: Column) -> Column:
    """Zone id of four hyphen-separated parts; an error if a part is empty or split."""
    made = F.concat_ws("-", agency, route, trip, location)
    return F.when(made.rlike(ZONE_ID), made).otherwise(F.raise_error(F.concat(F.lit("not a zone id: "), made)))


def parse_edge_row(row_id: Column) -> Column:
    """``list-edge`` as struct<edge_list_id, edge_id>; null if it is not one."""
    parts = F.split(row_id, "-")
    made = F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("edge_list_id"), F.get(parts, F.lit(1)).try_cast("long").alias("edge_id"))
    return F.when((F.size(parts) == 2) & made["edge_list_id"].isNotNull() & made["edge_id"].isNotNull(), made)


def row_id(orientation: Column, origin: Column, destination: Column, edge_list: Column, edge: Column) -> Column:
    """Opportunity row id by orientation: origin, destination or edge."""
    return F.when(orientation == "origin", origin.cast("string")).when(orientation == "destination", destination.cast("string")).when(orientation == "edge", F.concat_ws("-", edge_list.cast("string"), edge.cast("string")))


def provider_filename(state: Column, municipality: Column, provider: Column, name: Column) -> Column:
    """File stem of a feed: present parts by hyphens, no parentheses, no spaces."""
    clean = lambda c: F.translate(c, " ()", "_")
    return F.concat_ws("-", clean(state), clean(municipality), clean(provider), clean(name))


def cell_resolution(cell: Column) -> Column:
    """Resolution 0..15 of a hexagonal cell index in hexadecimal."""
    return F.conv(F.substring(F.lpad(cell, 16, "0"), 2, 2), 16, 10).cast("int").bitwiseAND(F.lit(0xF))


def cell_parent(cell: Column, resolution: int) -> Column:
    """Parent cell at a resolution: the resolution bits set, finer digits all ones.

    The same resolution is the cell itself; a finer one is an error.
    """
    own = F.shiftright(F.conv(cell, 16, 10).cast("decimal(20,0)").cast("long"), 52).bitwiseAND(F.lit(15).cast("long"))
    value = F.conv(cell, 16, 10).cast("decimal(20,0)").cast("long")
    ones = F.lit((1 << (3 * (15 - resolution))) - 1).cast("long")
    cleared = value.bitwiseAND(F.lit(~(15 << 52)).cast("long")).bitwiseOR(F.lit(resolution << 52).cast("long"))
    parent = F.lower(F.hex(cleared.bitwiseOR(ones)))
    return F.when(own == resolution, F.lower(cell)).when(own > resolution, parent).otherwise(F.raise_error(F.lit("the target resolution is finer than the cell's")))


def dotted_path(path: str) -> str:
    """A dotted path as a JSON path; an error for anything else."""
    if not DOTTED.match(path):
        raise ValueError(f"not a dotted path: {path!r}")
    return "$." + path


def json_value(column: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text."""
    return F.get_json_object(column, dotted_path(path))


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """``xmin,xmax,ymin,ymax`` with range checks."""
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a bbox has four numbers: xmin,xmax,ymin,ymax")
    xmin, xmax, ymin, ymax = parts
    if not (-180 <= xmin <= xmax <= 180 and -90 <= ymin <= ymax <= 90):
        raise ValueError(f"bbox out of range: {text}")
    return xmin, xmax, ymin, ymax


def stop_timestamp(date: Column, seconds: Column) -> Column:
    """Time of a stop on a service date; seconds may pass midnight."""
    return F.timestamp_add("SECOND", seconds.cast("int"), date.cast("timestamp_ntz"))


def window_contains(now: Column, start: Column, end: Column) -> Column:
    """Whether seconds of the day fall in ``[start, end)``; missing ends are open."""
    return (now >= F.coalesce(start, F.lit(0))) & (now < F.coalesce(end, F.lit(86399)))


def path_between(nodes: Column, src: Column, dst: Column) -> Column:
    """Sub-sequence of a way's nodes from ``src`` to ``dst``; null if absent or backwards."""
    a, b = F.array_position(nodes, src), F.array_position(nodes, dst)
    return F.when((a > 0) & (b >= a), F.slice(nodes, a.cast("int"), (b - a + 1).cast("int")))
