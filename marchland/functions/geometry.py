"""Geometry as expressions: web mercator, envelopes, well-known text, curves, circles, rings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sphere's radius of the web-mercator projection, in metres.
MERCATOR_RADIUS = 6378137.0


def to_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon), F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - F.lit(math.pi / 2)), F.degrees(x / MERCATOR_RADIUS)


def half_open(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Lower edges belong to a rectangle, upper ones to the next."""
    return (x >= xmin) & (x < xmax) & (y >= ymin) & (y < ymax)


def in_envelope(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return x.between(xmin, xmax) & y.between(ymin, ymax)


def envelopes_meet(a: Column, b: Column) -> Column:
    """Of structs xmin, ymin, xmax, ymax."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def envelope(ring: Column) -> Column:
    """Of an array of struct x, y."""
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("xmin"), F.array_min(y).alias("ymin"), F.array_max(x).alias("xmax"), F.array_max(y).alias("ymax"))


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def wkt_polygon(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


#: A number of well-known text.
_NUMBER = "[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def read_wkt_point(text: Column) -> Column:
    """struct x, y; NULL for anything else."""
    pattern = f"^\\s*(?i:POINT)\\s*\\(\\s*({_NUMBER})\\s+({_NUMBER})\\s*\\)\\s*$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("double").alias("x"), F.regexp_extract(text, pattern, 2).cast("double").alias("y")))


def read_wkt_rings(text: Column) -> Column:
    """array<array<struct x, y>> of a POLYGON; NULL for anything else."""
    body = F.regexp_extract(text, "^\\s*(?i:POLYGON)\\s*\\(\\s*\\((.*)\\)\\s*\\)\\s*$", 1)

    def ring(part: Column) -> Column:
        return F.transform(F.split(F.trim(part), "\\s*,\\s*"), lambda p: F.struct(F.split_part(F.trim(p), F.lit(" "), F.lit(1)).try_cast("double").alias("x"), F.split_part(F.trim(p), F.lit(" "), F.lit(-1)).try_cast("double").alias("y")))

    return F.when(F.length(body) > 0, F.transform(F.split(body, "\\)\\s*,\\s*\\("), ring))


def coordinate_list(text: Column, sep: str = ",") -> Column:
    """array<double> of a delimited list; parts that are no number become NULL."""
    return F.transform(F.split(F.trim(text), f"\\s*{sep}\\s*"), lambda v: v.try_cast("double"))


def geojson_point(x: Column, y: Column, **properties: Column) -> Column:
    parts = [F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry")]
    if properties:
        parts.append(F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties"))
    return F.to_json(F.struct(*parts))


def read_geojson_point(text: Column, properties: str = "") -> Column:
    """struct x, y and the named properties (a DDL list)."""
    schema = "type string, geometry struct<type: string, coordinates: array<double>>" + (f", properties struct<{properties}>" if properties else "")
    j = F.from_json(text, schema)
    at = j["geometry"]["coordinates"]
    parts = [F.element_at(at, 1).alias("x"), F.element_at(at, 2).alias("y")] + ([j["properties"].alias("properties")] if properties else [])
    return F.when(j["geometry"]["type"] == "Point", F.struct(*parts))


def hilbert(cx: Column, cy: Column, bits: int) -> Column:
    """Place of a cell (0 .. 2^bits - 1 each way) along the Hilbert curve, unrolled over the bits."""
    # (x, y, d) through the bits from the top: rotate the quadrant, add its rank
    steps = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])

    def turn(state: Column, s: Column) -> Column:
        rx = F.when(state["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(state["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        rank = (F.lit(3) * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - state["x"].bitwiseAND(s - 1)).otherwise(state["x"].bitwiseAND(s - 1)), F.when(flip, s - 1 - state["y"].bitwiseAND(s - 1)).otherwise(state["y"].bitwiseAND(s - 1))
        return F.struct(F.when(ry == 0, fy).otherwise(fx).cast("long").alias("x"), F.when(ry == 0, fx).otherwise(fy).cast("long").alias("y"), (state["d"] + s * s * rank).cast("long").alias("d"))

    start = F.struct(cx.cast("long").alias("x"), cy.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(steps, start, turn, lambda s: s["d"])


def hilbert_cell(d: Column, bits: int) -> Column:
    """struct x, y of a place along the curve."""
    steps = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])

    def turn(state: Column, s: Column) -> Column:
        q = F.floor(state["d"] / (s * s)) % 4
        rx = F.floor(q / 2).cast("long")
        ry = q.cast("long").bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - state["x"]).otherwise(state["x"]), F.when(flip, s - 1 - state["y"]).otherwise(state["y"])
        nx, ny = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct((nx + s * rx).cast("long").alias("x"), (ny + s * ry).cast("long").alias("y"), state["d"].alias("d"))

    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), d.cast("long").alias("d"))
    return F.aggregate(steps, start, turn, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def axis_cell(v: Column, lo: float, hi: float, bits: int) -> Column:
    """A coordinate to 0 .. 2^bits - 1 of its extent."""
    cells = 1 << bits
    if hi <= lo:
        return F.lit(0).cast("long")
    return F.least(F.lit(cells - 1), F.floor((v - F.lit(lo)) / (F.lit(hi) - F.lit(lo)) * cells)).cast("long")


def circle_covers(cx: Column, cy: Column, r: Column, x: Column, y: Column) -> Column:
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def circle_covers_all(cx: Column, cy: Column, r: Column, ring: Column) -> Column:
    """All corners, and so everything between them, lie in the circle."""
    return F.forall(ring, lambda p: circle_covers(cx, cy, r, p["x"], p["y"]))


def segment_distance2(cx: Column, cy: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - x1) * dx + (cy - y1) * dy) / long2))).otherwise(F.lit(0.0))
    px, py = x1 + t * dx - cx, y1 + t * dy - cy
    return px * px + py * py


def circle_meets_segment(cx: Column, cy: Column, r: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return segment_distance2(cx, cy, x1, y1, x2, y2) <= r * r


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule for an array of struct x, y, open or closed."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def circle_meets_ring(cx: Column, cy: Column, r: Column, ring: Column) -> Column:
    """The circle's centre lies in the polygon or one of its edges comes near enough."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return in_ring(cx, cy, ring) | F.exists(edges, lambda e: circle_meets_segment(cx, cy, r, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def swapped(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["y"].alias("x"), p["x"].alias("y")))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def read_wkt_parts(text: Column) -> Column:
    """struct kind, parts (array<array<struct x, y>>) of any POINT, LINESTRING, POLYGON, their MULTI forms or a collection of them;
    parts are the innermost lists of places in order (points, lines, rings). NULL where the text has none."""
    kind = F.upper(F.regexp_extract(text, "^\\s*([A-Za-z]+)", 1))
    lists = F.regexp_extract_all(text, F.lit("\\(([^()]+)\\)"), F.lit(1))

    def places(part: Column) -> Column:
        return F.transform(F.split(F.trim(part), "\\s*,\\s*"), lambda p: F.struct(F.split_part(F.trim(p), F.lit(" "), F.lit(1)).try_cast("double").alias("x"), F.split_part(F.regexp_replace(F.trim(p), "\\s+", " "), F.lit(" "), F.lit(2)).try_cast("double").alias("y")))

    parts = F.transform(lists, places)
    # the places of a multi-point may stand without brackets of their own
    loose = (kind == "MULTIPOINT") & (F.size(parts) == 1)
    parts = F.when(loose, F.transform(F.element_at(parts, 1), lambda p: F.array(p))).otherwise(parts)
    return F.when(F.size(lists) > 0, F.struct(kind.alias("kind"), parts.alias("parts")))


def wkt_multi(kind: str, parts: Column) -> Column:
    """Text of a MULTIPOINT, MULTILINESTRING or (rings of one) POLYGON from lists of places."""
    places = lambda part: F.concat(F.lit("("), F.concat_ws(", ", F.transform(part, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))), F.lit(")"))
    return F.concat(F.lit(kind + " ("), F.concat_ws(", ", F.transform(parts, places)), F.lit(")"))


def same_ring(a: Column, b: Column) -> Column:
    """Whether two rings (array<struct x, y>) have the same places in the same order, a closing place left out on either side."""
    opened = lambda r: F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    return F.coalesce(opened(a) == opened(b), F.lit(False))


def envelope_covers(a: Column, b: Column) -> Column:
    """Whether envelope a (struct xmin, ymin, xmax, ymax) holds all of envelope b, edges included."""
    return (a["xmin"] <= b["xmin"]) & (a["ymin"] <= b["ymin"]) & (a["xmax"] >= b["xmax"]) & (a["ymax"] >= b["ymax"])


def reference_point(a: Column, b: Column) -> Column:
    """Lower left corner of what two envelopes share (struct x, y): of the cells both lie in, the one that holds it reports the pair,
    so that it comes out once."""
    return F.struct(F.greatest(a["xmin"], b["xmin"]).alias("x"), F.greatest(a["ymin"], b["ymin"]).alias("y"))
