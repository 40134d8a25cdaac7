"""Geometry as a struct column, with constructors and measures as Column expressions.

A geometry is ``struct<type, parts>``: parts hold rings, rings hold vertices. A
point has one ring of one vertex, a line one ring for each part, a polygon its
exterior ring first (closed: the first vertex is repeated) and its holes after.
Null is no geometry; an empty geometry has no parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double>"
RING = f"array<{VERTEX}>"
GEOMETRY = f"struct<type:string,parts:array<array<{RING}>>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vertex(x: Column | str | float, y: Column | str | float) -> Column:
    x, y = (F.lit(float(c)) if isinstance(c, (int, float)) else _col(c).cast("double") for c in (x, y))
    return F.struct(x.alias("x"), y.alias("y"))


def geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts")).cast(GEOMETRY)


def point(x: Column | str, y: Column | str) -> Column:
    return geometry("Point", F.array(F.array(F.array(vertex(x, y)))))


def line(vertices: Column) -> Column:
    """A line through an array of vertices."""
    return geometry("LineString", F.array(F.array(vertices)))


def polygon(*rings: Column) -> Column:
    """A polygon from closed rings, the exterior first."""
    return geometry("Polygon", F.array(F.array(*rings)))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return polygon(F.array(vertex(xmin, ymin), vertex(xmax, ymin), vertex(xmax, ymax), vertex(xmin, ymax), vertex(xmin, ymin)))


def make_lines_between_points(*points: Column) -> Column:
    """The line through a row's points, given as vertices."""
    return line(F.array(*points))


def rings(g: Column | str) -> Column:
    """All rings of all parts."""
    return F.flatten(_col(g)["parts"])


def vertices(g: Column | str) -> Column:
    """All vertices; for ``coordinate_array``."""
    return F.flatten(rings(g))


def is_empty(g: Column | str) -> Column:
    return F.size(vertices(g)) == 0


def geom_family(g: Column | str) -> Column:
    """polygon, line, point or mixed."""
    kind = F.lower(F.regexp_replace(_col(g)["type"], "^Multi", ""))
    return F.when(kind == "polygon", "polygon").when(kind.isin("linestring", "linearring"), "line").when(kind == "point", "point").otherwise("mixed")


def _reduce(ring: Column, f) -> Column:
    """Sum of f(a, b) over a ring's consecutive vertices."""
    first = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast(VERTEX).alias("p"))

    def step(acc: Column, v: Column) -> Column:
        return F.struct(F.when(acc["p"].isNull(), acc["s"]).otherwise(acc["s"] + f(acc["p"], v)).alias("s"), v.alias("p"))

    return F.aggregate(ring, first, step, lambda acc: acc["s"])


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive counter-clockwise."""
    return _reduce(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(g: Column | str) -> Column:
    """Exterior rings minus holes; 0 for points and lines."""
    part = lambda rings_: F.abs(signed_area(rings_[0])) - F.aggregate(F.slice(rings_, 2, F.greatest(F.lit(0), F.size(rings_) - 1)), F.lit(0.0), lambda s, r: s + F.abs(signed_area(r)))
    return F.when(_col(g)["type"].like("%Polygon"), F.aggregate(F.filter(_col(g)["parts"], lambda p: F.size(p) > 0), F.lit(0.0), lambda s, p: s + part(p))).otherwise(F.when(_col(g).isNotNull(), F.lit(0.0)))


def length(g: Column | str) -> Column:
    """Length of lines, perimeter of polygons."""
    return F.aggregate(rings(g), F.lit(0.0), lambda s, r: s + _reduce(r, lambda a, b: F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)))


def ring_centroid(ring: Column, axis: str) -> Column:
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    return _reduce(ring, lambda a, b: (a[axis] + b[axis]) * cross(a, b)) / (6 * signed_area(ring))


def centroid(g: Column | str) -> Column:
    """The vertex at a geometry's centroid: by area for polygons, by length for lines, by count for points."""
    g = _col(g)
    all_rings, many = rings(g), vertices(g)
    size = lambda r: _reduce(r, lambda a, b: F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2))

    def by_line(axis: str) -> Column:
        mid = lambda r: _reduce(r, lambda a, b: (a[axis] + b[axis]) / 2 * F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2))
        return F.aggregate(all_rings, F.lit(0.0), lambda s, r: s + mid(r)) / F.aggregate(all_rings, F.lit(0.0), lambda s, r: s + size(r))

    def by_area(axis: str) -> Column:
        # holes count against the exterior, whatever way a ring runs
        def part(p: Column) -> Column:
            outer = F.abs(signed_area(p[0])) * ring_centroid(p[0], axis)
            return outer - F.aggregate(F.slice(p, 2, F.greatest(F.lit(0), F.size(p) - 1)), F.lit(0.0), lambda s, r: s + F.abs(signed_area(r)) * ring_centroid(r, axis))

        return F.aggregate(g["parts"], F.lit(0.0), lambda s, p: s + part(p)) / area(g)

    def by_point(axis: str) -> Column:
        return F.aggregate(many, F.lit(0.0), lambda s, v: s + v[axis]) / F.size(many)

    pick = lambda axis: F.when(g["type"].like("%Polygon"), by_area(axis)).when(g["type"].like("%Point"), by_point(axis)).otherwise(by_line(axis))
    return F.struct(pick("x").alias("x"), pick("y").alias("y"))


def bounds(g: Column | str) -> Column:
    """struct<xmin, ymin, xmax, ymax>."""
    v = vertices(g)
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it; the generated code stays small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_box(g: Column | str) -> Column:
    """Whether a geometry is an upright rectangle: one closed ring of four corners."""

    def corners(ring: Column) -> Column:
        a, b, c, d, e = (F.get(ring, F.lit(n)) for n in range(5))
        turn = lambda p, q: (a[p] == b[p]) & (b[q] == c[q]) & (c[p] == d[p]) & (d[q] == a[q])
        return (F.size(ring) == 5) & (a == e) & (a["x"] != c["x"]) & (a["y"] != c["y"]) & (turn("x", "y") | turn("y", "x"))

    def one(s: Column) -> Column:
        part = F.get(s["parts"], F.lit(0))
        return (s["type"] == "Polygon") & (F.size(s["parts"]) == 1) & (F.size(part) == 1) & bound(F.get(part, F.lit(0)), corners)

    return F.coalesce(bound(_col(g), one), F.lit(False))


def bounds_to_polygon(g: Column | str) -> Column:
    b = bounds(g)
    return box(b["xmin"], b["ymin"], b["xmax"], b["ymax"])


def bounds_to_points(g: Column | str) -> Column:
    """The four corners of the bounds as a MultiPoint."""
    b = bounds(g)
    corners = [vertex(b[x], b[y]) for x, y in (("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"))]
    return geometry("MultiPoint", F.array(*[F.array(F.array(c)) for c in corners]))


def first_vertex(g: Column | str) -> Column:
    return F.get(vertices(g), F.lit(0))


def last_vertex(g: Column | str) -> Column:
    return F.try_element_at(vertices(g), F.lit(-1))


def is_closed(g: Column | str) -> Column:
    return first_vertex(g) == last_vertex(g)


def segments(g: Column | str, cycle: bool = False) -> Column:
    """array<struct<a, b>>: the two-point segments of all rings; ``cycle`` closes each ring."""

    def of(r: Column) -> Column:
        r = F.concat(r, F.slice(r, 1, 1)) if cycle else r
        n = F.greatest(F.lit(0), F.size(r) - 1)
        return F.transform(F.slice(r, 1, n), lambda v, i: F.struct(v.alias("a"), F.get(r, i + 1).alias("b")))

    return F.flatten(F.transform(rings(g), of))


def polygons_to_lines(g: Column | str) -> Column:
    """A polygon's boundary as lines."""
    return geometry("MultiLineString", F.transform(rings(g), lambda r: F.array(r)))


def contains_vertex(g: Column | str, v: Column) -> Column:
    """Even-odd ray casting; a vertex on the boundary may count either way."""
    odd = lambda r: F.pmod(
        _reduce(r, lambda a, b: F.when(((a["y"] > v["y"]) != (b["y"] > v["y"])) & (v["x"] < (b["x"] - a["x"]) * (v["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1.0).otherwise(0.0)), F.lit(2.0)
    )
    crossings = F.aggregate(rings(g), F.lit(0.0), lambda s, r: s + odd(r))
    return F.pmod(crossings, F.lit(2.0)) == 1.0


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def closest_on_segment(v: Column, a: Column, b: Column) -> Column:
    """The vertex of segment a-b that is closest to v."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((v["x"] - a["x"]) * dx + (v["y"] - a["y"]) * dy) / size)))
    return vertex(a["x"] + t * dx, a["y"] + t * dy)


def angle(a: Column, b: Column) -> Column:
    """Bearing from a to b in degrees, clockwise from north."""
    return F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"]))


def extend_lines(a: Column, b: Column, by: Column | float) -> Column:
    """The line from a over b to ``by`` beyond b; null for a line of no length."""
    size = distance(a["x"], a["y"], b["x"], b["y"])
    by = F.lit(float(by)) if isinstance(by, (int, float)) else by
    end = vertex(b["x"] + (b["x"] - a["x"]) / size * by, b["y"] + (b["y"] - a["y"]) / size * by)
    return F.when(size > 0, line(F.array(a, end)))


def point_buffer(v: Column, radius: Column | float, resolution: int = 30) -> Column:
    """A circle of 4 * resolution corners."""
    radius = F.lit(float(radius)) if isinstance(radius, (int, float)) else radius
    n = 4 * resolution
    corner = lambda i: vertex(v["x"] + radius * F.cos(i * (2 * 3.141592653589793 / n)), v["y"] - radius * F.sin(i * (2 * 3.141592653589793 / n)))
    return polygon(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: corner(i % n)))


def get_holes(g: Column | str) -> Column:
    """array of polygons: one for each hole."""
    holes = F.flatten(F.transform(_col(g)["parts"], lambda p: F.slice(p, 2, F.greatest(F.lit(0), F.size(p) - 1))))
    return F.transform(holes, lambda r: polygon(r))


def close_all_holes(g: Column | str) -> Column:
    """Exterior rings only (islands in holes are ignored)."""
    return F.struct(_col(g)["type"].alias("type"), F.transform(_col(g)["parts"], lambda p: F.slice(p, 1, 1)).alias("parts"))


def close_small_holes(g: Column | str, max_area: float) -> Column:
    """Without the holes of an area below ``max_area`` (islands are ignored)."""
    keep = lambda p: F.filter(p, lambda r, i: (i == 0) | (F.abs(signed_area(r)) >= max_area))
    return F.struct(_col(g)["type"].alias("type"), F.transform(_col(g)["parts"], keep).alias("parts"))


def explode_parts(g: Column | str) -> Column:
    """array of single-part geometries, for ``make_all_singlepart``."""
    g = _col(g)
    kind = F.regexp_replace(g["type"], "^Multi", "")
    return F.transform(g["parts"], lambda p: F.struct(kind.alias("type"), F.array(p).alias("parts")))


def to_wkt(g: Column | str) -> Column:
    """Well-known text with up to six decimals."""
    g = _col(g)
    number = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), "\\.$", "")
    pair = lambda v: F.concat(number(v["x"]), F.lit(" "), number(v["y"]))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(")"))
    rings_ = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    kind, first = F.upper(g["type"]), g["parts"][0]
    body = (
        F.when(kind.isin("POINT", "LINESTRING", "LINEARRING"), ring(first[0]))
        .when(kind == "POLYGON", rings_(first))
        .when(kind.isin("MULTIPOINT", "MULTILINESTRING"), F.concat(F.lit("("), F.array_join(F.transform(g["parts"], lambda p: ring(p[0])), ", "), F.lit(")")))
        .otherwise(F.concat(F.lit("("), F.array_join(F.transform(g["parts"], rings_), ", "), F.lit(")")))
    )
    return F.when(F.size(g["parts"]) == 0, F.concat(kind, F.lit(" EMPTY"))).otherwise(F.concat(kind, F.lit(" "), body))
