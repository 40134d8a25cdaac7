"""Arrow-batched UDFs over geometry structs: what Column expressions cannot say.

Each takes and returns geometry structs (see ``geometry``); null in, null out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from geoengine.functions import overlay_kernel as k
from geoengine.functions.geometry import GEOMETRY, bound, bounds, box, geometry, is_box


def parts_of(g) -> list:
    return [[[(v["x"], v["y"]) for v in ring] for ring in part] for part in g["parts"]]


def struct(kind: str, parts) -> dict:
    return {"type": kind, "parts": [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]}


def polygon_struct(parts) -> dict:
    return struct("Polygon" if len(parts) == 1 else "MultiPolygon", parts)


def lines_struct(lines) -> dict:
    return struct("LineString" if len(lines) == 1 else "MultiLineString", [[x] for x in lines])


def udf(kind: str | DataType) -> Callable:
    """A row function with Arrow transfer; any null argument gives null."""

    def wrap(f):
        def safe(*args):
            return None if any(a is None for a in args) else f(*args)

        # made at the call: a type in text needs a session to be read
        return lambda *columns: F.udf(safe, kind, useArrow=True)(*columns)

    return wrap


@udf(GEOMETRY)
def intersection(a, b):
    return polygon_struct(k.intersection(parts_of(a), parts_of(b)))


@udf(GEOMETRY)
def difference(a, others):
    return polygon_struct(k.difference(parts_of(a), [parts_of(b) for b in others]))


@udf(GEOMETRY)
def symmetric_difference(a, b):
    return polygon_struct(k.symmetric_difference(parts_of(a), parts_of(b)))


@udf(GEOMETRY)
def union(geometries):
    return polygon_struct(k.union([parts_of(g) for g in geometries if g is not None]))


@udf(GEOMETRY)
def _make_valid(g):
    return polygon_struct(k.make_valid(parts_of(g))) if g["type"].endswith("Polygon") else g


def make_valid(g):
    """Even-odd interpretation of any rings; rectangles are valid as they are."""
    return F.when(is_box(g), g).otherwise(_make_valid(F.when(~is_box(g), g)))


def buffer(g, distance, resolution: int = 30, join_style: str = "round"):
    """Round or mitre buffer; a negative distance shrinks. Rectangles shrink to rectangles, and grow to them with mitred corners."""
    if isinstance(distance, (int, float)) and (distance < 0 or distance > 0 and join_style == "mitre"):
        d = float(distance)

        def grown(b):
            x0, y0, x1, y1 = b["xmin"] - d, b["ymin"] - d, b["xmax"] + d, b["ymax"] + d
            return F.when((x0 < x1) & (y0 < y1), box(x0, y0, x1, y1)).otherwise(geometry("MultiPolygon", F.array()))

        return F.when(is_box(g), bound(bounds(g), grown)).otherwise(_buffer(F.when(~is_box(g), g), distance, resolution, join_style))
    return _buffer(g, distance, resolution, join_style)


def _buffer(g, distance, resolution: int, join_style: str):
    distance = F.lit(float(distance)) if isinstance(distance, (int, float)) else distance
    return udf(GEOMETRY)(lambda x, d: polygon_struct(k.buffer(x["type"], parts_of(x), d, resolution, join_style)))(g, distance)


def predicate(name: str, a, b, distance: float = 0.0):
    """The spatial predicate as a boolean column."""
    return udf("boolean")(lambda x, y: k.predicate(name, (x["type"], parts_of(x)), (y["type"], parts_of(y)), distance))(a, b)


@udf("double")
def separation(a, b):
    return k.separation((a["type"], parts_of(a)), (b["type"], parts_of(b)))


def simplify(g, tolerance: float):
    """Douglas-Peucker of all rings; a polygon that would collapse keeps its shape."""

    def run(x):
        parts = parts_of(x)
        thin = [[k.simplify(r, tolerance) for r in p] for p in parts]
        if x["type"].endswith("Polygon"):
            thin = [[r if len(t) < 4 else t for r, t in zip(p, q)] for p, q in zip(parts, thin)]
            return polygon_struct(k.make_valid(thin))
        return struct(x["type"], thin)

    return udf(GEOMETRY)(run)(g)


@udf("double")
def shared_border(a, b):
    """Length of the edges that two polygons share."""
    x, y = k.edges_of(parts_of(a)), k.edges_of(parts_of(b))
    if not len(x) or not len(y):
        return 0.0
    e, own = k.noded([x, y], k.GRID)
    both = e[own.all(axis=1)] * k.GRID
    return float(sum(math.hypot(q[2] - q[0], q[3] - q[1]) for q in both))


@udf(f"array<{GEOMETRY}>")
def split_by_lines(polygon, lines):
    """The pieces into which lines cut a polygon."""
    own = k.edges_of(parts_of(polygon))
    cuts = [k._segments(x["type"], parts_of(x)) for x in lines]
    cuts = [c for c in cuts if len(c)]
    if not cuts or not len(own):
        return [polygon]
    import numpy as np

    # a line drawn there and back is even, so each one is an input of its own
    e, owners = k.noded([own, *cuts], k.GRID)
    left, right = k.beside(e, owners)
    a, b = left[:, 0], right[:, 0]
    ways = [tuple(x) for x in e[a].tolist()] + [(*x[2:], *x[:2]) for x in e[b].tolist()]
    faces = k.rings_to_polygon(k.walk(ways), k.GRID)
    return [polygon_struct([p]) for p in faces if np.isfinite(k.area([p]))]


def line_of(g) -> list[tuple[float, float]]:
    return [v for part in parts_of(g) for ring in part for v in ring]


def cut(vertices: list[tuple[float, float]], measures: list[float]) -> list[list[tuple[float, float]]]:
    """A line cut at distances from its start."""
    out, now, at = [], [vertices[0]], 0.0
    left = sorted(m for m in measures if m > 0)
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:]):
        size = math.hypot(bx - ax, by - ay)
        while left and left[0] < at + size:
            t = (left.pop(0) - at) / size
            p = (ax + t * (bx - ax), ay + t * (by - ay))
            if p != now[-1]:
                now.append(p)
            if len(now) > 1:
                out.append(now)
            now = [p]
        at += size
        if (bx, by) != now[-1]:
            now.append((bx, by))
    if len(now) > 1:
        out.append(now)
    return out or [vertices]


@udf(f"array<{GEOMETRY}>")
def cut_at(line, measures):
    """The pieces of a line cut at distances from its start; those outside its length cut nothing."""
    return [lines_struct([piece]) for piece in cut(line_of(line), list(measures))]


@udf("double")
def project(line, v):
    """How far along a line the place closest to a vertex is."""
    best, at = (math.inf, 0.0), 0.0
    vertices = line_of(line)
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:]):
        dx, dy = bx - ax, by - ay
        size = math.hypot(dx, dy)
        t = 0.0 if not size else min(1.0, max(0.0, ((v["x"] - ax) * dx + (v["y"] - ay) * dy) / size**2))
        best = min(best, (math.hypot(v["x"] - ax - t * dx, v["y"] - ay - t * dy), at + t * size))
        at += size
    return best[1]


@udf("array<double>")
def crossing_measures(line, others):
    """Distances along a line at which other lines meet it."""
    vertices, out, at = line_of(line), set(), 0.0
    segs = [s for o in others for s in k._segments(o["type"], parts_of(o)).tolist()]
    for (ax, ay), (bx, by) in zip(vertices, vertices[1:]):
        dx, dy = bx - ax, by - ay
        size = math.hypot(dx, dy)
        for x0, y0, x1, y1 in segs:
            sx, sy = x1 - x0, y1 - y0
            cross = dx * sy - dy * sx
            if cross:
                t, u = ((x0 - ax) * sy - (y0 - ay) * sx) / cross, ((x0 - ax) * dy - (y0 - ay) * dx) / cross
                if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                    out.add(round(at + t * size, 9))
            elif size and abs((x0 - ax) * dy - (y0 - ay) * dx) <= 1e-9 * size:
                for px, py in ((x0, y0), (x1, y1)):
                    t = ((px - ax) * dx + (py - ay) * dy) / size**2
                    if 0 < t < 1:
                        out.add(round(at + t * size, 9))
        at += size
    return sorted(x for x in out if 1e-9 < x < at - 1e-9)


def from_wkt_text(text: str) -> dict | None:
    """WKT or EWKT (an SRID is left out; Z and M are dropped)."""
    text = text.split(";", 1)[-1].strip()
    head, _, body = text.partition("(")
    kind = head.split()[0].upper() if head.split() else ""
    names = {n.upper(): n for n in ("Point", "LineString", "LinearRing", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}
    if kind not in names:
        return None
    if not body:
        return struct(names[kind], [])
    depth, tree, stack, token = 0, None, [], ""
    for c in "(" + body:
        if c == "(":
            stack.append([])
            token = ""
        elif c in ",)":
            if token.strip():
                stack[-1].append(tuple(float(x) for x in token.split()[:2]))
            token = ""
            if c == ")":
                done = stack.pop()
                if stack:
                    stack[-1].append(done)
                else:
                    tree = done
        else:
            token += c
    shape = {"POINT": lambda t: [[t]], "LINESTRING": lambda t: [[t]], "LINEARRING": lambda t: [[t]], "POLYGON": lambda t: [t], "MULTIPOINT": lambda t: [[[p[0]] if isinstance(p, list) else [p]] for p in t], "MULTILINESTRING": lambda t: [[p] for p in t], "MULTIPOLYGON": lambda t: t}
    return struct(names[kind], shape[kind](tree))


from_wkt = udf(GEOMETRY)(from_wkt_text)


@udf(GEOMETRY)
def from_geojson(text):
    """A GeoJSON geometry or feature."""
    import json

    o = json.loads(text)
    o = o.get("geometry") or o
    kind, c = o["type"], o["coordinates"]
    two = lambda v: (v[0], v[1])
    shape = {"Point": lambda: [[[two(c)]]], "LineString": lambda: [[[two(v) for v in c]]], "Polygon": lambda: [[[two(v) for v in r] for r in c]], "MultiPoint": lambda: [[[two(v)]] for v in c], "MultiLineString": lambda: [[[two(v) for v in r]] for r in c], "MultiPolygon": lambda: [[[two(v) for v in r] for r in p] for p in c]}
    return struct(kind, shape[kind]())


@udf("string")
def to_geojson(g):
    import json

    p, kind = [[[list(v) for v in r] for r in part] for part in parts_of(g)], g["type"]
    shape = {"Point": lambda: p[0][0][0], "LineString": lambda: p[0][0], "LinearRing": lambda: p[0][0], "Polygon": lambda: p[0], "MultiPoint": lambda: [x[0][0] for x in p], "MultiLineString": lambda: [x[0] for x in p], "MultiPolygon": lambda: p}
    return json.dumps({"type": "LineString" if kind == "LinearRing" else kind, "coordinates": shape[kind]() if p else []})


@udf(GEOMETRY)
def from_wkb(data):
    """Well-known binary, either byte order, points to multi-polygons."""
    import struct as s

    def read(at):
        order = "<" if data[at] == 1 else ">"
        code = s.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if code & 0x20000000:
            at += 4
        width = 2 + bool(code & 0x80000000 or 1000 <= code % 0x10000000 < 2000) + bool(code & 0x40000000)
        code = code % 1000 if code < 0x10000000 else code & 0xFF

        def vertices(at, n):
            flat = s.unpack_from(f"{order}{n * width}d", data, at)
            return [flat[i * width : i * width + 2] for i in range(n)], at + 8 * n * width

        def count(at):
            return s.unpack_from(order + "I", data, at)[0], at + 4

        if code == 1:
            v, at = vertices(at, 1)
            return [[v]], at
        n, at = count(at)
        if code == 2:
            v, at = vertices(at, n)
            return [[v]], at
        if code == 3:
            rings = []
            for _ in range(n):
                m, at = count(at)
                v, at = vertices(at, m)
                rings.append(v)
            return [rings], at
        parts = []
        for _ in range(n):
            p, at = read(at)
            parts += p
        return parts, at

    code = s.unpack_from("<I" if data[0] == 1 else ">I", data, 1)[0]
    code = code % 1000 if code < 0x10000000 else code & 0xFF
    return struct({1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}[code], read(0)[0])


@udf("binary")
def to_wkb(g):
    import struct as s

    kind, parts = g["type"], parts_of(g)
    code = {"Point": 1, "LineString": 2, "LinearRing": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}[kind]
    flat = lambda r: b"".join(s.pack("<dd", *v) for v in r)

    def one(code, part):
        head = b"\x01" + s.pack("<I", code)
        if code == 1:
            return head + flat(part[0])
        if code == 2:
            return head + s.pack("<I", len(part[0])) + flat(part[0])
        return head + s.pack("<I", len(part)) + b"".join(s.pack("<I", len(r)) + flat(r) for r in part)

    if code < 4:
        return one(code, parts[0]) if parts else b"\x01" + s.pack("<II", code, 0)
    return b"\x01" + s.pack("<II", code, len(parts)) + b"".join(one(code - 3, p) for p in parts)


def jenks(values: list[float], counts: list[float], k_classes: int) -> list[float]:
    """Upper bounds of the k classes of least squared deviation over sorted distinct values (Fisher's exact method).

    The first of the best cuts never moves left as values are added, so a class
    takes m log m steps: the middle value's cut bounds those on either side.
    """
    import numpy as np

    v, n = np.asarray(values, float), np.asarray(counts, np.longdouble)
    m = len(v)
    k_classes = min(k_classes, m)
    # sums about the median in extended precision, as far values would swamp the rest
    x = v.astype(np.longdouble) - v[m // 2] if m else v.astype(np.longdouble)
    w, s, q = (np.r_[np.longdouble(0), np.cumsum(y)] for y in (n, n * x, n * x * x))
    best, cuts = np.full(m + 1, np.inf, np.longdouble), []
    best[0] = 0
    for c in range(1, k_classes + 1):
        now, cut_at_ = np.full(m + 1, np.inf, np.longdouble), np.zeros(m + 1, np.int64)
        first, last, low, high = (np.array([y]) for y in (c, m, c - 1, m - 1))
        while first.size:
            j = (first + last) // 2
            size = np.minimum(high, j - 1) - low + 1
            start = np.cumsum(size) - size
            i = np.arange(size.sum()) + np.repeat(low - start, size)
            e = np.repeat(j, size)
            cost = best[i] + (q[e] - q[i]) - (s[e] - s[i]) ** 2 / (w[e] - w[i])
            now[j] = np.minimum.reduceat(cost, start)
            cut_at_[j] = at = np.minimum.reduceat(np.where(cost == now[e], i, m), start)
            first, last, low, high = np.r_[first, j + 1], np.r_[j - 1, last], np.r_[low, at], np.r_[at, high]
            some = first <= last
            first, last, low, high = first[some], last[some], low[some], high[some]
        best = now
        cuts.append(cut_at_)
    out, j = [], m
    for cut_at_ in reversed(cuts):
        out.append(float(v[j - 1]))
        j = cut_at_[j]
    return out[::-1]


def tour(points: list[tuple[float, float]], closed: bool = True) -> list[int]:
    """A short tour through distinct points: nearest neighbours, then exchanges of pairs of links and moves of points until none helps."""
    n = len(points)
    if n <= 2:
        return list(range(n))
    d = [[math.hypot(a[0] - b[0], a[1] - b[1]) for b in points] for a in points]
    if not closed:
        # a place at distance 0 from all closes the tour without a cost
        d = [[*row, 0.0] for row in d] + [[0.0] * (n + 1)]
    m = len(d)
    size = lambda t: sum(d[t[i - 1]][t[i]] for i in range(m))
    best = None
    for start in range(min(m, 12)):
        path, left = [start], set(range(m)) - {start}
        while left:
            path.append(min(left, key=lambda x: (d[path[-1]][x], x)))
            left.remove(path[-1])
        better = True
        while better:
            better = False
            for i in range(m - 1):
                for j in range(i + 2, m - (i == 0)):
                    a, b, c, e = path[i], path[i + 1], path[j], path[(j + 1) % m]
                    if d[a][c] + d[b][e] < d[a][b] + d[c][e] - 1e-9:
                        path[i + 1 : j + 1] = reversed(path[i + 1 : j + 1])
                        better = True
            for i in range(m):
                a, x, b = path[i - 1], path[i], path[(i + 1) % m]
                gain = d[a][x] + d[x][b] - d[a][b]
                rest = path[:i] + path[i + 1 :]
                j = min(range(m - 1), key=lambda j: d[rest[j - 1]][x] + d[x][rest[j]] - d[rest[j - 1]][rest[j]])
                if d[rest[j - 1]][x] + d[x][rest[j]] - d[rest[j - 1]][rest[j]] < gain - 1e-9:
                    path = rest[:j] + [x] + rest[j:]
                    better = True
        if best is None or size(path) < size(best) - 1e-9:
            best = path
    if not closed:
        at = best.index(n)
        return best[at + 1 :] + best[:at]
    at = best.index(0)
    return best[at:] + best[:at]
