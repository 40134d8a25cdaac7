"""Overlay, dissolve, clusters and repair of polygons.

Pairs come from the cell join of bounding boxes; the kernel runs on pairs, or on
a row with the list of the few geometries that its box meets. Upright rectangles
are overlaid by Column expressions and by lattices of a cell. Unions of a group
go in two steps, by cell and then by group, so that no task takes a large group
as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k
from geoengine.operators.components import connected_components
from geoengine.operators.joins import box_pairs, cells
from geoengine.session import durable


def _boxed(df: DataFrame, prefix: str, geom: str = "geometry") -> DataFrame:
    return df.withColumn("__b", g.bounds(geom)).select("*", *[F.col(f"__b.{c}").alias(f"{prefix}{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).drop("__b")


def _corners(prefix: str) -> tuple[str, str, str, str]:
    return tuple(f"{prefix}{c}" for c in ("xmin", "ymin", "xmax", "ymax"))  # type: ignore[return-value]


def cell_size(*dfs: DataFrame, geom: str = "geometry") -> float:
    """Twice the mean extent of the rows' boxes."""
    sizes = []
    for df in dfs:
        b = g.bounds(geom)
        r = df.agg(F.avg(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])).alias("s")).first()
        sizes.append(r.s or 0.0)
    return max(2 * max(sizes), 1e-3)


def upright(*dfs: DataFrame, geom: str = "geometry") -> bool:
    """Whether all shapes are upright rectangles, which Column expressions can overlay without a kernel."""
    return all(df.where(F.size(g.vertices(geom)) > 0).agg(F.bool_and(g.is_box(geom))).first()[0] is not False for df in dfs)


def _filled(df: DataFrame) -> DataFrame:
    return df.where(F.size(g.vertices("geometry")) > 0)


def _inner(low: str, high: str) -> tuple[Column, Column]:
    """Ends of what the bounds of two sides have in common along an axis."""
    return F.greatest(f"__l{low}", f"__r{low}"), F.least(f"__l{high}", f"__r{high}")


def _held(inner: str, outer: str) -> Column:
    """Whether one side's box lies in the other's, with the kernel's tolerance."""
    low = [F.col(f"{inner}{c}") >= F.col(f"{outer}{c}") - 1e-9 for c in ("xmin", "ymin")]
    return low[0] & low[1] & (F.col(f"{inner}xmax") <= F.col(f"{outer}xmax") + 1e-9) & (F.col(f"{inner}ymax") <= F.col(f"{outer}ymax") + 1e-9)


#: Predicates of two rectangles whose bounds meet.
BOX_RULES = {"intersects": lambda: F.lit(True), "within": lambda: _held("__l", "__r"), "covered_by": lambda: _held("__l", "__r"), "contains": lambda: _held("__r", "__l"), "covers": lambda: _held("__r", "__l")}


def geometry_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, predicate: str | None = "intersects", distance: float = 0.0, size: float | None = None) -> DataFrame:
    """left_key, right_key, __lg, __rg of rows whose geometries satisfy the predicate (None: whose boxes meet). Rectangles need no kernel."""
    a = _boxed(_filled(left.select(F.col(left_key).alias("__lk"), "geometry")).withColumnRenamed("geometry", "__lg"), "__l", "__lg")
    b = _boxed(_filled(right.select(F.col(right_key).alias("__rk"), "geometry")).withColumnRenamed("geometry", "__rg"), "__r", "__rg")
    if distance:
        for c, s in (("__lxmin", -1), ("__lymin", -1), ("__lxmax", 1), ("__lymax", 1)):
            a = a.withColumn(c, F.col(c) + s * float(distance))
    rule = BOX_RULES.get(predicate) if not distance and upright(left, right) else None
    pairs = box_pairs(a, b, _corners("__l"), _corners("__r"), size or cell_size(left, right) + 2 * distance, rule and rule())
    if predicate is not None and rule is None:
        pairs = pairs.where(k.predicate(predicate, F.col("__lg"), F.col("__rg"), distance))
    return pairs.select(F.col("__lk").alias(left_key), F.col("__rk").alias(right_key), "__lg", "__rg")


def intersections(left: DataFrame, right: DataFrame, size: float | None = None, condition: Column | None = None) -> DataFrame:
    """All columns of the pairs of rows whose polygons overlap, with the common part as geometry. The sides must not share other column names.

    Both sides' columns travel with the cell join, so pairs are neither stored nor joined again.
    """
    plain = upright(left, right)
    a = _boxed(_filled(left).withColumnRenamed("geometry", "__lg"), "__l", "__lg")
    b = _boxed(_filled(right).withColumnRenamed("geometry", "__rg"), "__r", "__rg")
    size = size or cell_size(left, right)
    (x0, x1), (y0, y1) = _inner("xmin", "xmax"), _inner("ymin", "ymax")
    if plain:
        some = (x0 < x1) & (y0 < y1)
        pairs = box_pairs(a.drop("__lg"), b.drop("__rg"), _corners("__l"), _corners("__r"), size, some if condition is None else some & condition)
        shaped = pairs.withColumn("geometry", g.box(x0, y0, x1, y1))
    else:
        pairs = box_pairs(a, b, _corners("__l"), _corners("__r"), size, condition)
        shaped = pairs.withColumn("geometry", k.intersection(F.col("__lg"), F.col("__rg"))).drop("__lg", "__rg")
    return shaped.drop(*_corners("__l"), *_corners("__r"))


def _single(df: DataFrame) -> DataFrame:
    """A row for each part; empty geometries go."""
    parts = F.explode(g.explode_parts("geometry"))
    return df.withColumn("geometry", parts)


def _suffixed(df: DataFrame, both: set[str], suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix if c in both else c) for c in df.columns if c != "geometry"], "geometry")


def _boxes_by_cell(df: DataFrame, size: float, **columns: Column) -> DataFrame:
    """The named columns, bounds and cells (__cx, __cy) of rectangles, a row for each cell."""
    b = _boxed(_filled(df), "__l").select(*[c.alias(n) for n, c in columns.items()], *_corners("__l"))
    return b.withColumn("__cx", F.explode(cells(F.col("__lxmin"), F.col("__lxmax"), size))).withColumn("__cy", F.explode(cells(F.col("__lymin"), F.col("__lymax"), size)))


def _by_cell(function):
    """An iterator of frames sorted by cell as frames of whole cells, each given to ``function``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in batches:
            if not len(f):
                continue
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            last = (f["__cx"] == f["__cx"].iloc[-1]) & (f["__cy"] == f["__cy"].iloc[-1])
            held = f[last]
            if not last.all():
                yield function(f[~last])
        if held is not None:
            yield function(held)

    return run


def _cells_of(f: pd.DataFrame) -> list[tuple[int, int]]:
    """First and last row (open) of each cell in a frame of whole cells."""
    cx, cy = f["__cx"].to_numpy(), f["__cy"].to_numpy()
    ends = (np.flatnonzero((cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])) + 1).tolist()
    return list(zip([0, *ends], [*ends, len(f)]))


def erase_boxes(rows: DataFrame, key: str, others: DataFrame | None, size: float, order: str | None = None) -> DataFrame:
    """Rectangles without what ``others`` cover or, without others, what rows before them (by ``order``) cover; rows that vanish go.

    A cell's rectangles are painted on the lattice of their own coordinates, so
    that what is left of a row is read off the lattice: no pairs are formed. A
    row's pieces are united over its cells.
    """
    mine = _boxes_by_cell(rows, size, __k=F.col(key), __o=F.col(order) if order else F.lit(1), __ask=F.lit(True), __mark=F.lit(others is None))
    if others is not None:
        kind = rows.schema[key].dataType
        mine = mine.unionByName(_boxes_by_cell(others, size, __k=F.lit(None).cast(kind), __o=F.lit(0), __ask=F.lit(False), __mark=F.lit(True)))
    dealt = mine.repartition("__cx", "__cy").sortWithinPartitions("__cx", "__cy", "__o").drop("__o")

    def erased(f: pd.DataFrame) -> pd.DataFrame:
        cx, cy, ask = f["__cx"].to_numpy(), f["__cy"].to_numpy(), f["__ask"].to_numpy(bool)
        b = np.rint(f[list(_corners("__l"))].to_numpy(float) / k.k.GRID).astype(np.int64)
        frame = np.rint(np.stack([cx * size, cy * size, (cx + 1) * size, (cy + 1) * size], 1) / k.k.GRID).astype(np.int64)
        b = np.hstack([np.maximum(b[:, :2], frame[:, :2]), np.minimum(b[:, 2:], frame[:, 2:])])
        mark, found = f["__mark"].to_numpy(bool), []
        for first, last in _cells_of(f):
            found += [(n + first, *rest) for n, *rest in k.k.unpainted(b[first:last], ask[first:last], mark[first:last])]
        keys = f["__k"].to_numpy()
        kept = b * k.k.GRID
        parts = [None if p is None else [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in p] for _, _, p in found]
        at = [n for n, *_ in found]
        return pd.DataFrame({"__k": keys[at], "__state": [state for _, state, _ in found], **{c: kept[at, n] for n, c in enumerate(_corners("__l"))}, "__parts": pd.Series(parts, dtype=object)})

    kind = rows.schema[key].dataType.simpleString()
    pieces = dealt.mapInPandas(_by_cell(erased), f"__k {kind}, __state int, {', '.join(f'{c} double' for c in _corners('__l'))}, __parts array<array<{g.RING}>>")
    part = F.struct(F.when(F.size("__parts") == 1, "Polygon").otherwise("MultiPolygon").alias("type"), F.col("__parts").alias("parts")).cast(g.GEOMETRY)
    piece = F.when(F.col("__state") == 1, g.box(*[F.col(c) for c in _corners("__l")])).when(F.col("__state") == 2, part)
    left = pieces.groupBy("__k").agg(F.bool_and(F.col("__state") == 1).alias("__whole"), F.collect_list(piece).alias("__p")).where(F.size("__p") > 0)
    joined = rows.join(left.hint("merge"), F.col(key) == F.col("__k"))
    many = ~F.col("__whole") & (F.size("__p") > 1)
    shape = F.when(F.col("__whole"), F.col("geometry")).when(many, k.union(F.when(many, F.col("__p")))).otherwise(F.get("__p", F.lit(0)))
    return joined.withColumn("geometry", shape).drop("__k", "__whole", "__p")


def clean_overlay(df1: DataFrame, df2: DataFrame, how: str = "intersection", lsuffix: str = "_1", rsuffix: str = "_2", size: float | None = None) -> DataFrame:
    """Set-theoretic overlay of two polygon tables; geometry comes last, parts are single.

    Names that both sides have get the suffixes, but for difference and update,
    which keep the left names. Each row needs no key: a row number within its
    checkpointed table serves as one.
    """
    if how not in ("intersection", "union", "identity", "symmetric_difference", "difference", "update"):
        raise ValueError(f"how cannot be {how}")
    a = durable(df1.where(F.size(g.vertices("geometry")) > 0).withColumn("__i", F.monotonically_increasing_id()))
    b = durable(df2.where(F.size(g.vertices("geometry")) > 0).withColumn("__j", F.monotonically_increasing_id()))
    both = (set(df1.columns) & set(df2.columns)) - {"geometry"}
    plain = upright(a, b)
    pairs = None if plain or how == "intersection" else durable(geometry_pairs(a, b, "__i", "__j", None, size=size))

    def erased(rows: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        if plain:
            return erase_boxes(rows, key, b if rows is a else a, size or cell_size(a, b)).drop(key)
        hit = pairs.groupBy(F.col(key).alias("__k")).agg(F.collect_list(other).alias("__o"))
        joined = rows.join(hit, F.col(key) == F.col("__k"), "left")
        shape = F.when(F.col("__o").isNull(), F.col("geometry")).otherwise(k.difference(F.col("geometry"), F.coalesce("__o", F.array().cast(f"array<{g.GEOMETRY}>"))))
        return joined.withColumn("geometry", shape).drop("__k", "__o", key)

    def met() -> DataFrame:
        return intersections(_suffixed(a, both, lsuffix), _suffixed(b, both, rsuffix), size).drop("__i", "__j")

    left = None if how == "intersection" else erased(a, "__i", "__lg", "__rg")
    out = None
    if how == "difference":
        out = left
    elif how == "update":
        out = left.unionByName(b.drop("__j"), allowMissingColumns=True)
    elif how == "intersection":
        out = met()
    else:
        out = _suffixed(left, both, lsuffix)
        if how in ("union", "symmetric_difference"):
            out = out.unionByName(_suffixed(erased(b, "__j", "__rg", "__lg"), both, rsuffix), allowMissingColumns=True)
        if how in ("union", "identity"):
            out = out.unionByName(met(), allowMissingColumns=True)
    out = _single(out)
    return out.select(*[c for c in out.columns if c != "geometry"], "geometry")


def _united(shapes: Column) -> Column:
    """The union of an array of polygons; one rectangle is its own."""
    one = (F.size(shapes) == 1) & g.is_box(F.get(shapes, F.lit(0)))
    return F.when(one, F.get(shapes, F.lit(0))).otherwise(k.union(F.when(~one, shapes)))


def union_by(df: DataFrame, by: list[str], size: float | None = None) -> DataFrame:
    """by..., geometry: the union of each group's polygons, first by cell, then whole."""
    size = size or 16 * cell_size(df)
    b = g.bounds("geometry")
    partial = df.groupBy(*by, F.floor(b["xmin"] / size).alias("__cx"), F.floor(b["ymin"] / size).alias("__cy")).agg(F.collect_list("geometry").alias("__p"))
    partial = partial.select(*by, _united(F.col("__p")).alias("geometry"))
    whole = partial.groupBy(*by).agg(F.collect_list("geometry").alias("__p"))
    many = F.size("__p") > 1
    return whole.select(*by, F.when(many, k.union(F.when(many, F.col("__p")))).otherwise(F.get("__p", F.lit(0))).alias("geometry"))


def diss(df: DataFrame, by: list[str] | str | None = None, aggfunc: dict[str, Column] | str = "first", order: str | None = None, dropna: bool = True) -> DataFrame:
    """Group and unite. ``aggfunc``: first (the first value that is not null, by ``order``), a name of a Spark aggregate, or column to expression.

    A group of one row keeps its raw values whatever the aggregate, where the types allow.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    rows = df if by else df.withColumn("__all", F.lit(0))
    keys = by or ["__all"]
    if dropna and by:
        rows = rows.dropna(subset=by)
    others = [c for c in df.columns if c not in (*by, "geometry")]
    if aggfunc == "first":
        ordered = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.first(c, ignorenulls=True)
        aggs = {c: ordered(c) for c in others}
    elif isinstance(aggfunc, str):
        aggs = {c: F.call_function(aggfunc, F.col(c)) for c in others}
    else:
        aggs = aggfunc
    kept = {f.name: f.dataType for f in df.schema.fields}
    one = lambda c, e: F.when(F.count(F.lit(1)) == 1, F.any_value(c)).otherwise(e) if c in kept else e
    attributes = rows.groupBy(*keys).agg(*[one(c, e).alias(c) for c, e in aggs.items()], F.count("*").alias("__n"))
    shapes = union_by(rows.select(*keys, "geometry"), keys)
    on = None
    for c in keys:
        same = attributes[c].eqNullSafe(shapes[c])
        on = same if on is None else on & same
    joined = attributes.join(shapes.hint("merge"), on)
    return joined.select(*[attributes[c] for c in by], *aggs, shapes["geometry"])


def dissexp(df: DataFrame, by=None, **options) -> DataFrame:
    """Group, unite, and a row for each part."""
    return _single(diss(df, by, **options))


def buff(df: DataFrame, distance: float | Column, resolution: int = 30, join_style: str = "round") -> DataFrame:
    return df.withColumn("geometry", k.buffer(F.col("geometry"), distance, resolution, join_style))


def buffdiss(df: DataFrame, distance: float, resolution: int = 30, join_style: str = "round", **options) -> DataFrame:
    return diss(buff(df, distance, resolution, join_style), **options)


def buffdissexp(df: DataFrame, distance: float, resolution: int = 30, join_style: str = "round", **options) -> DataFrame:
    return dissexp(buff(df, distance, resolution, join_style), **options)


def _forest(rows: DataFrame, key: str, size: float) -> DataFrame:
    """u, v: links that join all rows whose bounds meet, no more in a cell than rows, and a loop for the first row of each group."""
    dealt = _boxes_by_cell(rows, size, __k=F.col(key)).repartition("__cx", "__cy").sortWithinPartitions("__cx", "__cy")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        keys, b, u, v = f["__k"].to_numpy(), f[list(_corners("__l"))].to_numpy(float), [], []
        for first, last in _cells_of(f):
            for group in k.k.met(b[first:last]):
                u.append(group + first)
                v.append(np.full(len(group), group[0] + first))
        return pd.DataFrame({"u": keys[np.concatenate(u)], "v": keys[np.concatenate(v)]})

    kind = rows.schema[key].dataType.simpleString()
    return dealt.mapInPandas(_by_cell(run), f"u {kind}, v {kind}")


def get_polygon_clusters(df: DataFrame, key: str, predicate: str | None = "intersects", cluster_col: str = "cluster") -> DataFrame:
    """``df`` with the cluster of each row: the smallest key that it is joined to, over others or directly."""
    rows = durable(df)
    if predicate is None or predicate == "intersects" and upright(rows):
        links = _forest(rows, key, cell_size(rows))
    else:
        links = geometry_pairs(rows, rows.withColumnRenamed(key, "__other"), key, "__other", predicate).select(F.col(key).alias("u"), F.col("__other").alias("v"))
    found = connected_components(links)
    return rows.join(found.select(F.col("node").alias("__n"), F.col("root").alias(cluster_col)).hint("merge"), F.col(key) == F.col("__n"), "left").drop("__n")


def diss_by_cluster(df: DataFrame, key: str, by: list[str] | None = None, predicate: str | None = None, **options) -> DataFrame:
    """Dissolve within clusters; by default rows whose bounding boxes meet are one cluster."""
    clustered = get_polygon_clusters(df, key, predicate, "__cluster")
    return diss(clustered.drop(key), ["__cluster", *(by or [])], dropna=False, **options).drop("__cluster")


def dissexp_by_cluster(df: DataFrame, key: str, by: list[str] | None = None, predicate: str | None = "intersects", **options) -> DataFrame:
    return _single(diss_by_cluster(df, key, by, predicate, **options))


def buffdissexp_by_cluster(df: DataFrame, key: str, distance: float, resolution: int = 30, **options) -> DataFrame:
    return dissexp_by_cluster(buff(df, distance, resolution), key, **options)


def get_grouped_centroids(df: DataFrame, by: str, as_string: bool = True, out: str = "centroid") -> DataFrame:
    """Each row with its group's centroid, the mean of the distinct centroids of its rows."""
    rows = df.withColumn("__c", g.centroid("geometry"))
    means = rows.select(F.col(by).alias("__by"), "__c").distinct().groupBy("__by").agg(F.avg("__c.x").alias("__x"), F.avg("__c.y").alias("__y"))
    value = F.concat_ws("_", F.col("__x").cast("long"), F.col("__y").cast("long")) if as_string else g.point("__x", "__y")
    return rows.drop("__c").join(means, F.col(by).eqNullSafe(F.col("__by"))).withColumn(out, value).drop("__by", "__x", "__y")


def update_geometries(df: DataFrame, key: str, order: str | None = None, size: float | None = None) -> DataFrame:
    """Each row loses what rows before it (by ``order``) cover; rows that vanish go."""
    order = order or key
    rows = durable(df.withColumn("__o", F.col(order)))
    if upright(rows):
        return _single(erase_boxes(rows.drop("__o"), key, None, size or cell_size(rows), order).select(*df.columns))
    a = _boxed(rows.select(F.col(key).alias("__lk"), F.col("__o").alias("__lo"), F.col("geometry").alias("__lg")), "__l", "__lg")
    b = _boxed(rows.select(F.col("__o").alias("__ro"), F.col("geometry").alias("__rg")), "__r", "__rg")
    pairs = box_pairs(a, b, _corners("__l"), _corners("__r"), size or cell_size(rows), F.col("__ro") < F.col("__lo"))
    earlier = pairs.groupBy("__lk").agg(F.collect_list("__rg").alias("__e"))
    joined = rows.join(earlier, F.col(key) == F.col("__lk"), "left")
    shape = F.when(F.col("__e").isNull(), F.col("geometry")).otherwise(k.difference(F.col("geometry"), F.coalesce("__e", F.array().cast(f"array<{g.GEOMETRY}>"))))
    return _single(joined.withColumn("geometry", shape).select(*df.columns))


def get_intersections(df: DataFrame, key: str, size: float | None = None) -> DataFrame:
    """Where rows overlap others of the same table: each overlap once for each side, with that side's attributes."""
    rows = durable(df)
    other = rows.select(F.col(key).alias("__other"), "geometry")
    return _single(intersections(rows, other, size, F.col(key) != F.col("__other")).select(*df.columns))


def drop_duplicate_geometries(df: DataFrame, order: str) -> DataFrame:
    """The first row of each shape, whatever ring starts or runs which way."""
    shape = F.udf(lambda x: None if x is None else repr(sorted(sorted(frozenset(v for v in r) for r in p) and [sorted(set(r)) for r in p] for p in k.parts_of(x))), "string", useArrow=True)
    keyed = df.withColumn("__s", shape("geometry"))
    first = F.row_number().over(Window.partitionBy("__s").orderBy(order))
    return keyed.withColumn("__r", first).where("__r = 1").drop("__s", "__r")


def get_gaps(df: DataFrame, key: str, include_interiors: bool = False) -> DataFrame:
    """geometry: the holes of the coverage, the areas that rows enclose together; with interiors, also those that one row encloses."""
    rows = df.select(key, "geometry") if include_interiors else df.select(key, g.close_all_holes("geometry").alias("geometry"))
    clustered = get_polygon_clusters(rows, key, "intersects", "__cluster")
    covered = union_by(clustered, ["__cluster"])
    return covered.select(F.explode(g.get_holes("geometry")).alias("geometry"))


def _common_border() -> Column:
    """Length of the border that two rectangles (__lg, __rg) share, on the kernel's grid."""
    on = lambda v: F.rint(v / k.k.GRID)

    def shared(s: Column) -> Column:
        a, b, total = s["a"], s["b"], F.lit(0.0)
        for axis, other in (("x", "y"), ("y", "x")):
            common = F.greatest(F.lit(0.0), F.least(a[f"{other}max"], b[f"{other}max"]) - F.greatest(a[f"{other}min"], b[f"{other}min"]))
            for p in ("min", "max"):
                for q in ("min", "max"):
                    total = total + F.when(on(a[axis + p]) == on(b[axis + q]), common).otherwise(0.0)
        return total

    return g.bound(F.struct(g.bounds("__lg").alias("a"), g.bounds("__rg").alias("b")), shared)


def eliminate(df: DataFrame, small: DataFrame, key: str, how: str = "longest", max_distance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(hosts, isolated): each row of ``small`` joins the neighbour with the longest shared border, or the largest or smallest one.

    Hosts keep their attributes. Rows without a neighbour are isolated; after
    each round the remaining ones are tried against the grown hosts, until none
    finds one. Ties go to the smaller key.
    """
    hosts, left, joined_any = durable(df), durable(small), True
    while joined_any:
        pairs = geometry_pairs(left.withColumnRenamed(key, "__s"), hosts, "__s", key, "dwithin" if max_distance else "intersects", max_distance)
        if how == "longest":
            rank = _common_border() if upright(left, hosts) else k.shared_border(F.col("__lg"), F.col("__rg"))
            pairs = pairs.withColumn("__w", rank).where("__w > 0")
        else:
            pairs = pairs.withColumn("__w", g.area("__rg") * (1 if how == "largest" else -1))
        choice = F.max_by(F.struct(F.col(key), F.col("__lg")), F.struct("__w", -F.col(key)))
        chosen = durable(pairs.groupBy("__s").agg(choice.alias("c")).select("__s", F.col(f"c.{key}").alias("__host"), F.col("c.__lg").alias("__add")))
        joined_any = not chosen.isEmpty()
        if joined_any:
            grown = chosen.groupBy("__host").agg(F.collect_list("__add").alias("__adds"))
            merged = hosts.join(grown.hint("merge"), F.col(key) == F.col("__host"), "left")
            shape = F.when(F.col("__adds").isNull(), F.col("geometry")).otherwise(k.union(F.concat(F.array("geometry"), "__adds")))
            hosts = durable(merged.withColumn("geometry", shape).select(*df.columns))
            left = durable(left.join(chosen.select("__s").hint("merge"), F.col(key) == F.col("__s"), "left_anti"))
            joined_any = not left.isEmpty()
    return hosts, left


def eliminate_by_longest(df: DataFrame, small: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return eliminate(df, small, key, "longest")


def eliminate_by_largest(df: DataFrame, small: DataFrame, key: str, max_distance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    return eliminate(df, small, key, "largest", max_distance)


def eliminate_by_smallest(df: DataFrame, small: DataFrame, key: str, max_distance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    return eliminate(df, small, key, "smallest", max_distance)


def split_polygons_by_lines(polygons: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Polygons cut by all lines that meet them; a row for each piece."""
    pairs = geometry_pairs(polygons, lines.withColumn("__line", F.monotonically_increasing_id()), key, "__line", None)
    cutters = pairs.groupBy(F.col(key).alias("__k")).agg(F.collect_list("__rg").alias("__c"))
    joined = polygons.join(cutters, F.col(key) == F.col("__k"), "left")
    pieces = F.when(F.col("__c").isNull(), F.array("geometry")).otherwise(k.split_by_lines(F.col("geometry"), F.coalesce("__c", F.array().cast(f"array<{g.GEOMETRY}>"))))
    return joined.withColumn("geometry", F.explode(pieces)).select(*polygons.columns)


def split_out_slivers(df: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(thick, thin): thin rows vanish when shrunk by half the tolerance."""
    marked = durable(df.withColumn("__thin", F.size(k.buffer(F.col("geometry"), -tolerance / 2, 4)["parts"]) == 0))
    return marked.where(~F.col("__thin")).drop("__thin"), marked.where("__thin").drop("__thin")


def close_thin_holes(df: DataFrame, tolerance: float) -> DataFrame:
    """Without the holes that vanish when shrunk by half the tolerance."""

    def run(x):
        parts = k.parts_of(x)
        keep = [[p[0], *[h for h in p[1:] if k.k.buffer("Polygon", [[h]], -tolerance / 2, 4)]] for p in parts]
        return k.polygon_struct(keep)

    return df.withColumn("geometry", k.udf(g.GEOMETRY)(run)("geometry"))


def safe_simplify(df: DataFrame, tolerance: float) -> DataFrame:
    """Simplified, unless the area grows by more than a hundredth."""
    simple = df.withColumn("__s", k.simplify(F.col("geometry"), tolerance))
    grown = g.area("__s") > 1.01 * g.area("geometry")
    return simple.withColumn("geometry", F.when(grown, F.col("geometry")).otherwise(F.col("__s"))).drop("__s")


def clean_geoms(df: DataFrame) -> DataFrame:
    """Valid shapes only; null and empty ones go."""
    return df.where(F.col("geometry").isNotNull()).withColumn("geometry", k.make_valid(F.col("geometry"))).where(~g.is_empty("geometry"))


def clean_clip(df: DataFrame, mask: DataFrame, size: float | None = None) -> DataFrame:
    """Polygons cut to the mask's union."""
    one = union_by(mask.select(F.lit(0).alias("__all"), "geometry"), ["__all"]).select("geometry")
    return clean_overlay(df, one, "intersection", size=size)


def coverage_clean(df: DataFrame, key: str, tolerance: float) -> DataFrame:
    """A coverage without overlaps, slivers and gaps thinner than the tolerance.

    Overlaps go to the row of the smaller key; rows and gaps that vanish when
    shrunk by half the tolerance join the neighbour with the longest shared border.
    """
    clear = durable(update_geometries(clean_geoms(df), key).groupBy(key).agg(F.collect_list("geometry").alias("__p")).select(key, _united(F.col("__p")).alias("geometry")))
    thick, thin = split_out_slivers(clear, tolerance)
    _, gaps = split_out_slivers(get_gaps(clear, key), tolerance)
    low = clear.agg(F.min(key).alias("m")).first().m
    if low is None:
        return df
    extra = gaps.select((F.lit(low) - 1 - F.monotonically_increasing_id()).alias(key), "geometry")
    hosts, _ = eliminate_by_longest(thick, thin.unionByName(extra), key)
    return df.drop("geometry").join(hosts.hint("merge"), key)
