"""Road networks: nodes, direction, components, travel costs, routes and service areas.

Costs of a graph whose size is within a checked bound come from a shortest-path
kernel over a broadcast graph, with the origins dealt to the tasks. Beyond the
bound, costs spread over the edges by joins, a table of (origin, node, cost) that
grows by one edge a round until nothing improves; routes then are walked back
over the last edges of the ways found. Of parallel edges only the cheapest count,
as many as there are routes asked for: a way takes one of them at most.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k
from geoengine.operators.components import connected_components
from geoengine.operators.joins import k_nearest
from geoengine.session import durable

#: Graphs of at most so many edges are sent to all tasks.
BROADCAST_EDGES = 2_000_000
#: Tables of at most so many costs are sent to all tasks.
BROADCAST_COSTS = 100_000


@dataclass
class NetworkAnalysisRules:
    """How points meet the network and what travel costs."""

    directed: bool
    weight: str
    search_tolerance: float = 250
    search_factor: float = 0
    split_lines: bool = True
    nodedist_multiplier: float | None = None
    nodedist_kmh: float | None = None

    def __post_init__(self) -> None:
        if self.nodedist_multiplier is not None and self.nodedist_kmh is not None:
            raise ValueError("give nodedist_multiplier or nodedist_kmh, not both")
        if self.weight == "min":
            self.weight = "minutes"

    def connector(self, distance: Column) -> Column:
        """Weight of the way from a point to a node."""
        if self.nodedist_multiplier is not None:
            return distance * float(self.nodedist_multiplier)
        if self.nodedist_kmh is not None:
            return distance / (1000 / 60 * self.nodedist_kmh)
        return F.lit(0.0)

    def validate(self, edges: DataFrame) -> None:
        w = F.col(self.weight).cast("double")
        r = edges.agg(F.count_if(w.isNull() | F.isnan(w)).alias("none"), F.count_if(w < 0).alias("low")).first()
        if r.none or r.low:
            raise ValueError(f"{self.weight} is missing in {r.none} rows and negative in {r.low}")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, without one task sorting all rows: rows are dealt by range, numbered in each part, and shifted by the parts before."""
    parts = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}
    before, shifts = 0, []
    for p in sorted(sizes):
        shifts += [F.lit(p), F.lit(before)]
        before += sizes[p]
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    shift = F.create_map(*shifts)[F.col("__part")] if shifts else F.lit(0)
    return parts.withColumn(name, (place + shift).cast("long")).drop("__part")


def make_node_ids(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with source and target, nodes): distinct line ends, numbered as text in the order of x and y.

    Lines have ax, ay, bx, by and length. n is the number of distinct (other end, length) at the node.
    """
    lines = durable(lines)
    ends = lines.select(F.col("ax").alias("x"), F.col("ay").alias("y"), F.struct(F.col("bx"), F.col("by"), "length").alias("o"))
    ends = ends.unionByName(lines.select(F.col("bx").alias("x"), F.col("by").alias("y"), F.struct(F.col("ax").alias("bx"), F.col("ay").alias("by"), "length").alias("o")))
    nodes = numbered(ends.groupBy("x", "y").agg(F.countDistinct("o").alias("n")), ["x", "y"], "node_id")
    nodes = durable(nodes.withColumn("node_id", F.col("node_id").cast("string")))
    at = lambda p, name: nodes.select(F.col("x").alias(f"__{p}x"), F.col("y").alias(f"__{p}y"), F.col("node_id").alias(name))
    out = lines.join(at("a", "source"), (F.col("ax") == F.col("__ax")) & (F.col("ay") == F.col("__ay")))
    out = out.join(at("b", "target"), (F.col("bx") == F.col("__bx")) & (F.col("by") == F.col("__by")))
    return out.drop("__ax", "__ay", "__bx", "__by"), nodes


def make_directed_network(edges: DataFrame, direction_col: str, both: str, from_to: str, to_from: str, weight_fw: str, weight_bw: str, weight: str = "minutes", dropnegative: bool = False, dropna: bool = False, reverse_tofrom: bool = True) -> DataFrame:
    """Edges (source, target) as driven: two-way rows twice, against the line's direction reversed. dropnegative and dropna remove rows whose two weights are both negative or null."""
    if dropnegative:
        edges = edges.where(~((F.col(weight_fw) < 0) & (F.col(weight_bw) < 0)) | F.col(weight_fw).isNull() | F.col(weight_bw).isNull())
    if dropna:
        edges = edges.where(F.col(weight_fw).isNotNull() | F.col(weight_bw).isNotNull())
    way = F.col(direction_col)
    there = lambda rows, w: rows.withColumn(weight, F.col(w).cast("double"))

    def back(rows: DataFrame, w: str) -> DataFrame:
        out = rows.withColumns({"source": F.col("target"), "target": F.col("source"), weight: F.col(w).cast("double")})
        return out.withColumn("geometry", g.line(F.reverse(g.vertices("geometry")))) if "geometry" in rows.columns else out

    one_way_back = back if reverse_tofrom else there
    return there(edges.where(way == both), weight_fw).unionByName(back(edges.where(way == both), weight_bw)).unionByName(there(edges.where(way == from_to), weight_fw)).unionByName(one_way_back(edges.where(way == to_from), weight_bw))


def make_directed_network_norway(edges: DataFrame, dropnegative: bool = False) -> DataFrame:
    """Columns oneway (B, FT, TF), drivetime_fw and drivetime_bw; a driving time that is missing is an error."""
    bad = edges.where(F.col("drivetime_fw").isNull() | F.col("drivetime_bw").isNull())
    if not bad.isEmpty():
        raise ValueError("drivetime_fw and drivetime_bw cannot be missing")
    return make_directed_network(edges, "oneway", "B", "FT", "TF", "drivetime_fw", "drivetime_bw", dropnegative=dropnegative)


def percent_bidirectional(edges: DataFrame) -> int:
    """How many per cent of edges have one of the same ends and length the other way."""
    r = edges.agg(F.count("*").alias("n"), F.countDistinct(F.least("source", "target"), F.greatest("source", "target"), "length").alias("d")).first()
    return round(r.n / r.d * 100 - 100) if r.d else 0


def get_component_size(edges: DataFrame) -> DataFrame:
    """component_index (its smallest node) and component_size (its nodes) of each edge."""
    edges = durable(edges)
    nodes = connected_components(edges, "source", "target")
    sizes = nodes.groupBy(F.col("root").alias("__r")).agg(F.count("*").alias("component_size"))
    each = nodes.join(sizes, F.col("root") == F.col("__r")).select(F.col("node").alias("__n"), F.col("root").alias("component_index"), "component_size")
    return edges.join(each, F.col("source") == F.col("__n")).drop("__n")


def get_connected_components(edges: DataFrame) -> DataFrame:
    """connected: 1 for edges in the component with most nodes (of equals, that with the smallest node), else 0."""
    sized = durable(get_component_size(edges))
    top = sized.select("component_index", "component_size").distinct().orderBy(F.desc("component_size"), "component_index").limit(1).select(F.col("component_index").alias("__top"))
    joined = sized.join(F.broadcast(top), F.col("component_index") == F.col("__top"), "left")
    return joined.withColumn("connected", F.col("__top").isNotNull().cast("int")).drop("__top", "component_index", "component_size")


def close_network_holes_to_deadends(nodes: DataFrame, max_distance: float) -> DataFrame:
    """New edges (source, target, distance) from each dead end (n = 1) to the nearest other one closer than the distance."""
    ends = durable(nodes.where("n = 1").select(F.col("node_id").alias("source"), "x", "y"))
    other = ends.select(F.col("source").alias("target"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    found = k_nearest(ends, other, 2, "source", "target").where("source <> target")
    first = F.row_number().over(Window.partitionBy("source").orderBy("distance", "target"))
    return found.withColumn("__n", first).where((F.col("__n") == 1) & (F.col("distance") < max_distance)).select("source", "target", "distance")


def close_network_holes(nodes: DataFrame, ends: DataFrame, max_distance: float, max_angle: float, k_near: int = 50) -> DataFrame:
    """New edges from each dead end to its nearest node within the distance whose bearing differs by at most ``max_angle`` degrees from the line's.

    ``ends``: dead ends as (source, x, y, px, py), p the vertex before the end.
    """
    other = nodes.select(F.col("node_id").alias("target"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    found = k_nearest(ends, other, k_near, "source", "target").where((F.col("distance") <= max_distance) & (F.col("distance") > 0))
    joined = found.join(ends.withColumnRenamed("source", "__s"), F.col("source") == F.col("__s")).join(other.withColumnRenamed("target", "__t"), F.col("target") == F.col("__t"))
    bearing = lambda ax, ay, bx, by: F.degrees(F.atan2(F.col(bx) - F.col(ax), F.col(by) - F.col(ay)))
    turn = F.abs(bearing("px", "py", "x", "y") - bearing("x", "y", "rx", "ry"))
    ok = joined.where(F.least(turn, 360 - turn) <= max_angle)
    first = F.row_number().over(Window.partitionBy("source").orderBy("distance", "target"))
    return ok.withColumn("__n", first).where("__n = 1").select("source", "target", "distance")


def connect_points(points: DataFrame, nodes: DataFrame, rules: NetworkAnalysisRules, key: str, k_near: int = 50) -> DataFrame:
    """key, node_id, weight: the nodes that a point (key, x, y) meets the network at: up to 50 within the tolerance, and no further than the nearest one's distance times (1 + factor / 100) plus the factor."""
    other = nodes.select("node_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = k_nearest(points.select(key, "x", "y"), other, k_near, key, "node_id")
    nearest = F.min("distance").over(Window.partitionBy(key))
    limit = nearest * (1 + rules.search_factor / 100) + rules.search_factor
    kept = near.withColumn("__l", limit).where((F.col("distance") <= rules.search_tolerance) & (F.col("distance") <= F.col("__l")))
    return kept.select(key, "node_id", rules.connector(F.col("distance")).alias("weight"))


class Graph:
    """Adjacency lists of numbered edges, with a heap search."""

    def __init__(self, rows: list[tuple], directed: bool):
        self.next: dict = defaultdict(list)
        for edge, s, t, w in rows:
            self.next[s].append((t, w, edge))
            if not directed:
                self.next[t].append((s, w, edge))

    def costs(self, start, cutoff: float = math.inf, banned: set | frozenset = frozenset()) -> tuple[dict, dict]:
        """(cost of each node within the cutoff, the edge and node it is reached from); ties by the smaller edge."""
        cost, came, heap, done = {start: 0.0}, {}, [(0.0, start)], set()
        while heap:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            for t, w, edge in self.next.get(n, ()):
                c = d + w
                if edge in banned or c > cutoff:
                    continue
                if c < cost.get(t, math.inf) or (c == cost[t] and t in came and edge < came[t][0] and t not in done):
                    cost[t], came[t] = c, (edge, n)
                    heapq.heappush(heap, (c, t))
        return cost, came

    @staticmethod
    def path(came: dict, end) -> list:
        out = []
        while end in came:
            edge, end = came[end]
            out.append(edge)
        return out[::-1]


def cheapest(edges: DataFrame, weight: str, directed: bool, n: int = 1) -> DataFrame:
    """edge_id, source, target, weight: the n cheapest of the edges between the same nodes, of equals those of smaller ids. Loops and edges without a weight lead nowhere and go."""
    w = F.col(weight).cast("double")
    rows = edges.select("edge_id", "source", "target", w.alias(weight)).where(w.isNotNull() & ~F.isnan(w) & ((F.col("source") != F.col("target")) | (w < 0)))
    ends = ["source", "target"] if directed else [F.least("source", "target"), F.greatest("source", "target")]
    place = F.row_number().over(Window.partitionBy(*ends).orderBy(weight, "edge_id"))
    return rows.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def _graph(edges: DataFrame, weight: str, directed: bool):
    """A broadcast graph of (edge_id, source, target, weight), or None beyond the bound. Negative weights are an error."""
    some = edges.select("edge_id", "source", "target", F.col(weight).alias("w")).limit(BROADCAST_EDGES + 1).toPandas()
    if len(some) > BROADCAST_EDGES:
        return None
    if (some.w < 0).any():
        raise ValueError("weights cannot be negative")
    return edges.sparkSession.sparkContext.broadcast(Graph(list(some.itertuples(index=False, name=None)), directed))


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def costs(edges: DataFrame, origins: DataFrame, weight: str = "weight", directed: bool = True, cutoff: float | None = None) -> DataFrame:
    """origin, node, cost: of every node that an origin (column origin, a node) reaches."""
    edges = durable(cheapest(edges, weight, directed))
    sent = _graph(edges, weight, directed)
    limit = math.inf if cutoff is None else cutoff
    if sent is None:
        return spread(edges, origins, weight, directed, cutoff)
    kind = _kind(edges, "source")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = sent.value
        for b in batches:
            for o in b.origin:
                got, _ = graph.costs(o, limit)
                yield pd.DataFrame({"origin": [o] * len(got), "node": list(got), "cost": list(got.values())})

    return origins.select("origin").distinct().repartition("origin").mapInPandas(run, f"origin {kind}, node {kind}, cost double")


def spread(edges: DataFrame, origins: DataFrame, weight: str = "weight", directed: bool = True, cutoff: float | None = None) -> DataFrame:
    """The same by joins only: rounds of one edge each, in which only improved costs go on."""
    e = edges.select(F.col("source").alias("__s"), F.col("target").alias("__t"), F.col(weight).cast("double").alias("__w"))
    if not directed:
        e = e.unionByName(e.select(F.col("__t").alias("__s"), F.col("__s").alias("__t"), "__w"))
    e = durable(e.groupBy("__s", "__t").agg(F.min("__w").alias("__w")))
    best = durable(origins.select("origin").distinct().select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost")))
    front = best
    while not front.isEmpty():
        step = front.join(e, F.col("node") == F.col("__s")).select("origin", F.col("__t").alias("node"), (F.col("cost") + F.col("__w")).alias("cost"))
        if cutoff is not None:
            step = step.where(F.col("cost") <= cutoff)
        step = step.groupBy("origin", "node").agg(F.min("cost").alias("cost"))
        old = best.select(F.col("origin").alias("__o"), F.col("node").alias("__n"), F.col("cost").alias("__c"))
        better = step.join(old, (F.col("origin") == F.col("__o")) & (F.col("node") == F.col("__n")), "left").where(F.col("__c").isNull() | (F.col("cost") < F.col("__c")))
        front = durable(better.select("origin", "node", "cost"))
        best = durable(best.unionByName(front).groupBy("origin", "node").agg(F.min("cost").alias("cost")))
    return best


def limited(od: DataFrame, destination_count: int | None = None, cutoff: float | None = None, weight: str = "cost") -> DataFrame:
    """Rows within the cutoff (closed), and of average rank at most ``destination_count`` for their origin; both drop unreached pairs. Ties share their mean rank, so they may all go."""
    if cutoff is not None:
        od = od.where(F.col(weight) <= cutoff)
    if destination_count is not None:
        od = od.where(F.col(weight).isNotNull())
        by = Window.partitionBy("origin")
        mean_rank = F.rank().over(by.orderBy(weight)) + (F.count("*").over(Window.partitionBy("origin", weight)) - 1) / 2
        od = od.withColumn("__r", mean_rank).where(F.col("__r") <= destination_count).drop("__r")
    return od


def od_cost_matrix(edges: DataFrame, origins: DataFrame, destinations: DataFrame, weight: str = "weight", directed: bool = True, rowwise: bool = False, destination_count: int | None = None, cutoff: float | None = None) -> DataFrame:
    """origin, destination, cost; null where there is no way, 0 from a node to itself.

    ``rowwise``: origins has a column destination beside origin, and only these pairs are costed.
    """
    found = costs(edges, origins, weight, directed, cutoff)
    if rowwise:
        pairs = origins.select("origin", "destination")
    else:
        # the result itself is the product of the two tables
        pairs = origins.select("origin").distinct().crossJoin(destinations.select("destination").distinct())
    reached = found.select(F.col("origin").alias("__o"), "node", "cost")
    od = pairs.join(reached, (F.col("origin") == F.col("__o")) & (F.col("destination") == F.col("node")), "left").select("origin", "destination", "cost")
    return limited(od, destination_count, cutoff)


def get_route(edges: DataFrame, pairs: DataFrame, weight: str = "weight", directed: bool = True, k_routes: int = 1, drop_middle_percent: float = 0.0) -> DataFrame:
    """origin, destination, k, seq, edge_id: the edges of the shortest way for each pair.

    With k routes, each next way avoids the middle ``drop_middle_percent`` per
    cent of the last one's edges; at least one edge is dropped, and of ways of
    over two edges one stays at each end. Pairs without a way have no rows.
    """
    edges = durable(cheapest(edges, weight, directed, k_routes))
    sent = _graph(edges, weight, directed)
    if sent is None:
        return routes_by_joins(edges, pairs, weight, directed, k_routes, drop_middle_percent)
    node, edge = _kind(edges, "source"), _kind(edges, "edge_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = sent.value
        for b in batches:
            rows = []
            for o, ends in b.groupby("origin", sort=False).destination:
                trees = {frozenset(): graph.costs(o)}
                for d in ends:
                    banned: frozenset = frozenset()
                    for n in range(k_routes):
                        if banned not in trees:
                            trees = {frozenset(): trees[frozenset()], banned: graph.costs(o, banned=banned)}
                        path = graph.path(trees[banned][1], d)
                        if not path:
                            break
                        rows += [(o, d, n + 1, i, e) for i, e in enumerate(path)]
                        drop = max(1, round(len(path) * drop_middle_percent / 100))
                        drop = min(drop, max(1, len(path) - 2))
                        first = (len(path) - drop) // 2
                        banned |= frozenset(path[first : first + drop])
            yield pd.DataFrame(rows, columns=["origin", "destination", "k", "seq", "edge_id"])

    return pairs.select("origin", "destination").where("origin <> destination").distinct().repartition("origin").sortWithinPartitions("origin").mapInPandas(run, f"origin {node}, destination {node}, k int, seq int, edge_id {edge}")


def _trees(edges: DataFrame, starts: DataFrame, banned: DataFrame | None) -> DataFrame:
    """origin, goal, node, cost, edge, before: the last edge of the shortest way to every node from each start (origin, goal), without the edges banned for it (origin, goal, edge)."""
    best = durable(starts.select("origin", "goal", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(edges.schema["__e"].dataType).alias("edge"), F.lit(None).cast(edges.schema["__s"].dataType).alias("before")))
    key, way = ["origin", "goal", "node"], F.min(F.struct("cost", "edge", "before")).alias("w")
    front = best
    while not front.isEmpty():
        step = front.drop("edge", "before").join(edges, F.col("node") == F.col("__s"))
        step = step.select("origin", "goal", F.col("__t").alias("node"), (F.col("cost") + F.col("__w")).alias("cost"), F.col("__e").alias("edge"), F.col("__s").alias("before"))
        if banned is not None:
            step = step.join(banned, ["origin", "goal", "edge"], "left_anti")
        step = step.groupBy(*key).agg(way).select(*key, "w.*")
        better = step.join(best.select(*key, F.col("cost").alias("__c")), key, "left").where(F.col("__c").isNull() | (F.col("cost") < F.col("__c")))
        front = durable(better.select(*key, "cost", "edge", "before"))
        best = durable(best.unionByName(front).groupBy(*key).agg(way).select(*key, "w.*"))
    return best


def _walked(trees: DataFrame, ends: DataFrame) -> DataFrame:
    """origin, destination, seq, edge: the ways to ``ends`` (origin, goal, destination), walked back one edge a round."""
    at, parts = ends.select("origin", "goal", "destination", F.col("destination").alias("node"), F.lit(0).alias("back")), []
    while True:
        hit = durable(at.join(trees.select("origin", "goal", "node", "edge", "before"), ["origin", "goal", "node"]).where("edge is not null"))
        if hit.isEmpty() and parts:
            break
        parts.append(hit.select("origin", "destination", "back", "edge"))
        at = hit.select("origin", "goal", "destination", F.col("before").alias("node"), (F.col("back") + 1).alias("back"))
    every = reduce(DataFrame.unionByName, parts)
    seq = F.max("back").over(Window.partitionBy("origin", "destination")) - F.col("back")
    return every.select("origin", "destination", seq.alias("seq"), "edge")


def routes_by_joins(edges: DataFrame, pairs: DataFrame, weight: str = "weight", directed: bool = True, k_routes: int = 1, drop_middle_percent: float = 0.0) -> DataFrame:
    """What ``get_route`` gives, for graphs of any size: rounds of joins find the trees of last edges, and further rounds walk them back.

    The first ways share a search for each origin; a further way has one for each
    pair, as each avoids other edges. Of edges that cost the same the smaller id is taken.
    """
    e = edges.select(F.col("source").alias("__s"), F.col("target").alias("__t"), F.col(weight).cast("double").alias("__w"), F.col("edge_id").alias("__e"))
    if not directed:
        e = e.unionByName(e.select(F.col("__t").alias("__s"), F.col("__s").alias("__t"), "__w", "__e"))
    e = durable(e)
    if not e.where("__w < 0").isEmpty():
        raise ValueError("weights cannot be negative")
    asked = durable(pairs.select("origin", "destination").where("origin <> destination").distinct())
    # a search that serves all destinations has its origin as goal
    found = durable(_walked(_trees(e, asked.select("origin", F.col("origin").alias("goal")).distinct(), None), asked.withColumn("goal", F.col("origin"))))
    out, banned = [found.withColumn("k", F.lit(1))], None
    for n in range(1, k_routes):
        length = F.count("*").over(Window.partitionBy("origin", "destination"))
        drop = F.least(F.greatest(F.lit(1), F.bround(length * (drop_middle_percent / 100)).cast("int")), F.greatest(F.lit(1), length - 2))
        middle = found.withColumn("n", length).withColumn("drop", drop).withColumn("first", F.floor((F.col("n") - F.col("drop")) / 2)).where("seq >= first and seq < first + drop")
        more = middle.select("origin", F.col("destination").alias("goal"), "edge")
        banned = durable(more if banned is None else banned.unionByName(more))
        again = durable(found.select("origin", "destination", F.col("destination").alias("goal")).distinct())
        if again.isEmpty():
            break
        found = durable(_walked(_trees(e, again.select("origin", "goal"), banned), again))
        out.append(found.withColumn("k", F.lit(n + 1)))
    return reduce(DataFrame.unionByName, out).select("origin", "destination", "k", "seq", F.col("edge").alias("edge_id"))


def get_k_routes(edges: DataFrame, pairs: DataFrame, k_routes: int, drop_middle_percent: float, **options) -> DataFrame:
    return get_route(edges, pairs, k_routes=k_routes, drop_middle_percent=drop_middle_percent, **options)


def get_route_frequencies(edges: DataFrame, pairs: DataFrame, weight: str = "weight", directed: bool = True, weight_df: DataFrame | None = None, default_weight: float | None = None, strict: bool = False) -> DataFrame:
    """edge_id, frequency: how much each edge is used, each pair counting by its weight in ``weight_df`` (origin, destination, weight)."""
    ways = get_route(edges, pairs, weight, directed)
    if weight_df is None:
        return ways.groupBy("edge_id").agg(F.sum(F.lit(1.0)).alias("frequency"))
    w = weight_df.toDF("__o", "__d", "__w")
    joined = ways.join(w, (F.col("origin") == F.col("__o")) & (F.col("destination") == F.col("__d")), "left")
    if strict and default_weight is None and not joined.where("__w is null").isEmpty():
        raise ValueError("some pairs have no weight")
    value = F.coalesce("__w", F.lit(default_weight)) if default_weight is not None else F.col("__w")
    return joined.groupBy("edge_id").agg(F.sum(value.cast("double")).alias("frequency")).where("frequency is not null")


def _sent(found: DataFrame) -> DataFrame:
    """Costs to join edges with: the few of a small graph go to the edges, as many edges meet the same node."""
    return F.broadcast(found) if found.count() <= BROADCAST_COSTS else found


def service_area(edges: DataFrame, origins: DataFrame, breaks: list[float], weight: str = "weight", directed: bool = True) -> DataFrame:
    """origin, break, edge_id: the edges with both ends within each break; an origin that reaches none has one row without an edge."""
    found = durable(costs(edges, origins, weight, directed, max(breaks)))
    at = lambda p: _sent(found.select(F.col("origin").alias(f"__{p}o"), F.col("node").alias(f"__{p}n"), F.col("cost").alias(f"__{p}c")))
    both = edges.select("edge_id", "source", "target").join(at("s"), F.col("source") == F.col("__sn")).join(at("t"), (F.col("target") == F.col("__tn")) & (F.col("__so") == F.col("__to")))
    steps = F.explode(F.array(*[F.lit(float(x)) for x in sorted(breaks)]))
    inside = both.withColumn("break", steps).where((F.col("__sc") <= F.col("break")) & (F.col("__tc") <= F.col("break"))).select(F.col("__so").alias("origin"), "break", "edge_id")
    every = origins.select("origin").distinct().withColumn("break", steps)
    without = every.join(inside.select("origin", "break").distinct(), ["origin", "break"], "left_anti")
    return inside.unionByName(without.withColumn("edge_id", F.lit(None).cast(edges.schema["edge_id"].dataType)))


def precise_service_area(edges: DataFrame, origins: DataFrame, breaks: list[float], weight: str = "weight", directed: bool = True) -> DataFrame:
    """origin, break, edge_id, share: also the edges that the break cuts, with the share of them that is reached from their source (their target, on the way back). The origin stays."""
    found = durable(costs(edges, origins, weight, directed, max(breaks)))
    ways = edges.select("edge_id", "source", "target", F.col(weight).cast("double").alias("__w"))
    if not directed:
        ways = ways.unionByName(ways.select("edge_id", F.col("target").alias("source"), F.col("source").alias("target"), "__w"))
    steps = F.explode(F.array(*[F.lit(float(x)) for x in sorted(breaks)]))
    left = F.col("break") - F.col("cost")
    share = F.when(F.col("__w") <= left, F.lit(1.0)).otherwise(left / F.col("__w"))
    reached = ways.join(_sent(found), F.col("source") == F.col("node")).withColumn("break", steps).where(left >= 0)
    return reached.withColumn("share", share).where("share > 0").groupBy("origin", "break", "edge_id").agg(F.max("share").alias("share"))


def traveling_salesman_problem(points: DataFrame, return_to_start: bool = True, group: str | None = None) -> DataFrame:
    """The distinct points (x, y) of each group with seq, their place on a short tour that starts at the smallest point. Groups are what one task can take: a tour is a whole."""
    by = group or "__all"
    rows = (points if group else points.withColumn("__all", F.lit(0))).select(by, F.col("x").cast("double"), F.col("y").cast("double")).distinct()
    kind = _kind(rows, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"]).reset_index(drop=True)
        order = k.tour(list(zip(pdf.x, pdf.y)), return_to_start)
        out = pdf.iloc[order].reset_index(drop=True)
        out["seq"] = range(len(out))
        return out[[by, "x", "y", "seq"]]

    out = rows.groupBy(by).applyInPandas(run, f"`{by}` {kind}, x double, y double, seq long")
    return out if group else out.drop("__all")


def runlog(results: DataFrame, weight: str = "cost") -> DataFrame:
    """One row: how many results, what share has no cost, and the cost's mean, quartiles and spread."""
    p = F.percentile(weight, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return results.agg(F.count("*").alias("n"), (100 * F.avg(F.col(weight).isNull().cast("double"))).alias("percent_missing"), F.avg(weight).alias("cost_mean"), p[0].alias("cost_p25"), p[1].alias("cost_median"), p[2].alias("cost_p75"), F.stddev(weight).alias("cost_std"))
