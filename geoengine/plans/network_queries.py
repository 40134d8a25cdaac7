"""Queries over the network operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoengine.operators import components, network
from geoengine.plans import fixtures as fx
from geoengine.plans.catalogue import query

N, D, SP = fx.NETWORK, fx.DIRECTED, fx.SPARSE_EDGES
#: Shortest costs from three origins in DuckDB.
COSTS = f"""e(s, t, w) as materialized (select source, target, min(minutes) from {D} group by 1, 2),
sp(o, n, d) using key (o, n) as (
  select o, o, 0.0::double from (values (0::bigint), (7), (23)) v(o)
  union all
  select sp.o, e.t, min(sp.d + e.w) from sp join e on e.s = sp.n
  left join recurring.sp r on r.o = sp.o and r.n = e.t
  where r.d is null or sp.d + e.w < r.d group by 1, 2)"""


def directed(spark, sf):
    return network.make_directed_network_norway(fx.network(spark, sf))


def origins(spark):
    return spark.createDataFrame([(0,), (7,), (23,)], "origin long")


def destinations(spark):
    return spark.range(fx.NODES).withColumnRenamed("id", "destination")


@query("directed_network", f"select source, target, count(*) as n, cast(sum(minutes) as double) as minutes from {D} group by 1, 2")
def directed_network(spark, sf):
    return directed(spark, sf).groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))


@query("directed_dropnegative", f"select count(*) as n from (select * from (select source, target, drivetime_fw - 25 as fw, drivetime_bw - 30 as bw, oneway from {N}) where not (fw < 0 and bw < 0)) where oneway = 'B' or oneway in ('FT', 'TF')".replace("select count(*) as n", "select cast(sum(case oneway when 'B' then 2 else 1 end) as bigint) as n"))
def directed_dropnegative(spark, sf):
    e = fx.network(spark, sf).withColumn("drivetime_fw", F.col("drivetime_fw") - 25).withColumn("drivetime_bw", F.col("drivetime_bw") - 30)
    return network.make_directed_network_norway(e, dropnegative=True).agg(F.count("*").alias("n"))


@query("percent_bidirectional", f"select cast(round(count(*) / count(distinct (least(source, target), greatest(source, target), minutes)) * 100 - 100) as bigint) as percent from {D}")
def percent_bidirectional(spark, sf):
    e = directed(spark, sf).withColumn("length", F.col("minutes"))
    r = network.percent_bidirectional(e)
    return spark.createDataFrame([(r,)], "percent long")


LINKS = f"""recursive both_ways as (select source as u, target as v from {SP} union select target, source from {SP}),
c(n, r) using key (n) as (select u, u from both_ways union all
  select e.v, min(c.r) from c join both_ways e on e.u = c.n left join recurring.c k on k.n = e.v where c.r < k.r group by 1)"""


@query("connected_components", f"with {LINKS} select n as node, r as root from c")
def connected_components(spark, sf):
    return components.connected_components(fx.sparse_edges(spark, sf), "source", "target")


@query("component_sizes", f"with {LINKS}, s as (select r, count(*) as size from c group by 1) select source, target, c.r as component_index, s.size as component_size from {SP} e join c on c.n = e.source join s on s.r = c.r")
def component_sizes(spark, sf):
    return network.get_component_size(fx.sparse_edges(spark, sf)).select("source", "target", "component_index", "component_size")


@query("largest_component", f"with {LINKS}, s as (select r, count(*) as size from c group by 1 order by 2 desc, 1 limit 1) select cast(c.r in (select r from s) as integer) as connected, count(*) as n from {SP} e join c on c.n = e.source group by 1")
def largest_component(spark, sf):
    return network.get_connected_components(fx.sparse_edges(spark, sf)).groupBy("connected").agg(F.count("*").alias("n"))


@query("od_costs", f"with recursive {COSTS} select v.o as origin, g.d as destination, sp.d as cost from (values (0::bigint), (7), (23)) v(o) cross join (select unnest(generate_series(0, {fx.NODES - 1})) as d) g left join sp on sp.o = v.o and sp.n = g.d")
def od_costs(spark, sf):
    return network.od_cost_matrix(directed(spark, sf), origins(spark), destinations(spark), "minutes")


@query("od_costs_by_joins", f"with recursive {COSTS} select o as origin, n as node, d as cost from sp")
def od_costs_by_joins(spark, sf):
    """The same costs by the way that large graphs take."""
    return network.spread(directed(spark, sf), origins(spark), "minutes")


@query("od_cutoff", f"with recursive {COSTS} select o as origin, n as destination, d as cost from sp where d <= 2")
def od_cutoff(spark, sf):
    return network.od_cost_matrix(directed(spark, sf), origins(spark), destinations(spark), "minutes", cutoff=2)


@query("od_destination_count", f"""with recursive {COSTS} select o as origin, n as destination, d as cost from (
select *, rank() over (partition by o order by d) + (count(*) over (partition by o, d) - 1) / 2.0 as r from sp) where r <= 5""")
def od_destination_count(spark, sf):
    return network.od_cost_matrix(directed(spark, sf), origins(spark), destinations(spark), "minutes", destination_count=5)


@query("service_area_edges", f"""with recursive {COSTS} select v.o as origin, cast(b.b as double) as break, count(x.n) as n from (values (0::bigint), (7), (23)) v(o) cross join (values (1), (2)) b(b)
left join (select a.o, a.d as ad, c.d as cd, 1 as n from {D} e join sp a on a.n = e.source join sp c on c.n = e.target and c.o = a.o) x on x.o = v.o and x.ad <= b.b and x.cd <= b.b group by 1, 2""")
def service_area_edges(spark, sf):
    d = directed(spark, sf)
    out = network.service_area(d, origins(spark), [1, 2], "minutes")
    return out.groupBy("origin", "break").agg(F.count("edge_id").alias("n"))


@query("precise_service_area", f"""with recursive {COSTS} select o as origin, round(sum(share), 6) as share from (
select o, edge_id, max(least(1.0, (2 - d) / minutes)) as share from {D} e join sp on sp.n = e.source where d <= 2 group by 1, 2) where share > 0 group by 1""")
def precise_service_area(spark, sf):
    out = network.precise_service_area(directed(spark, sf), origins(spark), [2], "minutes")
    return out.groupBy("origin").agg(F.round(F.sum("share"), 6).alias("share"))


@query("route_costs", f"with recursive {COSTS} select o as origin, n as destination, d as cost from sp where o <> n")
def route_costs(spark, sf):
    """The summed weights of each route's edges: routes may tie, their costs not."""
    ways = directed(spark, sf).groupBy("source", "target").agg(F.min("minutes").alias("minutes")).withColumn("edge_id", F.col("source") * 1000 + F.col("target"))
    pairs = origins(spark).crossJoin(destinations(spark))
    routes = network.get_route(ways, pairs, "minutes")
    return routes.join(ways.select("edge_id", "minutes"), "edge_id").groupBy("origin", "destination").agg(F.sum("minutes").alias("cost"))


@query("k_routes")
def k_routes(spark, sf):
    pairs = origins(spark).crossJoin(destinations(spark))
    routes = network.get_k_routes(directed(spark, sf), pairs, 3, 50, weight="minutes")
    return routes.groupBy("origin", "destination", "k").agg(F.count("*").alias("n_edges"))


@query("route_frequencies")
def route_frequencies(spark, sf):
    pairs = origins(spark).crossJoin(destinations(spark))
    return network.get_route_frequencies(directed(spark, sf), pairs, "minutes")


@query("node_ids", f"""with l as (select least(l_suppkey, 400) % 97 as ax, l_partkey % 89 as ay, l_partkey % 97 as bx, l_suppkey % 89 as by_, l_linenumber as length from lineitem),
ends as (select ax as x, ay as y, (bx, by_, length) as o from l union all select bx, by_, (ax, ay, length) from l)
select cast(row_number() over (order by x, y) - 1 as varchar) as node_id, x, y, n from (select x, y, count(distinct o) as n from ends group by 1, 2)""")
def node_ids(spark, sf):
    from geoengine.session import table

    e = table(spark, sf, "lineitem")
    rows = e.select((F.least("l_suppkey", F.lit(400)) % 97).alias("ax"), (F.col("l_partkey") % 89).alias("ay"), (F.col("l_partkey") % 97).alias("bx"), (F.col("l_suppkey") % 89).alias("by"), F.col("l_linenumber").alias("length"))
    return network.make_node_ids(rows)[1].select("node_id", "x", "y", "n")


@query("holes_to_dead_ends", f"""with p as (select id, x, y from {fx.CUSTOMERS}),
d as (select a.id as source, b.id as target, cast((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as double) as d2 from p a join p b on a.id <> b.id),
r as (select *, row_number() over (partition by source order by d2, target) as n from d)
select source, target, round(sqrt(d2), 6) as distance from r where n = 1 and d2 < 250000""")
def holes_to_dead_ends(spark, sf):
    nodes = fx.customers(spark, sf).select(F.col("id").alias("node_id"), "x", "y", F.lit(1).alias("n"))
    out = network.close_network_holes_to_deadends(nodes, 500)
    return out.select("source", "target", F.round("distance", 6).alias("distance"))


@query("connected_points", f"""with d as (select id, sid, sqrt(cast((x - rx) * (x - rx) + (y - ry) * (y - ry) as double)) as d from {fx.CUSTOMERS}, {fx.SUPPLIERS}),
r as (select *, row_number() over (partition by id order by d, sid) as n, min(d) over (partition by id) as m from d)
select id, cast(sid as varchar) as node_id, round(d * 2, 5) as weight from r where n <= 50 and d <= 250 and d <= m * 1.1 + 10""")
def connected_points(spark, sf):
    rules = network.NetworkAnalysisRules(True, "minutes", 250, 10, nodedist_multiplier=2)
    nodes = fx.suppliers(spark, sf).select(F.col("sid").alias("node_id"), F.col("rx").alias("x"), F.col("ry").alias("y"))
    out = network.connect_points(fx.customers(spark, sf), nodes, rules, "id")
    return out.select("id", F.col("node_id").cast("string").alias("node_id"), F.round("weight", 5).alias("weight"))


@query("salesman_tours")
def salesman_tours(spark, sf):
    return network.traveling_salesman_problem(fx.customers(spark, sf), group="nation")


@query("od_log", f"with recursive {COSTS} select count(*) as n, 100.0 * count(*) filter (where d is null) / count(*) as percent_missing, avg(d) as cost_mean, quantile_cont(d, 0.5) as cost_median from sp".replace("100.0 * count(*) filter (where d is null) / count(*)", "cast(0 as double)"))
def od_log(spark, sf):
    out = network.runlog(network.spread(directed(spark, sf), origins(spark), "minutes"))
    return out.select("n", "percent_missing", "cost_mean", "cost_median")
