"""Geometry derived from the driver's tables by whole-number arithmetic, as DataFrames and as DuckDB expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.session import table

#: Nodes of the road network.
NODES = 50


def px(k: Column, a: int | Column = 0) -> Column:
    return (k.cast("long") * 7919 + a) % 10007


def py(k: Column, b: int | Column = 0) -> Column:
    return (k.cast("long") * 104729 + b) % 10007


def sx(k: str, a: int | str = 0) -> str:
    return f"((cast({k} as bigint) * 7919 + {a}) % 10007)"


def sy(k: str, b: int | str = 0) -> str:
    return f"((cast({k} as bigint) * 104729 + {b}) % 10007)"


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """id, x, y, nation, acctbal."""
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), px(F.col("c_custkey")).alias("x"), py(F.col("c_custkey")).alias("y"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"))


CUSTOMERS = f"(select c_custkey as id, {sx('c_custkey')} as x, {sy('c_custkey')} as y, c_nationkey as nation, c_acctbal as acctbal from customer)"


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """sid, rx, ry."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("sid"), px(F.col("s_suppkey"), 11).alias("rx"), py(F.col("s_suppkey"), 13).alias("ry"))


SUPPLIERS = f"(select s_suppkey as sid, {sx('s_suppkey', 11)} as rx, {sy('s_suppkey', 13)} as ry from supplier)"


def boxes(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """pid, brand, size, x0, y0, x1, y1 and geometry: a box for each part, about the customer of the same number or, for odd parts, 500 units off."""
    p = table(spark, sf, "part")
    x0, y0 = px(F.col("p_partkey"), 10002 + shift), py(F.col("p_partkey"), F.lit(10000 + shift) + 500 * (F.col("p_partkey") % 2))
    b = p.select(F.col("p_partkey").alias("pid"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"), x0.alias("x0"), y0.alias("y0"), (x0 + 10 + (F.col("p_size").cast("long") * 37) % 120).alias("x1"), (y0 + 10 + (F.col("p_partkey") * 31) % 120).alias("y1"))
    return b.withColumn("geometry", g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def boxes_sql(shift: int = 0) -> str:
    x, y = sx("p_partkey", 10002 + shift), sy("p_partkey", f"{10000 + shift} + 500 * (p_partkey % 2)")
    return f"(select p_partkey as pid, p_brand as brand, cast(p_size as bigint) as size, {x} as x0, {y} as y0, {x} + 10 + (cast(p_size as bigint) * 37) % 120 as x1, {y} + 10 + (p_partkey * 31) % 120 as y1 from part)"


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """oid and geometry: a line of three vertices for each order."""
    o = table(spark, sf, "orders")
    at = lambda k: g.vertex(px(k), py(k))
    return o.select(F.col("o_orderkey").alias("oid"), g.line(F.array(at(F.col("o_custkey")), at(F.col("o_orderkey")), at(F.col("o_orderkey") + 1))).alias("geometry"))


ORDER_LINES = f"(select o_orderkey as oid, {sx('o_custkey')} as ax, {sy('o_custkey')} as ay, {sx('o_orderkey')} as bx, {sy('o_orderkey')} as by_, {sx('(o_orderkey + 1)')} as cx, {sy('(o_orderkey + 1)')} as cy from orders)"


def network(spark: SparkSession, sf: str, nodes: int = NODES) -> DataFrame:
    """edge_id, source, target, oneway (B, FT, TF), drivetime_fw, drivetime_bw."""
    e = table(spark, sf, "lineitem")
    way = F.when(F.col("l_returnflag") == "A", "B").when(F.col("l_returnflag") == "N", "FT").otherwise("TF")
    return e.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_id"), (F.col("l_suppkey") % nodes).alias("source"), (F.col("l_partkey") % nodes).alias("target"), way.alias("oneway"), F.col("l_quantity").cast("double").alias("drivetime_fw"), (F.col("l_quantity") + 1).cast("double").alias("drivetime_bw"))


NETWORK = f"""(select l_orderkey * 8 + l_linenumber as edge_id, l_suppkey % {NODES} as source, l_partkey % {NODES} as target,
  case l_returnflag when 'A' then 'B' when 'N' then 'FT' else 'TF' end as oneway,
  cast(l_quantity as double) as drivetime_fw, cast(l_quantity + 1 as double) as drivetime_bw from lineitem)"""

DIRECTED = f"""(select edge_id, source, target, drivetime_fw as minutes from {NETWORK} where oneway in ('B', 'FT')
  union all select edge_id, target, source, drivetime_bw from {NETWORK} where oneway in ('B', 'TF'))"""


def sparse_edges(spark: SparkSession, sf: str) -> DataFrame:
    """source, target, length: chains of orders that follow each other, cut after each eighth customer."""
    o = table(spark, sf, "orders")
    to = F.when(F.col("o_custkey") % 8 == 0, F.col("o_orderkey") * 2 + 1).otherwise(F.col("o_orderkey") * 2 + 2)
    return o.select((F.col("o_orderkey") * 2).alias("source"), to.alias("target"), F.lit(1.0).alias("length"))


SPARSE_EDGES = "(select o_orderkey * 2 as source, case when o_custkey % 8 = 0 then o_orderkey * 2 + 1 else o_orderkey * 2 + 2 end as target from orders)"


def short_segments(spark: SparkSession, sf: str) -> DataFrame:
    """oid, ax, ay, bx, by: a segment of up to some 130 units for each order."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.alias("oid"), px(k).alias("ax"), py(k).alias("ay"), (k % 89 - 30).alias("dx"), (F.col("o_custkey") % 97 + 5).alias("dy"))
    return o.select("oid", "ax", "ay", (F.col("ax") + F.col("dx")).alias("bx"), (F.col("ay") + F.col("dy")).alias("by"))


SHORT_SEGMENTS = f"(select o_orderkey as oid, {sx('o_orderkey')} as ax, {sy('o_orderkey')} as ay, {sx('o_orderkey')} + o_orderkey % 89 - 30 as bx, {sy('o_orderkey')} + o_custkey % 97 + 5 as by_ from orders)"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """image_id (a day), band_id (an event type), row, col, value: the events as a raster of 100 columns."""
    e = table(spark, sf, "events")
    return e.select(F.date_format("ts", "yyyyMMdd").alias("image_id"), F.col("event_type").alias("band_id"), F.floor(F.col("event_id") / 100).cast("long").alias("row"), (F.col("event_id") % 100).alias("col"), F.round(F.col("value") * 100).cast("long").alias("value"))


PIXELS = "(select strftime(ts, '%Y%m%d') as image_id, event_type as band_id, cast(floor(event_id / 100.0) as bigint) as \"row\", event_id % 100 as col, cast(round(value * 100) as bigint) as value from events)"


def one_image(spark: SparkSession, sf: str) -> DataFrame:
    """The events as one image of one band."""
    return pixels(spark, sf).withColumn("image_id", F.lit("all")).withColumn("band_id", F.lit("b"))


def embedding_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """image_id = the vector's place (a time), row = vec_id / 20, col = vec_id % 20, value."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("t", "v"))
    return e.select(F.col("t").cast("long").alias("image_id"), F.lit("b").alias("band_id"), F.floor(F.col("vec_id") / 20).cast("long").alias("row"), (F.col("vec_id") % 20).alias("col"), F.floor(F.col("v").cast("double") * 1000).cast("long").alias("value"))


EMBEDDING_PIXELS = """(select cast(t - 1 as bigint) as image_id, cast(floor(vec_id / 20.0) as bigint) as "row", vec_id % 20 as col,
  cast(floor(cast(embedding[t] as double) * 1000) as bigint) as value
  from (select vec_id, embedding, unnest(generate_series(1, len(embedding))) as t from embeddings))"""
