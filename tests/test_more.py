import pytest
from pyspark.sql import functions as F

from geoengine.functions import geometry as g
from geoengine.functions import kernels as k
from geoengine.operators import images, maps, parallel, rings
from geoengine.streaming import grid_counts

DONUT = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 3 2, 3 3, 2 3, 2 2))"


def shapes(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", k.from_wkt(F.col("t")).alias("geometry"))


def test_rings_there_and_back(spark):
    df = shapes(spark, DONUT, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")
    assert rings.get_rings(df, "id").count() == 4
    back = {r.id: r.w for r in rings.to_gdf(rings.get_rings(df, "id"), "id").select("id", g.to_wkt("geometry").alias("w")).collect()}
    assert back[0] == DONUT and back[1].startswith("MULTIPOLYGON")
    moved = rings.apply_to_rings(df.where("id = 0"), "id", lambda r: F.transform(r, lambda v: g.vertex(v["x"] * 2, v["y"] * 2)))
    assert moved.select(g.area("geometry")).first()[0] == 4 * 99
    inner = rings.apply_to_rings(df.where("id = 0"), "id", lambda r: F.transform(r, lambda v: g.vertex(v["x"] * 2, v["y"] * 2)), interiors_only=True)
    assert inner.select(g.area("geometry")).first()[0] == 100 - 4


def test_spikes_go(spark):
    df = shapes(spark, "POLYGON ((0 0, 10 0, 10 5, 20 5.01, 10 5.02, 10 10, 0 10, 0 0))")
    assert rings.remove_spikes(df, 1.0).select(g.bounds("geometry")["xmax"]).first()[0] == 10


def test_angles(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0), (1, 2, 1.0, 1.0)], "ring int, i int, x double, y double")
    got = [(r.next_angle, r.angle_diff) for r in rings.get_angle_between_indexed_points(p, "ring", "i").orderBy("i").collect()]
    assert got == [(0.0, None), (90.0, 90.0), (None, None)]


def test_maps(spark):
    df = shapes(spark, DONUT, "POLYGON ((50 50, 60 50, 60 60, 50 60, 50 50))")
    mask = shapes(spark, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))").select("geometry")
    (cut,) = maps.clipmap([df], mask)
    assert cut.select(g.area("geometry")).collect() == [(1.0,)]
    (near,) = maps.samplemap([df], "id", 2.0, seed=1)
    assert near.count() == 1
    xml = spark.createDataFrame([('<Layer queryable="1"><Name>Oslo 2020</Name><BoundingBox minx="0" miny="0" maxx="5" maxy="5"/></Layer><Layer><Name>Bergen 2021</Name><BoundingBox minx="50" miny="50" maxx="55" maxy="55"/></Layer>',)], "xml string")
    tiles = maps.load_tiles(xml)
    assert sorted((r.name, r.year) for r in tiles.collect()) == [("Bergen 2021", 2021), ("Oslo 2020", 2020)]
    assert [r.name for r in maps.filter_tiles(tiles, mask, contains=["oslo"], not_contains=["2021"]).collect()] == ["Oslo 2020"]
    assert maps.add_minmax_to_bins(spark.range(1, 11), "id", [3, 5]) == [1, 3, 5, 10]
    assert sorted(maps.split_categories(df, "id")) == [0, 1]


def test_a_tiles_year_is_its_last_word(spark):
    names = ["tile 2011 2001", "tile 20137 2019", "tile 7 2012", "tile 8 2009-2010", "2013"]
    tiles = spark.createDataFrame([(n,) for n in names], "name string").withColumn("geometry", g.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))
    mask = tiles.limit(1).select("geometry")
    assert sorted(r.name for r in maps.filter_tiles(tiles, mask, years=[2010, 2011, 2012, 2013]).collect()) == ["2013", "tile 7 2012", "tile 8 2009-2010"]
    xml = spark.createDataFrame([("<Layer><Name>Oslo 1234 2020</Name></Layer><Layer><Name>Bergen</Name></Layer>",)], "xml string")
    assert [(r.name, r.year) for r in maps.load_tiles(xml).select("name", "year").collect()] == [("Oslo 1234 2020", 2020), ("Bergen", None)]


def test_images(spark):
    files = spark.createDataFrame([("a/i1/x.tif",), ("a/i1/b.tif",), ("a/i2/x.tif",)], "path string")
    meta = {r.image_name: r.file_names for r in images.metadata_from_paths(files).collect()}
    assert meta == {"i1": ["b.tif", "x.tif"], "i2": ["x.tif"]}
    table = spark.createDataFrame([("a", "20200105", "p1", ["B1", "B2"], 0.0, 0.0, 10.0, 20.0), ("b", None, "p0", ["B1"], 5.0, 5.0, 30.0, 30.0), ("c", "20190101", "p2", ["B1"], 0.0, 0.0, 1.0, 1.0)], "image_id string, date string, path string, bands array<string>, xmin double, ymin double, xmax double, ymax double")
    assert images.explode_bands(table).count() == 4 and images.get_unique_band_ids(table).count() == 2
    assert [r.image_id for r in images.select_images(table, 0, 2).orderBy("date").collect()] == ["c", "a"]
    assert images.date_parts(table).where("year = 2020 and month = 1 and day = 5").count() == 1
    assert tuple(images.image_bounds(table).first()) == (0, 0, 30, 30)
    assert tuple(images.shape_from_bounds(table, 3.0).where("image_id = 'a'").select("rows", "cols").first()) == (6, 3)
    with pytest.raises(ValueError):
        images.concat_image_collections(table.withColumn("res", F.lit(10)), table.withColumn("res", F.lit(20)))
    r = spark.createDataFrame([(0, 1, 5.0)], "row long, col long, value double")
    assert images.dense(r, 2, 2, 0.0).agg(F.sum("value"), F.count("*")).first() == (5.0, 4)
    assert images.pixels_to_dict(r).first()["values"] == {1: 5.0}


def test_functions_over_chunks(spark):
    df = spark.range(10)
    out = parallel.chunkwise(df, lambda f: f.assign(id=f.id * 2), "id long", 3)
    assert sorted(r.id for r in out.collect()) == list(range(0, 20, 2))
    assert parallel.pmap(spark, lambda x, y: x + y, [1, 2, 3], args=(10,)) == [11, 12, 13]
    assert parallel.pmap(spark, lambda a, b: a * b, [(2, 3), (4, 5)], star=True) == [6, 20] and parallel.pmap(spark, len, []) == []


def test_stream_of_positions(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:00", x, 5.0) for m, x in ((1, 5.0), (2, 7.0), (7, 25.0))]
    spark.createDataFrame(rows, "ts string, x double, y double").select(F.col("ts").cast("timestamp").alias("ts"), "x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, x double, y double").parquet(str(tmp_path / "in"))
    q = grid_counts(stream, 10, "5 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.cx, r.cy, r.n) for r in spark.sql("select * from cells").collect())
    assert got == [(0, 0, 2), (2, 0, 1)]


@pytest.mark.parametrize("directed", [True, False])
def test_routes_by_joins_equal_the_kernel(spark, directed):
    import random

    from geoengine.operators import network

    rng = random.Random(4)
    # weights that no two ways share, parallel edges and a part that is not reached
    edges = [(i, rng.randrange(7), rng.randrange(7), 1.0 + 2.0 ** -(i + 1)) for i in range(16)] + [(90, 50, 51, 1.0)]
    e = spark.createDataFrame(edges, "edge_id long, source long, target long, weight double")
    pairs = spark.createDataFrame([(0, 3), (0, 5), (2, 6), (0, 51), (4, 4), (0, 3)], "origin long, destination long")
    for k_routes in (1, 2):
        want = network.get_route(e, pairs, directed=directed, k_routes=k_routes, drop_middle_percent=50)
        got = network.routes_by_joins(e, pairs, directed=directed, k_routes=k_routes, drop_middle_percent=50)
        assert got.columns == want.columns
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, want.collect())) and rows


def test_common_reference_systems():
    from geoengine.functions.projection import crs_to_string, get_common_crs

    assert crs_to_string(25833) == crs_to_string("epsg:25833") == crs_to_string("25833") == "EPSG:25833" and crs_to_string(None) is None
    assert get_common_crs([25833, None, "EPSG:25833"]) == "EPSG:25833" and get_common_crs([None, ""]) is None and get_common_crs([]) is None
    for systems, strict in (([25833, 4326], False), ([25833, None], True)):
        with pytest.raises(ValueError, match="reference system"):
            get_common_crs(systems, strict)
