import math

import pytest
from pyspark.sql import functions as F

from blackspot.functions.colors import green_red_hex
from blackspot.functions.geo import haversine_miles, morton, planar_miles
from blackspot.operators import clean, layers, neighborhood, ranking, rates, regions
from blackspot.sources.schema import CRASH_COLUMNS

CENTROIDS = "cluster long, centroid_latitude double, centroid_longitude double, fatality_rate double"


def test_box_edges_belong_to_the_region(spark):
    rows = [(1, 29.7, -98.8), (2, 29.8, -98.6), (3, 29.69999, -98.7), (4, 29.75, -98.59999), (5, None, -98.7), (6, math.nan, -98.7)]
    df = spark.createDataFrame(rows, "id int, Latitude double, Longitude double")
    inside = regions.filter_region(df, (29.7, 29.8), (-98.8, -98.6))
    assert {r.id for r in inside.collect()} == {1, 2}
    text = df.withColumn("Latitude", F.col("Latitude").cast("string"))
    assert {r.id for r in regions.filter_region(text, (29.7, 29.8), (-98.8, -98.6)).collect()} == {1, 2}


def plan_of(frame):
    """The physical plan with the whole lists of filters and columns."""
    conf = frame.sparkSession.conf
    conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        return frame.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("sent", [regions.BROADCAST_CELLS, 3])
def test_many_boxes_prune_the_scan(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(regions, "BROADCAST_CELLS", sent)
    boxes = [regions.Region(f"b{i}", 29 + i * .1, 29.15 + i * .1, -99, -97) for i in range(37)]
    df = spark.createDataFrame([(i, 29 + i * .07, -98.0) for i in range(60)], "id int, Latitude double, Longitude double")
    df.write.parquet(str(tmp_path / "t"))
    tagged = regions.tag_regions(spark.read.parquet(str(tmp_path / "t")), boxes)
    got = {(r.id, r.region) for r in tagged.collect()}
    want = {(i, b.name) for i in range(60) for b in boxes if b.lat_min <= 29 + i * .07 <= b.lat_max}
    assert got == want and len(got) > 60
    plan = plan_of(tagged)
    assert "GreaterThanOrEqual(Latitude,29.0)" in plan and "LessThanOrEqual(Longitude,-97.0)" in plan
    assert regions.tag_regions(df, []).collect() == [] and "region" in regions.tag_regions(df, []).columns


def test_region_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, 29.5, -98.0), (2, 31.0, -98.0)], "id int, Latitude double, Longitude double")
    df.write.parquet(str(tmp_path / "t"))
    cut = regions.filter_region(spark.read.parquet(str(tmp_path / "t")), (29, 30), (-99, -97)).select("id")
    assert [r.id for r in cut.collect()] == [1]
    plan = plan_of(cut)
    assert "GreaterThanOrEqual(Latitude,29.0)" in plan and "ReadSchema: struct<id:int,Latitude:double,Longitude:double>" in plan


def test_infinite_coordinates_are_dropped(spark):
    df = spark.createDataFrame([(1, "29.5", "-98"), (2, "Infinity", "-98"), (3, "29", "-inf"), (4, "1e300", "0")], "id int, Latitude string, Longitude string")
    assert [r.id for r in clean.clean_coordinates(df).collect()] == [1, 4]
    doubles = spark.createDataFrame([(1, 29.5, -98.0), (2, math.inf, -98.0), (3, math.nan, 0.0)], "id int, Latitude double, Longitude double")
    assert [r.id for r in clean.clean_coordinates(doubles).collect()] == [1]


def test_unreadable_coordinates_are_dropped(spark):
    rows = [("1", "29.5", "-98"), ("2", "x", "-98"), ("3", None, "-98"), ("4", "NaN", "-98"), ("5", "30", "")]
    df = spark.createDataFrame(rows, "id string, Latitude string, Longitude string")
    assert [r.id for r in clean.clean_coordinates(df).collect()] == ["1"]


def test_coordinates_are_parsed_once(spark):
    rows = spark.range(3).select(F.regexp_replace(F.col("id").cast("string"), "twice", "").alias("Latitude"), F.lit("1.5").alias("Longitude"), "id")
    got = clean.clean_coordinates(rows)
    assert got.columns == ["Latitude", "Longitude", "id"] and sorted(got.collect()) == [(0.0, 1.5, 0), (1.0, 1.5, 1), (2.0, 1.5, 2)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("twice") == 1


def test_dates_with_and_without_zeros(spark):
    df = spark.createDataFrame([("1/2/2022",), ("01/02/2022",), ("2022-01-02",), ("13/45/2022",), (None,)], "Crash_Date string")
    assert clean.filter_year(df, 2022).count() == 2


def test_profile_and_missing_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    assert {(r.column_name, r.non_null) for r in clean.null_profile(df).collect()} == {("a", 2), ("b", 1)}
    with pytest.raises(ValueError):
        clean.project_crashes(df)
    with pytest.raises(ValueError):
        clean.clean_coordinates(df)
    assert len(CRASH_COLUMNS) == 12


def test_cluster_count_is_floored_and_at_least_one(spark):
    assert rates.cluster_count(spark.range(249)).first()["clusters"] == 1
    assert rates.cluster_count(spark.range(0)).first()["clusters"] == 1
    assert rates.cluster_count(spark.range(999)).first()["clusters"] == 3


def test_rate_ignores_missing_deaths(spark):
    rows = [(1, 10., 20., 1), (1, 11., 21., None), (1, 12., 22., 2), (2, 1., 1., None)]
    df = spark.createDataFrame(rows, "c int, Latitude double, Longitude double, Death_Cnt int")
    got = {r.c: r for r in rates.fatality_rate(df, "c").collect()}
    assert got[1].fatality_rate == 1.5 and got[1].centroid_latitude == 11.0
    assert got[2].fatality_rate is None


def test_rank_orders_ties_and_missing_rates(spark):
    rows = [(5, 0., 0., .5), (2, 0., 0., .5), (9, 0., 0., math.nan), (1, 0., 0., None), (3, 0., 0., .7)]
    df = spark.createDataFrame(rows, CENTROIDS)
    assert [r.cluster for r in ranking.rank_clusters(df, "cluster").orderBy("rank").collect()] == [3, 2, 5, 1, 9]
    assert ranking.nth_cluster(df, "cluster", 2).first().cluster == 2
    assert ranking.nth_cluster(df, "cluster", 6).count() == 0
    with pytest.raises(ValueError):
        ranking.nth_cluster(df, "cluster", 0)


def test_rank_numbers_a_skewed_table(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 977).alias("v"))
    got = ranking.with_rank(df, F.col("v").desc(), "id").orderBy("rank").collect()
    want = sorted(df.collect(), key=lambda r: (-r.v, r.id))
    assert [(r.rank, r.id) for r in got] == [(i + 1, r.id) for i, r in enumerate(want)]


def test_known_distance_and_colors(spark):
    # Two published cluster centroids and marker colours.
    rows = [(3, 30.654832275, -101.89871095, 0.5), (5, 29.95104905888889, -101.97878819222224, 0.444), (7, 30.6, -101.9, 0.0)]
    df = spark.createDataFrame(rows, CENTROIDS)
    got = {r.cluster: r for r in neighborhood.marker_table(df, "cluster", 1, 50).collect()}
    assert abs(got[5].distance - 48.874) < 5e-4 and got[3].distance == 0
    assert got[3].color_hex == "#ff0000" and got[7].color_hex == "#008000" and got[5].color_hex == "#e30e00"
    assert spark.range(1).select(green_red_hex(F.lit(35.2 / 256)).alias("c")).first().c == "#236e00"
    assert neighborhood.radius_neighbors(df, "cluster", 1, 48.8).count() == 2


def test_equal_rates_have_no_color(spark):
    df = spark.createDataFrame([(1, 30., -100., .2), (2, 30.1, -100., .2)], CENTROIDS)
    got = neighborhood.marker_table(df, "cluster", 1, 50).collect()
    assert [r.color_value for r in got] == [None, None] and [r.color_hex for r in got] == [None, None]


def test_great_circle_is_shorter_east_west(spark):
    args = [F.lit(v) for v in (30.0, -100.0, 30.0, -101.0)]
    row = spark.range(1).select(planar_miles(*args).alias("p"), haversine_miles(*args).alias("h")).first()
    assert row.p == 69.0 and 59 < row.h < 60.5


def test_morton_interleaves(spark):
    row = spark.range(1).select(morton(F.lit(0b101).cast("long"), F.lit(0b011).cast("long")).alias("z")).first()
    assert row.z == 0b011011


def test_layers(spark):
    rows = [(i, 30.0 + i * .01, -100.0 - i * .01, i % 12) for i in range(48)]
    df = spark.createDataFrame(rows, "Crash_ID long, Latitude double, Longitude double, c int")
    slots = {r.c: r.slot for r in layers.cluster_layer(df, "c").collect()}
    assert slots == {i: i % 10 for i in range(12)}
    cents = spark.createDataFrame([(1, 30., -100., .1), (2, 31., -101., .3)], CENTROIDS)
    got = layers.centroid_layer(cents, "cluster").orderBy("cluster").collect()
    assert [r.color_value for r in got] == [0.0, 1.0]
    assert abs((got[0].max_x - got[0].min_x) / (got[0].x - got[1].x) - 1.2) < 1e-9


def test_density_split(spark):
    rows = [(i, 30.01 + (i % 5) * 1e-3, -100.05) for i in range(20)] + [(99, 35.0, -100.0)]
    df = spark.createDataFrame(rows, "Crash_ID long, Latitude double, Longitude double")
    got = {r.Crash_ID: r.area for r in regions.density_split(df, 20).collect()}
    assert got.pop(99) == "rural" and set(got.values()) == {"urban"}


def test_markers_of_many_ranks_equal_those_of_each(spark):
    rows = [(i, 30 + (i * 37 % 100) / 40, -100 + (i * 53 % 100) / 40, (i * 7 % 11) / 10 if i % 9 else None) for i in range(80)]
    df = spark.createDataFrame(rows + [(900, 30.0, None, 0.5)], "cluster long, centroid_latitude double, centroid_longitude double, fatality_rate double")
    got = {}
    for r in neighborhood.marker_table_ranks(df, "cluster", 2, 6, 40).collect():
        got.setdefault(r["rank"], set()).add(tuple(r)[1:])
    want = {rank: set(map(tuple, neighborhood.marker_table(df, "cluster", rank, 40).collect())) for rank in range(2, 7)}
    assert got == {rank: rows for rank, rows in want.items() if rows} and len(got) > 3
    with pytest.raises(ValueError):
        neighborhood.marker_table_ranks(df, "cluster", 3, 2, 40)


def test_urban_areas(crashes):
    # A chain of cells, one that touches it at a corner, one apart, one across zero, and a cell with too few crashes.
    cells = [(295, -986), (295, -985), (295, -984), (296, -983), (300, -986), (0, -1), (-1, 0), (294, -990)]
    places = [(a, b) for a, b in cells for _ in range(3 if (a, b) != (294, -990) else 2)]
    df = crashes([a / 10 + 0.05 for a, _ in places], [b / 10 + 0.05 for _, b in places], [i % 2 for i in range(len(places))])
    df = df.withColumn("Death_Cnt", F.when(F.col("Crash_ID") > 0, F.col("Death_Cnt")))
    got = {(r.area_lat, r.area_lon): (r.cells, r.crashes, r.deaths) for r in regions.urban_areas(df, 3).collect()}
    assert got == {(295, -986): (4, 12, 6), (300, -986): (1, 3, 1), (-1, 0): (2, 6, 3)}
    tagged = regions.tag_urban_areas(df, 3)
    assert {(r.area_lat, r.area_lon): r["count"] for r in tagged.groupBy("area_lat", "area_lon").count().collect()} == {
        (295, -986): 12, (300, -986): 3, (-1, 0): 6, (None, None): 2}
    assert regions.urban_areas(df.limit(0), 3).collect() == [] and regions.tag_urban_areas(df, 99).filter("area_lat is not null").isEmpty()


def test_boxes_are_sent_by_their_cells():
    assert regions.cells_in([regions.Region("", 0, 10, 0, 10)] * 3) == 3 * 21 * 21
    assert regions.cells_in([regions.Region("", 0.1, 0.2, -0.1, 0.1)]) == 2
