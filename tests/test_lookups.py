import datetime as dt

from pyspark.sql import functions as F

from terrasift.operators import asof, gridlookup, rasters, scenes, spatial, winter

D = dt.date


def test_nearest_day_takes_the_earlier_of_two_equally_near_days(spark):
    r = spark.createDataFrame([(1, D(2020, 1, 10)), (1, D(2020, 3, 1)), (2, D(2020, 1, 10))], "k int, date date")
    s = spark.createDataFrame([(1, D(2020, 1, 8), 5.0), (1, D(2020, 1, 12), 6.0)], "k int, date date, v double")
    got = {(x["k"], x["date"]): x["matched"] for x in asof.nearest_day(r, s, ["k"], ["v"]).collect()}
    assert got[(1, D(2020, 1, 10))]["v"] == 5.0 and got[(1, D(2020, 1, 10))]["days_off"] == 2
    assert got[(1, D(2020, 3, 1))] is None and got[(2, D(2020, 1, 10))] is None


def test_widest_range_then_smallest_id(spark):
    req = spark.createDataFrame([(1, "a", D(2020, 1, 5), D(2020, 1, 6))], "rid int, k string, start date, end date")
    cached = spark.createDataFrame(
        [(9, "a", D(2020, 1, 1), D(2020, 1, 9)), (3, "a", D(2020, 1, 1), D(2020, 1, 9)), (1, "a", D(2020, 1, 5), D(2020, 1, 7)), (2, "a", D(2020, 1, 6), D(2020, 3, 1))],
        "cache_id int, k string, start date, end date",
    )
    assert asof.containing_range(req, cached, ["k"], "rid").first()["cache_id"] == 3


def test_window_sum_counts_eight_days(spark):
    r = spark.createDataFrame([(1, D(2020, 1, 10))], "k int, date date")
    s = spark.createDataFrame([(1, D(2020, 1, d), 1.0) for d in range(1, 20)], "k int, date date, v double")
    assert asof.window_sum(r, s, ["k"], "v").first()["total"] == 8.0


def test_scene_window_excludes_its_last_day(spark):
    r = spark.createDataFrame([(1, D(2000, 6, 22))], "tile_id int, date date")
    make = lambda day, cloud: (1, day, cloud, 0.5, 1)
    s = spark.createDataFrame(
        [make(D(2000, 7, 13), 1.0), make(D(2000, 6, 1), 5.0), make(D(2000, 6, 20), 9.0)],
        "tile_id int, scene_date date, cloud_cover double, ndvi double, scene_id int",
    )
    got = scenes.clearest_scene(r, s).first()["scene"]
    assert got["scene_date"] == D(2000, 6, 1) and got["age_days"] == 21


def test_winter_index_by_hand(spark):
    s = spark.createDataFrame(
        [(1, D(2019, 11, 1), 10.0, 10.0), (1, D(2019, 12, 1), 10.0, -5.0), (1, D(2020, 4, 1), 4.0, 0.0), (1, D(2020, 5, 2), 90.0, -9.0)],
        "k int, date date, depth_in double, temperature_f double",
    )
    r = spark.createDataFrame([(1, D(2019, 11, 15)), (1, D(2020, 1, 1)), (1, D(2020, 8, 1)), (1, D(2021, 1, 1))], "k int, date date")
    got = {x["date"]: x["winter_severity_index"] for x in winter.severity_at(r, s, ["k"]).collect()}
    assert got == {D(2019, 11, 15): 5.0, D(2020, 1, 1): 25.0, D(2020, 8, 1): 29.0, D(2021, 1, 1): 0.0}


def test_plane_slope_and_aspect(spark):
    cells = spark.createDataFrame([(r, c, float(10 * c)) for r in range(4) for c in range(4)], "cell_row int, cell_col int, value double")
    out = rasters.slope_aspect(cells, 10.0, 10.0).collect()
    assert {round(x["slope"], 6) for x in out} == {45.0}
    assert {round(x["aspect"], 6) for x in out} == {270.0}


def test_focal_share_counts_the_box_corners(spark):
    cells = spark.createDataFrame([(r, c, 1.0) for r in range(5) for c in range(5)], "cell_row int, cell_col int, value double")
    got = {(x["cell_row"], x["cell_col"]): x["share"] for x in gridlookup.focal_share(cells, F.col("value") > 0, 1).collect()}
    assert abs(got[(2, 2)] - 5 / 9 * 100) < 1e-9 and abs(got[(0, 0)] - 3 / 4 * 100) < 1e-9


def test_first_area_wins_and_outside_is_background(spark):
    ring = lambda a, b: [{"lon": x, "lat": y} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    packs = spark.createDataFrame(
        [(2, 4, 1000, ring(0.0, 2.0)), (1, 8, 1000, ring(1.0, 3.0))],
        "area_id int, pack_size int, elk_count int, ring array<struct<lon:double,lat:double>>",
    )
    p = spark.createDataFrame([(1.5, 1.5), (0.5, 0.5), (9.0, 9.0)], "latitude double, longitude double")
    got = {x["latitude"]: x["wolves_per_1000_elk"] for x in spatial.with_wolf_density(p, packs).collect()}
    assert got == {1.5: 8.0, 0.5: 4.0, 9.0: 0.5}


def test_tolerance_match_prefers_exact(spark):
    p = spark.createDataFrame([(1, 43.0, -107.0, D(2020, 1, 1)), (2, 43.0, -107.0, D(2020, 1, 2))], "pid int, latitude double, longitude double, date date")
    r = spark.createDataFrame(
        [(1, 43.004, -107.0, D(2020, 1, 1), 0.1, 0), (5, 43.00001, -107.0, D(2020, 1, 1), 0.2, 0), (7, 43.01, -107.01, D(2020, 1, 2), 0.3, 1)],
        "result_id int, latitude double, longitude double, date date, ndvi double, qa_flags int",
    )
    got = {x["pid"]: (x["ndvi"], x["tier"]) for x in asof.match_results(p, r, "pid").collect()}
    assert got == {1: (0.2, "exact"), 2: (0.3, "tolerance")}
