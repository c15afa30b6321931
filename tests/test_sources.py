import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.sources import feeds, presence, vector


def test_csv_fixes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Lat,Long,DT\n43.1,-107.2,2020-05-01\n95,-107,2020-05-02\nx,-107,\n,,\n")
    df = presence.assemble_dataset(presence.read_fixes(spark, str(tmp_path)), "north")
    rows = df.collect()
    assert [(r["latitude"], r["longitude"], r["date"], r["dataset"]) for r in rows] == [
        (43.1, -107.2, dt.date(2020, 5, 1), "north")
    ]


def test_csv_utm(spark, tmp_path):
    e, n = spark.range(1).select(*[c.alias(a) for c, a in zip(geo.wgs84_to_utm(F.lit(43.5), F.lit(-110.0), 12), "en")]).first()
    (tmp_path / "u.csv").write_text(f"Easting,Northing\n{e},{n}\n,\n")
    rows = presence.read_fixes(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    assert rows[0]["latitude"] == pytest.approx(43.5, abs=1e-8) and rows[0]["longitude"] == pytest.approx(-110.0, abs=1e-8)


def test_known_utm_point(spark):
    # zone 12 central meridian: easting 500 km, northing is the scaled meridian arc
    e, n = spark.range(1).select(*[c.alias(a) for c, a in zip(geo.wgs84_to_utm(F.lit(45.0), F.lit(-111.0), 12), "en")]).first()
    assert e == pytest.approx(500000.0, abs=1e-6)
    assert n == pytest.approx(4982950.400, abs=0.01)


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError):
        presence.normalise_fixes(spark.createDataFrame([(1,)], ["a"]))


def features():
    return [
        {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [-107, 43]}},
        {"type": "Feature", "properties": {"name": "l"}, "geometry": {"type": "LineString", "coordinates": [[-107, 43], [-106, 44]]}},
        {
            "type": "Feature",
            "properties": {"name": "m"},
            "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
        },
    ]


@pytest.mark.parametrize("lines", [False, True])
def test_geojson(spark, tmp_path, lines):
    path = tmp_path / "layer.json"
    path.write_text(
        "\n".join(json.dumps(f) for f in features()) if lines else json.dumps({"type": "FeatureCollection", "features": features()})
    )
    df = vector.read_geojson(spark, str(path), lines=lines)
    out = df.select(df.properties["name"].alias("name"), vector.flat_vertices(df.geometry_type, df.coordinates).alias("v"))
    got = {r["name"]: [(x["lon"], x["lat"]) for x in r["v"]] for r in out.collect()}
    assert got["p"] == [(-107.0, 43.0)] and len(got["l"]) == 2 and got["m"][4] == (5.0, 5.0)


def test_simplify_keeps_corners(spark):
    line = [{"lon": x / 10, "lat": 0.0 if x < 5 else (x - 5) / 10} for x in range(10)]
    df = spark.createDataFrame([(1, line)], "id int, vertices array<struct<lon:double,lat:double>>")
    v = vector.simplify_lines(df, "id", 0.0001).first()["vertices"]
    assert [(p["lon"], p["lat"]) for p in v] == [(0.0, 0.0), (0.5, 0.0), (0.9, 0.4)]


def test_ragged_forecast(spark):
    doc = json.dumps({"daily": {"time": ["2026-01-01", "2026-01-02"], "temperature_2m_max": [40.0], "precipitation_sum": [0.1, 0.2]}})
    rows = feeds.daily_forecast(spark.createDataFrame([(doc,)], ["json"])).orderBy("date").collect()
    assert [r["temp_max_f"] for r in rows] == [40.0, None]
    assert [r["precipitation_inches"] for r in rows] == [0.1, 0.2] and rows[0]["cloud_cover_percent"] is None


def test_ndvi_product_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text(
        "Date,Latitude,Longitude,MOD13Q1_061__250m_16_days_VI_Quality,MOD13Q1_061__250m_16_days_NDVI\n"
        "2020-06-01,43,-107,2,5000\n2020-06-01,43,-107,2,-3000\n2020-06-01,43,-107,0,0.4\n"
    )
    got = sorted((r["ndvi"], r["qa_flags"]) for r in feeds.read_ndvi_results(spark, str(tmp_path)).collect())
    assert got == [(0.4, 0), (0.5, 2)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_table_sink(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "north"), (2, "south")], "id int, dataset string")
    feeds.write_table(df, str(tmp_path / "t"), fmt)
    assert (tmp_path / "t" / "dataset=north").exists()
    back = spark.read.option("header", True).format(fmt).load(str(tmp_path / "t"))
    assert back.count() == 2
