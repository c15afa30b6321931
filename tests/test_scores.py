"""Factor scores on single contexts with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrasift.functions import scores

AS_OF = dt.date(2026, 10, 1)


def factor(spark, name, date, **ctx):
    df = spark.createDataFrame([(dt.date.fromisoformat(date), *ctx.values())], ["date", *ctx])
    out = scores.with_scores(df, [name], as_of=F.lit(AS_OF), fields=scores.FIELDS + scores.DETAILS)
    return out.first()


@pytest.mark.parametrize(
    "name,date,ctx,score,status",
    [
        ("elevation", "2026-10-15", {"elevation_ft": 9000.0}, 10.0, "excellent"),
        ("elevation", "2026-10-15", {"elevation_ft": 8250.0}, 8.5, "good"),
        ("elevation", "2026-10-15", {"elevation_ft": 6000.0}, 0.0, "critical"),
        ("elevation", "2026-10-05", {"elevation_ft": 8700.0}, 8.2, "good"),
        ("snow_conditions", "2026-10-02", {"snow_depth_inches": 12.0}, 8.5, "good"),
        ("snow_conditions", "2026-10-02", {"snow_depth_inches": 12.0, "snow_crust_detected": True}, 5.95, "good"),
        ("snow_conditions", "2026-10-02", {"snow_depth_inches": 50.0}, 1.0, "critical"),
        ("water_distance", "2026-10-15", {"water_distance_miles": 1.5, "water_reliability": 0.7}, 3.5, "fair"),
        ("vegetation_quality", "2026-05-01", {"ndvi": 0.6, "irg": 0.02}, 9.775, "good"),
        ("vegetation_quality", "2026-10-01", {"ndvi": 0.4, "irg": -0.02}, 4.95, "fair"),
        ("hunting_pressure", "2026-10-07", {"road_distance_miles": 2.0}, 10.5, "excellent"),
        ("hunting_pressure", "2026-10-20", {"road_distance_miles": 0.25}, 2.5, "poor"),
        ("hunting_pressure", "2026-10-24", {"road_distance_miles": 2.0}, 8.5, "excellent"),
        ("hunting_pressure", "2026-07-01", {"road_distance_miles": 0.2}, 7.0, "fair"),
        ("security_habitat", "2026-07-01", {"slope_degrees": 45.0}, 10.0, "excellent"),
        ("security_habitat", "2026-09-20", {"security_habitat_percent": 25.0}, 6.6, "fair"),
        ("predation_risk", "2026-05-15", {"wolves_per_1000_elk": 10.0, "bear_activity_distance_miles": 1.5}, 4.5, "fair"),
        ("nutritional_condition", "2026-10-15", {"summer_integrated_ndvi": 75.0}, 10.0, "excellent"),
        ("winter_severity", "2026-01-15", {"winter_severity_index": 3000.0}, 8.5, "good"),
        ("rut_behavior", "2026-09-20", {"elevation_ft": 9000.0, "slope_degrees": 20.0}, 8.1, "good"),
        ("rut_behavior", "2026-07-20", {"elevation_ft": 9000.0}, 7.0, "good"),
        ("ml_prediction", "2026-07-20", {"ml_probability": 0.8}, 8.0, "excellent"),
        ("ml_prediction", "2026-07-20", {"ml_probability": 0.8, "ml_missing_share": 0.4}, 5.0, "fair"),
    ],
)
def test_factor(spark, name, date, ctx, score, status):
    row = factor(spark, name, date, **ctx)
    assert row[f"{name}_score"] == pytest.approx(score)
    assert row[f"{name}_status"] == status
    assert row[f"{name}_note"]


def test_missing_required_input_makes_totals_null(spark):
    df = spark.createDataFrame([(dt.date(2026, 10, 15), 0.5)], ["date", "water_distance_miles"])
    row = scores.score_habitat(df, ["elevation", "water_distance"], as_of=F.lit(AS_OF)).first()
    assert row["elevation_score"] is None and row["total_score"] is None


def test_weighted_aggregate_and_array(spark):
    df = spark.createDataFrame([(dt.date(2026, 10, 15), 9000.0, 1.5)], ["date", "elevation_ft", "water_distance_miles"])
    names, weights = ["elevation", "water_distance"], {"elevation": 2.0, "water_distance": 3.0}
    out = scores.score_habitat(df, names, weights=weights, as_of=F.lit(AS_OF), details=True)
    row = scores.with_factor_array(out, names, weights).first()
    assert row["total_score"] == pytest.approx((10 * 2 + 5 * 3) / 50 * 100)
    assert row["limiting_factor"] == "water_distance" and row["best_factor"] == "elevation"
    assert [f["contribution"] for f in row["factors"]] == [20.0, 15.0]
    assert row["factors"][0]["contribution_pct"] == pytest.approx(20 / 70 * 100)


def test_registered_factor(spark):
    scores.register_factor("flat", lambda x, d: scores.factor_struct(F.lit(5.0), 1.0, "fair", F.lit("flat"), F.lit(5.0)), 1.0)
    try:
        df = spark.createDataFrame([(dt.date(2026, 10, 15),)], ["date"])
        assert scores.score_habitat(df, ["flat"]).first()["total_score"] == 50.0
    finally:
        scores.FACTORS.pop("flat")
