import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrasift.operators import absence, features, models, quality, series, stats
from terrasift.plans.context import Layers, assemble_context

COLS = "latitude double, longitude double, elk_present int, route_id int, Elk_ID string, elevation_ft double, date date"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(43.0, -107.0, 1, 1, "a", 8000.0, dt.date(2020, 9, 20)), (44.0, -108.0, 0, 2, "b", 9000.0, dt.date(2020, 3, 1))]
    return spark.createDataFrame(rows, COLS)


def test_metadata_is_dropped_without_case(table):
    assert features.feature_columns(table) == ["elevation_ft", "latitude", "longitude"]


def test_training_table(table):
    out = features.prepare_training(table.withColumn("day_of_year", F.dayofyear("date")))
    assert out.columns[0] == "elk_present"
    assert {"day_of_year_sin", "day_of_year_cos", "rut_phase"} <= set(out.columns) and "day_of_year" not in out.columns
    assert [r["rut_phase"] for r in out.orderBy("latitude").collect()] == ["peak_rut", "none"]


def test_combine_requires_the_target(table):
    with pytest.raises(ValueError):
        features.combine_tables([table, table.drop("elk_present")])


def test_force_enriches_everything(table):
    todo, rest = features.split_for_enrichment(table, ["elevation_ft"], force=True)
    assert (todo.count(), rest.count()) == (2, 0)


def test_context_without_layers_has_documented_defaults(spark):
    p = spark.createDataFrame([(43.0, -107.0, dt.date(2026, 1, 15)), (50.0, -107.0, dt.date(2026, 1, 15))], "latitude double, longitude double, date date")
    inside, outside = assemble_context(p, Layers()).orderBy("latitude").collect()
    assert (inside["elevation_ft"], inside["water_reliability"], inside["bear_data_quality"]) == (8500.0, 0.8, 0.5)
    assert inside["snow_depth_inches"] == 25.0 and inside["ndvi"] == 0.3
    assert outside["elevation_ft"] is None and outside["land_cover_type"] == "outside_bounds"
    assert 0 <= inside["effective_illumination"] <= 1


def test_context_station_snow(spark):
    p = spark.createDataFrame([(43.0, -107.0, dt.date(2026, 1, 15)), (43.0, -107.0, dt.date(2026, 2, 15))], "latitude double, longitude double, date date")
    stations = spark.createDataFrame(
        [(1, "unmapped", 43.0, -107.0, False), (2, "mapped", 43.3, -107.0, True)], "station_id int, name string, lat double, lon double, has_data boolean"
    )
    s = spark.createDataFrame([(2, dt.date(2026, 1, 12), None, 5.0), (2, dt.date(2026, 1, 18), 99.0, 1.0)], "station_id int, date date, depth_in double, swe_in double")
    near, late = assemble_context(p, Layers(stations=stations, station_series=s)).orderBy("date").collect()
    assert near["snow_station_name"] == "mapped" and near["snow_data_source"] == "snotel"
    assert near["snow_depth_inches"] == 20.0  # five inches of water at the standard density
    assert late["snow_data_source"] == "estimate" and late["snow_depth_inches"] == 25.0


def test_absence_budget():
    assert absence.first_range(100) == 10000 and absence.first_range(10**9) == 2 * 10**9
    assert absence.targets(1000) == {"environmental": 400, "unsuitable": 300, "background": 200, "temporal": 100}


@pytest.mark.parametrize("t,dof,p", [(2.228, 10, 0.05), (2.576, 1e6, 0.01), (0.0, 5, 1.0), (12.706, 1, 0.05)])
def test_student_p_values(t, dof, p):
    assert stats.student_two_sided(t, dof) == pytest.approx(p, abs=2e-4)


def test_partial_autocorrelation_of_a_first_order_process(spark):
    acf = spark.createDataFrame([("x", k, 0.5**k) for k in range(5)], "feature string, lag int, acf double")
    got = {r["lag"]: r["pacf"] for r in series.partial_autocorrelation(acf).collect()}
    assert got[0] == 1.0 and got[1] == pytest.approx(0.5)
    assert all(abs(got[k]) < 1e-12 for k in (2, 3, 4))


def test_rule_report_skips_missing_columns(spark):
    rows = quality.rule_report(spark.createDataFrame([(0.4,), (2.0,)], "ndvi double")).collect()
    assert {r["rule"] for r in rows} == {"ndvi_placeholder_pct", "ndvi_out_of_range"}
    assert [r["failed"] for r in rows if r["rule"] == "ndvi_out_of_range"] == [True]


def test_classifier_learns_a_threshold(spark):
    df = spark.range(600).select(
        (F.col("id") % 100).cast("double").alias("a"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5).cast("double").alias("b"),
        F.when(F.col("id") % 100 >= 50, 1).otherwise(0).alias("elk_present"),
    )
    model = models.fit(df, ["a", "b"], maxIter=3, maxDepth=2)
    scored = models.score(model, df, ["a", "b"])
    row = models.evaluate(scored).first()
    assert row["accuracy"] == 1.0 and row["auc"] == 1.0
    best = models.feature_importance(model, ["a", "b"], spark).orderBy(F.desc("importance")).first()
    assert best["feature"] == "a"


def test_threshold_takes_the_first_maximum(spark):
    df = spark.createDataFrame([(0.2, 0), (0.8, 1)], "p double, elk_present int")
    row = models.best_f1_threshold(df, "p").first()
    assert row["f1"] == 1.0 and row["threshold"] == pytest.approx(0.21)


def test_threshold_without_positives(spark):
    df = spark.createDataFrame([(0.2, 0), (0.8, 0)], "p double, elk_present int")
    assert models.best_f1_threshold(df, "p").first()["threshold"] == 0.5


def test_validation_scores_rows_once(spark):
    """Metrics read written scores: no plan of theirs runs the model again."""
    rows = [(i, i % 2, float(i % 7 + 3 * (i % 2)), [-110.0, -105.0][i // 2 % 2], 43.0) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, elk_present int, x double, longitude double, latitude double")
    for out in (models.fold_validation(df, ["x"], ["k"], folds=2, rounds=3), models.region_validation(df, ["x"], ["k"], threshold=None, rounds=3)):
        assert "PythonUDF" not in out._jdf.queryExecution().analyzed().toString()
        assert sum(r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in out.collect()) == 80


def test_candidates_are_drawn_in_tasks_of_bounded_size(spark):
    assert absence.candidates(spark, 0, 100 * absence.RANGE_ROWS, 1).rdd.getNumPartitions() >= 100
