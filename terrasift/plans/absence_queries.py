"""Pseudo-absence strategies over the observation table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators import absence
from terrasift.operators.gridlookup import sample_layers
from terrasift.operators.nearest import with_water
from terrasift.plans.aggregate_queries import rounded
from terrasift.plans.join_queries import GRID, HAV
from terrasift.plans.registry import query
from terrasift.sources.surrogates import cte, view


def _u(seed, stream: str, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}|{stream}|' || {key}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _candidates(seed: int, least: int = 10_000) -> str:
    """Candidate numbers of the SQL twins: more than any strategy draws on the test tables."""
    return (
        f"SELECT candidate_id, 41 + {_u(seed, 'lat', 'candidate_id')} * 4 AS latitude, -111 + {_u(seed, 'lon', 'candidate_id')} * 7 AS longitude"
        f" FROM (SELECT unnest(range(greatest({least}, 4 * (SELECT count(*) FROM obs)))) AS candidate_id)"
    )


def _far(metres: int, seed: int = 42) -> str:
    return f"""
, cand AS ({_candidates(seed)}),
pr AS (SELECT obs_id, latitude AS lat, longitude AS lon, latitude, longitude, date, dataset FROM obs WHERE elk_present = 1),
steps AS (SELECT y.k AS dy, x.k AS dx FROM (VALUES (-1), (0), (1)) y(k), (VALUES (-1), (0), (1)) x(k)),
near AS (SELECT DISTINCT o.candidate_id
   FROM (SELECT *, CAST(floor(latitude / 0.03) AS INT) + dy AS cy, CAST(floor(longitude / 0.03) AS INT) + dx AS cx FROM cand, steps) o
   JOIN (SELECT *, CAST(floor(lat / 0.03) AS INT) AS cy, CAST(floor(lon / 0.03) AS INT) AS cx FROM pr) f USING (cy, cx)
   WHERE {HAV.format(f='f.', p='o.')} * 1000 < {metres}),
far AS (SELECT * FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM near)),
np AS (SELECT count(*) AS n, min(year(date)) AS y0, max(year(date)) AS y1 FROM pr)
"""


def _presence(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Presence rows and their number."""
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude", "date", "dataset", "elk_present")
    p = o.filter("elk_present = 1").drop("elk_present")
    return p, p.count()


@query(
    "absence_temporally_matched",
    "G1 J15",
    cte("obs")
    + _far(2000)
    + f"""
, kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY candidate_id) AS rn FROM far) WHERE rn <= (SELECT n FROM np)),
rk AS (SELECT date, row_number() OVER (ORDER BY md5('42|date|' || obs_id)) AS rank FROM pr),
rd AS (SELECT dataset, row_number() OVER (ORDER BY md5('42|dataset|' || obs_id)) AS rank FROM pr),
j AS (SELECT k.*, rk.date AS d0, rd.dataset FROM kept k, np, rk, rd WHERE rk.rank = CAST(floor({_u(42, 'date_pick', 'candidate_id')} * n) AS BIGINT) + 1
  AND rd.rank = CAST(floor({_u(42, 'dataset_pick', 'candidate_id')} * n) AS BIGINT) + 1),
dd AS (SELECT *, make_date(year(d0), month(d0), CAST(least(greatest(day(d0) + floor({_u(42, 'jitter', 'candidate_id')} * 7) - 3, 1), day(last_day(d0))) AS BIGINT)) AS date FROM j)
SELECT candidate_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, dataset, date, year(date) AS year, month(date) AS month,
  dayofyear(date) AS day_of_year, CASE WHEN month(date) IN (12,1,2) THEN 'wi' WHEN month(date) IN (3,4,5) THEN 'sp' WHEN month(date) IN (6,7,8) THEN 'su' ELSE 'fa' END AS season,
  'temporal_matched' AS absence_strategy, 'medium' AS confidence, 0 AS elk_present FROM dd
""",
)
def absence_temporally_matched(spark: SparkSession, d: str) -> DataFrame:
    p, n = _presence(spark, d)
    return rounded(absence.temporally_matched(p, n, "obs_id"), ["latitude", "longitude"])


@query(
    "absence_seasonal",
    "G2 F7 T4",
    cte("obs")
    + """
, pr AS (SELECT * FROM obs WHERE elk_present = 1),
s AS (SELECT *, row_number() OVER (ORDER BY md5('42|season|' || obs_id)) AS rn FROM pr)
SELECT obs_id, date AS original_date, dataset AS source_dataset,
  CAST(date + CASE WHEN dataset = 'gye' THEN INTERVAL 4 MONTH ELSE INTERVAL 6 MONTH END AS DATE) AS date,
  'seasonal_segregation' AS absence_strategy, 'high' AS confidence FROM s
""",
)
def absence_seasonal(spark: SparkSession, d: str) -> DataFrame:
    p, n = _presence(spark, d)
    out = absence.seasonal_segregation(p, n, "obs_id", offsets={"gye": 4})
    return out.select("obs_id", "original_date", "source_dataset", "date", "absence_strategy", "confidence")


def _layers(spark: SparkSession, d: str, points: DataFrame) -> DataFrame:
    v = F.col("value")
    layers = view(spark, d, "raster_cells").select(
        "cell_row",
        "cell_col",
        F.inline(
            F.array(
                F.struct(F.lit("elevation_ft").alias("layer"), (v * 2 - 4000).alias("value")),
                F.struct(F.lit("slope_degrees").alias("layer"), (v % 70).alias("value")),
            )
        ),
    )
    return sample_layers(points, layers, GRID, {"elevation_ft": 8500.0, "slope_degrees": 15.0})


_LAYERS = """SELECT c.*, coalesce(value * 2 - 4000, 8500) AS elevation_ft, coalesce(value % 70, 15) AS slope_degrees FROM {src} c LEFT JOIN raster_cells v
  ON v.cell_row = CAST(floor((latitude - 45) / -0.1) AS INT) AND v.cell_col = CAST(floor((longitude + 111) / 0.14) AS INT)"""


def _rule_sql(i: int, name: str, months: list[int], test: str) -> str:
    seed = 43 + i
    return f"""SELECT '{name}' AS rule, {seed} AS seed, candidate_id, latitude, longitude,
   list_extract({months}, CAST(floor({_u(seed, 'month', 'candidate_id')} * {len(months)}) AS INT) + 1) AS m FROM ({_LAYERS.format(src=f'({_candidates(seed, 400_000)})')}) WHERE {test}"""


@query(
    "absence_unsuitable_season",
    "G3 P11",
    cte("obs", "raster_cells")
    + ", np AS (SELECT count(*) AS n, min(year(date)) AS y0, max(year(date)) AS y1 FROM obs WHERE elk_present = 1), every AS ("
    + " UNION ALL ".join(
        [
            _rule_sql(0, "winter_too_high", [12, 1, 2, 3], "elevation_ft >= 9000"),
            _rule_sql(1, "summer_too_low", [6, 7, 8], "elevation_ft <= 6000"),
            _rule_sql(2, "fall_too_high", [9, 10, 11], "elevation_ft >= 11000"),
            _rule_sql(3, "fall_too_low", [9, 10, 11], "elevation_ft <= 5000"),
        ]
    )
    + f"""),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY candidate_id) AS rn FROM every) WHERE rn <= (SELECT n // 4 FROM np)),
y AS (SELECT k.*, CAST(y0 + floor({_u("' || seed || '", 'year', 'candidate_id')} * (y1 - y0 + 1)) AS BIGINT) AS yy FROM k, np)
SELECT rule, candidate_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  make_date(yy, m, CAST(floor({_u("' || seed || '", 'day', 'candidate_id')} * day(last_day(make_date(yy, m, 1)))) AS BIGINT) + 1) AS date FROM y
""",
)
def absence_unsuitable_season(spark: SparkSession, d: str) -> DataFrame:
    p, n = _presence(spark, d)
    out = absence.unsuitable_season(p, n, lambda c: _layers(spark, d, c))
    return rounded(out.select("rule", "candidate_id", "latitude", "longitude", "date"), ["latitude", "longitude"])


@query(
    "absence_random_temporal",
    "G4",
    cte("obs")
    + _far(500)
    + f"""
, kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY candidate_id) AS rn FROM far) WHERE rn <= (SELECT n FROM np)),
y AS (SELECT kept.*, CAST(y0 + floor({_u(42, 'year', 'candidate_id')} * (y1 - y0 + 1)) AS BIGINT) AS yy, CAST(floor({_u(42, 'month', 'candidate_id')} * 12) AS BIGINT) + 1 AS m FROM kept, np)
SELECT candidate_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  make_date(yy, m, CAST(floor({_u(42, 'day', 'candidate_id')} * day(last_day(make_date(yy, m, 1)))) AS BIGINT) + 1) AS date,
  'random_background' AS absence_strategy, 'low' AS confidence, 0 AS elk_present FROM y
""",
)
def absence_random_temporal(spark: SparkSession, d: str) -> DataFrame:
    p, n = _presence(spark, d)
    return rounded(absence.random_temporal(p, n), ["latitude", "longitude"])


_WATER = f"""
, fl AS ({_LAYERS.format(src='far')}),
wn AS (SELECT o.candidate_id, min({HAV.format(f='f.', p='o.')}) AS km FROM fl o, water_features f WHERE abs(f.lat - o.latitude) < 0.91 GROUP BY 1),
ctx AS (SELECT fl.*, CASE WHEN km <= 100 THEN km * 1000 / 1609.34 ELSE 10 END AS water FROM fl LEFT JOIN wn USING (candidate_id))
"""


def _context(spark: SparkSession, d: str):
    def add(points: DataFrame) -> DataFrame:
        return with_water(_layers(spark, d, points), view(spark, d, "water_features"))

    return add


@query(
    "absence_environmental",
    "G5 P9",
    cte("obs", "raster_cells", "water_features")
    + _far(2000)
    + _WATER
    + """
, ok AS (SELECT *, row_number() OVER (ORDER BY candidate_id) AS rn FROM ctx WHERE elevation_ft BETWEEN 6000 AND 13500 AND slope_degrees < 45 AND water <= 5)
SELECT candidate_id, elevation_ft, slope_degrees, round(water, 4) AS water_distance_miles FROM ok WHERE rn <= (SELECT CAST(floor(n * 0.4::DOUBLE) AS BIGINT) FROM np)
""",
)
def absence_environmental(spark: SparkSession, d: str) -> DataFrame:
    p, n = _presence(spark, d)
    out = absence.environmental(p, absence.targets(n)["environmental"], _context(spark, d))
    return rounded(out.select("candidate_id", "elevation_ft", "slope_degrees", "water_distance_miles"), ["water_distance_miles"], 4)


@query(
    "absence_unsuitable_habitat",
    "G6 P10",
    cte("obs", "raster_cells", "water_features")
    + _far(500)
    + _WATER
    + """
, ok AS (SELECT *, row_number() OVER (ORDER BY candidate_id) AS rn FROM ctx WHERE elevation_ft < 4000 OR elevation_ft > 14000 OR slope_degrees > 60 OR water > 10)
SELECT candidate_id, elevation_ft, slope_degrees, round(water, 4) AS water_distance_miles FROM ok WHERE rn <= (SELECT CAST(floor(n * 0.3::DOUBLE) AS BIGINT) FROM np)
""",
)
def absence_unsuitable_habitat(spark: SparkSession, d: str) -> DataFrame:
    p, n = _presence(spark, d)
    out = absence.unsuitable_habitat(p, absence.targets(n)["unsuitable"], _context(spark, d))
    return rounded(out.select("candidate_id", "elevation_ft", "slope_degrees", "water_distance_miles"), ["water_distance_miles"], 4)


@query(
    "absence_background",
    "G7 G9",
    cte("obs")
    + _far(500)
    + f"""
, kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY candidate_id) AS rn FROM far) WHERE rn <= (SELECT CAST(floor(n * 0.2::DOUBLE) AS BIGINT) FROM np)),
rk AS (SELECT date, row_number() OVER (ORDER BY md5('42|metadata|' || obs_id)) AS rank FROM pr)
SELECT candidate_id, rk.date, year(rk.date) AS year, month(rk.date) AS month, dayofyear(rk.date) AS day_of_year,
  CASE WHEN month(rk.date) IN (12,1,2) THEN 'wi' WHEN month(rk.date) IN (3,4,5) THEN 'sp' WHEN month(rk.date) IN (6,7,8) THEN 'su' ELSE 'fa' END AS season
FROM kept, np, rk WHERE rk.rank = CAST(floor({_u(42, 'metadata_pick', 'candidate_id')} * n) AS BIGINT) + 1
""",
)
def absence_background(spark: SparkSession, d: str) -> DataFrame:
    p, n = _presence(spark, d)
    out = absence.with_presence_dates(absence.random_background(p, absence.targets(n)["background"]), p, "obs_id")
    return out.select("candidate_id", "date", "year", "month", "day_of_year", "season")


@query(
    "absence_opposite_season",
    "G8",
    cte("obs")
    + f"""
, pr AS (SELECT * FROM obs WHERE elk_present = 1),
s AS (SELECT *, row_number() OVER (ORDER BY md5('42|opposite|' || obs_id)) AS rn, {_u(42, 'opposite_month', 'obs_id')} AS u, month(date) AS m, year(date) AS y FROM pr),
w AS (SELECT *, list_extract([12, 1, 2], CAST(floor(u * 3) AS INT) + 1) AS wm, list_extract([6, 7, 8], CAST(floor(u * 3) AS INT) + 1) AS sm FROM s WHERE rn <= (SELECT CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT) FROM pr))
SELECT obs_id, date AS original_date, make_date(
  CASE WHEN m IN (6,7,8) THEN CASE WHEN wm = 12 THEN y ELSE y + 1 END WHEN m IN (12,1,2) THEN y ELSE y + CASE WHEN m > 6 THEN 1 ELSE 0 END END,
  CASE WHEN m IN (6,7,8) THEN wm WHEN m IN (12,1,2) THEN sm ELSE (m + 6) % 12 END, least(day(date), 28)) AS date FROM w
""",
)
def absence_opposite_season(spark: SparkSession, d: str) -> DataFrame:
    p, n = _presence(spark, d)
    return absence.opposite_season(p, absence.targets(n)["temporal"], "obs_id").select("obs_id", "original_date", "date")


@query(
    "strategy_mix",
    "G10",
    cte("obs")
    + """
, n AS (SELECT count(*) AS n FROM obs WHERE elk_present = 1), s(strategy, share) AS (VALUES ('environmental', 0.4), ('unsuitable', 0.3), ('background', 0.2), ('temporal', 0.1))
SELECT strategy, CAST(floor(n * share::DOUBLE) AS BIGINT) AS target, CAST(floor(n * share::DOUBLE) AS BIGINT) AS produced FROM s, n
""",
)
def strategy_mix(spark: SparkSession, d: str) -> DataFrame:
    """Rows wanted and drawn by each strategy of the whole mix."""
    p, n = _presence(spark, d)
    parts = absence.mix(p, n, "obs_id", _context(spark, d))
    counted = [df.agg(F.lit(k).alias("strategy"), F.lit(absence.targets(n)[k]).cast("bigint").alias("target"), F.count(F.lit(1)).alias("produced")) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), counted)


@query(
    "oversampling_factors",
    "G11",
    cte("obs")
    + """
, n AS (SELECT dataset, count(*) * times AS n, times FROM obs, (SELECT unnest([1, 20, 200])::BIGINT AS times) WHERE elk_present = 1 GROUP BY dataset, times),
s(strategy, share) AS (VALUES ('environmental', 0.4), ('unsuitable', 0.3), ('background', 0.2), ('temporal', 0.1)),
w AS (SELECT dataset, times, strategy, n, CAST(floor(n * share::DOUBLE) AS BIGINT) AS wanted FROM n, s),
f AS (SELECT *, CASE WHEN n > 50000 THEN greatest(3.0::DOUBLE, wanted / 5000.0::DOUBLE) WHEN n > 10000 THEN greatest(2.0::DOUBLE, wanted / 10000.0::DOUBLE) ELSE greatest(1.0::DOUBLE, wanted / 10000.0::DOUBLE) END AS factor FROM w)
SELECT dataset, times, strategy, wanted, round(factor, 6) AS factor, least(CAST(floor(factor * 10000) AS BIGINT), 1000000) AS attempts FROM f
""",
)
def oversampling_factors(spark: SparkSession, d: str) -> DataFrame:
    """Search effort of each dataset and strategy, for the table as it is and for 20 and 200 of it."""
    n = view(spark, d, "obs").filter("elk_present = 1").groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    sized = n.withColumn("times", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 20, 200)])))
    shares = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.lit(v).alias("share")) for k, v in absence.STRATEGY_SHARES.items()]))
    rows = F.col("rows") * F.col("times")
    wanted = sized.withColumn("s", shares).select("dataset", "times", "s.strategy", rows.alias("n"), F.floor(rows * F.col("s.share")).alias("wanted"))
    out = wanted.withColumn("o", absence.oversampling(F.col("n"), F.col("wanted")))
    return rounded(out.select("dataset", "times", "strategy", "wanted", "o.factor", "o.attempts"), ["factor"])


@query(
    "absence_assembly",
    "G12 U1 U4",
    cte("obs")
    + """
, n AS (SELECT count(*) AS n FROM obs WHERE elk_present = 1), s(absence_strategy, share) AS (VALUES ('environmental', 0.4), ('unsuitable', 0.3), ('background', 0.2), ('temporal', 0.1)),
pr AS (SELECT * FROM obs WHERE elk_present = 1),
t AS (SELECT obs_id, row_number() OVER (ORDER BY md5('42|opposite|' || obs_id)) AS r FROM pr)
SELECT NULL AS absence_strategy, 1 AS elk_present, count(*) AS n, CAST(sum(obs_id) AS BIGINT) AS key_sum FROM pr
UNION ALL SELECT absence_strategy, 0, CAST(floor(n * share::DOUBLE) AS BIGINT),
  CASE WHEN absence_strategy = 'temporal' THEN (SELECT CAST(sum(obs_id) AS BIGINT) FROM t WHERE r <= floor((SELECT n FROM n) * 0.1::DOUBLE)) END FROM s, n
""",
)
def absence_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Presence rows and the whole mix in one table, counted by strategy."""
    p, n = _presence(spark, d)
    parts = list(absence.mix(p, n, "obs_id", _context(spark, d)).values())
    table = absence.assemble(p, parts, ["obs_id", "candidate_id", "date"])
    return table.groupBy("absence_strategy", "elk_present").agg(F.count(F.lit(1)).alias("n"), F.sum("obs_id").alias("key_sum"))


@query(
    "separation_check",
    "A23",
    cte("obs")
    + f"""
, a AS (SELECT obs_id, latitude, longitude FROM obs WHERE elk_present = 0), p AS (SELECT latitude AS lat, longitude AS lon FROM obs WHERE elk_present = 1),
m AS (SELECT o.obs_id, nullif(least(min({HAV.format(f='f.', p='o.')}), 100.000001), 100.000001) * 1000 AS m FROM a o LEFT JOIN p f ON abs(f.lat - o.latitude) < 0.91 AND abs(f.lon - o.longitude) < 1.3 GROUP BY 1)
SELECT count(*) AS n_absence, round(avg(m), 3) AS mean_m, round(min(m), 3) AS min_m, round(quantile_cont(m, 0.5), 3) AS median_m,
  (SELECT count(*) FROM p) AS n_presence, round(count(*) / (SELECT count(*) FROM p), 6) AS class_ratio, avg(m) >= 1000 AS separated,
  count(*) / (SELECT count(*) FROM p) BETWEEN 0.5 AND 2 AS balanced FROM m
""",
)
def separation_check(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "obs").select("obs_id", "latitude", "longitude", "elk_present")
    out = absence.validate_separation(o.filter("elk_present = 1"), o.filter("elk_present = 0"))
    return rounded(rounded(out, ["class_ratio"]), ["mean_m", "min_m", "median_m"], 3)
