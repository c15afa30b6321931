"""SQL twin of the habitat factors, shared by several checks."""

# Expects a relation ``x`` with the observation columns, ``date`` and ``as_of``.
FACTOR_CTES = """
x0 AS (SELECT *, month(date) AS m, day(date) AS dd FROM x),
bands(m, lo, hi, mn, mx) AS (VALUES (1,6500,7500,6000,8000),(2,6500,7500,6000,8000),(3,7000,8000,6500,8500),
 (4,7500,8500,7000,9000),(5,8000,9000,7500,9500),(6,9500,10500,9000,11000),(7,9500,10500,9000,11000),(8,9500,10500,9000,11000),
 (9,9000,10000,8500,10500),(10,8500,9500,8000,10000),(11,8000,9000,7500,9500),(12,7000,8000,6500,8500)),
x1 AS (SELECT x0.*,
  CASE WHEN x0.m=9 AND dd<15 THEN 'pre_rut' WHEN x0.m=9 THEN 'peak_rut' WHEN x0.m=10 AND dd<10 THEN 'peak_rut'
       WHEN x0.m=10 THEN 'post_rut' END AS phase,
  CASE WHEN x0.m IN (3,4,5) THEN 'spring' WHEN x0.m IN (6,7,8) THEN 'summer' WHEN x0.m IN (9,10,11) THEN 'fall' ELSE 'winter' END AS season,
  CASE WHEN x0.m=9 OR (x0.m=10 AND dd<10) THEN greatest(lo,9000) ELSE lo END AS lo,
  CASE WHEN x0.m=9 OR (x0.m=10 AND dd<10) THEN greatest(hi,10000) ELSE hi END AS hi,
  CASE WHEN x0.m=9 OR (x0.m=10 AND dd<10) THEN greatest(mn,8500) ELSE mn END AS mn,
  CASE WHEN x0.m=9 OR (x0.m=10 AND dd<10) THEN greatest(mx,10500) ELSE mx END AS mx,
  CASE WHEN strftime(date, '%m-%d') BETWEEN '09-01' AND '09-30' OR strftime(date, '%m-%d') BETWEEN '10-01' AND '11-14' THEN true ELSE false END AS hunt,
  least(road_distance_miles, CASE WHEN trail_distance_miles = 0 THEN road_distance_miles ELSE trail_distance_miles END) AS acc,
  (slope_degrees > 40 OR canopy_cover_percent > 70 OR (road_distance_miles > 2.5 AND trail_distance_miles > 1.5)) AS secure,
  (9 + (summer_integrated_ndvi - 45) * 0.2) * (1 - 0.3 * 0.15) AS fat
  FROM x0 JOIN bands b ON b.m = x0.m),
x2 AS (SELECT *,
  CASE season WHEN 'spring' THEN 0.3 WHEN 'summer' THEN 0.5 WHEN 'fall' THEN 0.3 ELSE 0.2 END AS n1,
  CASE season WHEN 'spring' THEN 0.5 WHEN 'summer' THEN 0.7 WHEN 'fall' THEN 0.5 ELSE 0.3 END AS n2,
  CASE season WHEN 'spring' THEN 0.7 WHEN 'summer' THEN 0.85 WHEN 'fall' THEN 0.65 ELSE 0.4 END AS n3,
  CASE WHEN elevation_ft < mn THEN greatest(0, 7 - (mn - elevation_ft)/1000*5) ELSE greatest(0, 7 - (elevation_ft - mx)/1000*5) END AS e_out,
  greatest(0, 3 - (snow_depth_inches - 30)/10) AS s_out,
  greatest(0, 3 - (water_distance_miles - 2)) AS w_out,
  CASE WHEN security_habitat_percent >= 40 THEN 10 WHEN security_habitat_percent >= 30 THEN 7 + (security_habitat_percent-30)/10*3
       WHEN security_habitat_percent >= 20 THEN 4 + (security_habitat_percent-20)/10*3
       ELSE greatest(1, 4*(security_habitat_percent/20)) END AS sec0,
  CASE WHEN security_habitat_percent >= 40 THEN 'excellent' WHEN security_habitat_percent >= 30 THEN 'good'
       WHEN security_habitat_percent >= 20 THEN 'fair' ELSE 'poor' END AS sec_st,
  5 + (acc - 0.5) * 5 AS h_mid,
  7 - CASE WHEN wolves_per_1000_elk > 5 THEN least(3, (wolves_per_1000_elk - 5)*0.3) WHEN wolves_per_1000_elk > 2.5 THEN 0.5 ELSE 0 END
    - CASE WHEN snow_depth_inches BETWEEN 12 AND 18 THEN 1.5 ELSE 0 END
    - CASE WHEN m IN (5,6) AND bear_activity_distance_miles < 3 THEN 2*(1 - bear_activity_distance_miles/3) ELSE 0 END AS p0,
  least(2.5, CASE WHEN canopy_cover_percent BETWEEN 30 AND 60 THEN 0.8 ELSE 0 END
    + CASE WHEN elevation_ft > 8500 AND slope_degrees BETWEEN 15 AND 35 THEN 0.6 ELSE 0 END) AS terrain
  FROM x1),
x3 AS (SELECT *,
  CASE WHEN ndvi >= n3 THEN 10 WHEN ndvi >= n2 THEN 7 + (ndvi-n2)/(n3-n2)*3 WHEN ndvi >= n1 THEN 4 + (ndvi-n1)/(n2-n1)*3
       WHEN ndvi IS NOT NULL THEN greatest(0, 4*(ndvi/n1)) END AS v0,
  CASE WHEN secure THEN least(10, sec0*1.1) ELSE sec0 END AS sec1,
  CASE WHEN security_habitat_percent > 40 THEN least(10, p0 + 1) ELSE p0 END AS p1,
  CASE WHEN hunt THEN (CASE WHEN acc >= 1.5 THEN 10 WHEN acc >= 0.5 THEN h_mid ELSE greatest(1, 5*(acc/0.5)) END)
        * (CASE WHEN phase = 'peak_rut' AND acc >= 0.5 THEN 1.05 ELSE 1 END)
        * (CASE WHEN security_habitat_percent < 30 THEN 0.8 ELSE 1 END)
        * (CASE WHEN isodow(date) >= 6 THEN 0.85 ELSE 1 END)
       ELSE CASE WHEN acc >= 0.5 THEN 9 ELSE 7 END END AS hunting_s,
  CASE WHEN phase = 'peak_rut' THEN 1.0 WHEN phase = 'pre_rut' THEN 0.7 ELSE 0.5 END AS strength
  FROM x2),
x4 AS (SELECT *,
  CASE WHEN ndvi IS NULL THEN NULL WHEN season='spring' AND irg > 0.01 THEN least(10, v0*1.15)
       WHEN season='fall' AND irg < -0.01 THEN v0*0.9 ELSE v0 END AS v1,
  CASE WHEN phase='peak_rut' THEN least(10, sec1*1.2) WHEN phase='pre_rut' THEN least(10, sec1*1.15) ELSE sec1 END AS security_s
  FROM x3),
scored AS (SELECT *,
  CAST(CASE WHEN elevation_ft BETWEEN lo AND hi THEN 10
       WHEN elevation_ft BETWEEN mn AND mx THEN 10 - 3*(CASE WHEN elevation_ft < lo THEN (lo-elevation_ft)/(lo-mn) ELSE (elevation_ft-hi)/(mx-hi) END)
       ELSE e_out END AS DOUBLE) AS elevation_s,
  CASE WHEN elevation_ft BETWEEN lo AND hi THEN 'excellent' WHEN elevation_ft BETWEEN mn AND mx THEN 'good'
       WHEN e_out > 3 THEN 'poor' ELSE 'critical' END AS elevation_st,
  CAST((CASE WHEN snow_depth_inches <= 6 THEN 10 WHEN snow_depth_inches <= 18 THEN 10 - (snow_depth_inches-6)/12*3
       WHEN snow_depth_inches <= 30 THEN 7 - (snow_depth_inches-18)/12*4 ELSE s_out END)
     * (CASE WHEN snow_crust_detected AND snow_depth_inches > 6 THEN 0.7 ELSE 1 END) AS DOUBLE) AS snow_s,
  CASE WHEN snow_depth_inches <= 6 THEN 'excellent' WHEN snow_depth_inches <= 18 THEN 'good' WHEN snow_depth_inches <= 30 THEN 'fair'
       WHEN s_out > 1 THEN 'poor' ELSE 'critical' END AS snow_st,
  CAST(CASE WHEN date - as_of <= 3 THEN 0.90 WHEN date - as_of <= 7 THEN 0.75 ELSE 0.60 END AS DOUBLE) AS snow_c,
  CAST((CASE WHEN water_distance_miles <= 0.25 THEN 10 WHEN water_distance_miles <= 1 THEN 10 - (water_distance_miles-0.25)/0.75*3
       WHEN water_distance_miles <= 2 THEN 7 - (water_distance_miles-1)*4 ELSE w_out END) * water_reliability AS DOUBLE) AS water_s,
  CASE WHEN water_distance_miles <= 0.25 THEN 'excellent' WHEN water_distance_miles <= 1 THEN 'good' WHEN water_distance_miles <= 2 THEN 'fair'
       WHEN w_out > 1 THEN 'poor' ELSE 'critical' END AS water_st,
  CAST(CASE WHEN water_reliability > 0.8 THEN 0.85 ELSE 0.70 END AS DOUBLE) AS water_c,
  CAST(CASE WHEN precip_last_7_days_inches > 0.5 AND season <> 'winter' AND v1 IS NOT NULL THEN least(10, v1*1.1) ELSE v1 END AS DOUBLE) AS vegetation_s,
  CASE WHEN ndvi >= n3 THEN 'excellent' WHEN ndvi >= n2 THEN 'good' WHEN ndvi >= n1 THEN 'fair' WHEN ndvi IS NOT NULL THEN 'poor' END AS vegetation_st,
  CAST(greatest(0.5, 0.85 - CASE WHEN cloud_cover_percent > 30 THEN 0.15 ELSE 0 END - CASE WHEN ndvi_age_days > 16 THEN 0.10 ELSE 0 END) AS DOUBLE) AS vegetation_c,
  CASE WHEN hunt THEN CASE WHEN acc >= 1.5 THEN 'excellent' WHEN acc >= 0.5 THEN CASE WHEN h_mid > 7 THEN 'good' ELSE 'fair' END ELSE 'poor' END
       ELSE CASE WHEN acc >= 0.5 THEN 'good' ELSE 'fair' END END AS hunting_st,
  CASE WHEN phase IN ('pre_rut','peak_rut') AND security_s >= 9 THEN 'excellent'
       WHEN phase IN ('pre_rut','peak_rut') AND security_s >= 7 AND sec_st IN ('fair','poor') THEN 'good' ELSE sec_st END AS security_st,
  CAST(greatest(0, least(10, p1)) AS DOUBLE) AS predation_s,
  CASE WHEN p1 >= 8 THEN 'excellent' WHEN p1 >= 6 THEN 'good' WHEN p1 >= 4 THEN 'fair' ELSE 'poor' END AS predation_st,
  CAST(CASE WHEN fat >= 13.7 THEN 10 WHEN fat >= 11 THEN 7 + (fat-11)/(13.7-11)*3 WHEN fat >= 7.9 THEN 4 + (fat-7.9)/(11-7.9)*3
       ELSE greatest(1, 4*(fat/7.9)) END AS DOUBLE) AS nutrition_s,
  CASE WHEN fat >= 13.7 THEN 'excellent' WHEN fat >= 11 THEN 'good' WHEN fat >= 7.9 THEN 'fair' ELSE 'poor' END AS nutrition_st,
  CAST(CASE WHEN m IN (9,10,11) THEN 0.75 WHEN m IN (12,1,2,3) THEN 0.80 ELSE 0.60 END AS DOUBLE) AS nutrition_c,
  CAST(CASE WHEN wsi < 2000 THEN 10 WHEN wsi < 4000 THEN 10 - (wsi-2000)/2000*3 WHEN wsi < 6000 THEN 7 - (wsi-4000)/2000*4
       ELSE greatest(0, 3 - (wsi-6000)/2000*3) END AS DOUBLE) AS winter_s,
  CASE WHEN wsi < 2000 THEN 'excellent' WHEN wsi < 4000 THEN 'good' WHEN wsi < 6000 THEN 'fair'
       WHEN greatest(0, 3 - (wsi-6000)/2000*3) > 1 THEN 'poor' ELSE 'critical' END AS winter_st,
  CAST(CASE WHEN m IN (11,12,1,2,3,4) THEN 0.80 ELSE 0.95 END AS DOUBLE) AS winter_c,
  CAST(CASE WHEN phase IS NULL THEN 7 ELSE greatest(0, least(10, 7 + terrain*strength
     + CASE WHEN elevation_ft BETWEEN 8500 AND 10000 THEN CASE WHEN phase='peak_rut' THEN 0.5 ELSE 0.3 END
            WHEN elevation_ft BETWEEN 8000 AND 10500 THEN CASE WHEN phase='peak_rut' THEN 0.2 ELSE 0.1 END ELSE 0 END
     + CASE WHEN security_habitat_percent >= 40 THEN CASE WHEN phase='peak_rut' THEN 0.6 ELSE 0.4 END
            WHEN security_habitat_percent >= 30 THEN CASE WHEN phase='peak_rut' THEN 0.3 ELSE 0.2 END ELSE 0 END)) END AS DOUBLE) AS rut_s,
  CAST(CASE WHEN phase IS NULL THEN 0.9 ELSE 0.85 END AS DOUBLE) AS rut_c
  FROM x4)
"""

SHORT = [
    "elevation", "snow", "water", "vegetation", "hunting",
    "security", "predation", "nutrition", "winter", "rut",
]
FACTOR_NAMES = [
    "elevation", "snow_conditions", "water_distance", "vegetation_quality", "hunting_pressure",
    "security_habitat", "predation_risk", "nutritional_condition", "winter_severity", "rut_behavior",
]
CONFIDENCE = {
    "elevation": "0.95", "snow": "snow_c", "water": "water_c", "vegetation": "vegetation_c", "hunting": "0.80",
    "security": "0.85", "predation": "0.65", "nutrition": "nutrition_c", "winter": "winter_c", "rut": "rut_c",
}

RUT_STATUS = (
    "CASE WHEN phase IS NULL THEN 'good' WHEN rut_s >= 9 THEN 'excellent' WHEN rut_s >= 7 THEN 'good'"
    " WHEN rut_s >= 5 THEN 'fair' WHEN rut_s >= 3 THEN 'poor' ELSE 'critical' END"
)

# Long form (obs_id, date, factor, ordinal, score, confidence, status) plus totals.
LONG_CTES = (
    "long AS ("
    + " UNION ALL ".join(
        f"SELECT obs_id, date, latitude, longitude, '{n}' AS factor, {i} AS ordinal, CAST({s}_s AS DOUBLE) AS score,"
        f" CAST({CONFIDENCE[s]} AS DOUBLE) AS confidence, {RUT_STATUS if s == 'rut' else s + '_st'} AS status FROM scored"
        for i, (s, n) in enumerate(zip(SHORT, FACTOR_NAMES))
    )
    + """),
totals AS (SELECT obs_id, date, latitude, longitude, CASE WHEN count(score) = 10 THEN sum(score) END AS total_score,
  CASE WHEN count(score) = 10 THEN 100 * exp(sum(CASE WHEN score > 0 THEN ln(score / 10) / 10 ELSE -1e300 END)) END AS product_score,
  sum(confidence) / 10 AS overall_confidence,
  arg_min(factor, ordinal) FILTER (is_low) AS limiting_factor, arg_min(factor, ordinal) FILTER (is_high) AS best_factor
  FROM (SELECT *, score IS NOT DISTINCT FROM lo_score AS is_low, score IS NOT DISTINCT FROM hi_score AS is_high FROM
    (SELECT *, min(score) OVER (PARTITION BY obs_id, date) AS lo_score, max(score) OVER (PARTITION BY obs_id, date) AS hi_score FROM long))
  GROUP BY obs_id, date, latitude, longitude)
"""
)
