"""Moon phase, position and ground illumination as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Synodic month and reference new moon.
SYNODIC_DAYS = 29.53059
NEW_MOON = "2024-01-11"
NIGHT_HOURS = [20, 21, 22, 23, 0, 1, 2, 3, 4, 5]


def moon_phase(date: Column) -> Column:
    """Illuminated fraction 0..1 at midnight of ``date``."""
    days = F.datediff(date, F.to_date(F.lit(NEW_MOON))).cast("double")
    angle = F.pmod(days, F.lit(SYNODIC_DAYS)) / SYNODIC_DAYS * 2 * F.pi()
    return (1 - F.cos(angle)) / 2


def rough_altitude(date: Column) -> Column:
    """Altitude guess from phase alone (no ephemeris)."""
    return 45 * moon_phase(date) - 10


def moon_position(lat: Column, lon: Column, date: Column, hour: Column) -> tuple[Column, Column]:
    """(altitude, azimuth) in degrees from a truncated lunar series.

    Main perturbation terms of longitude and latitude only; good to about 0.3 degrees,
    parallax correction included.
    """
    d = F.datediff(date, F.to_date(F.lit("2000-01-01"))).cast("double") + hour / 24.0 - 0.5
    rad = F.radians

    def turn(base: float, rate: float) -> Column:
        return rad(F.pmod(F.lit(base) + rate * d, F.lit(360.0)))

    mean_lon = F.pmod(218.316 + 13.176396 * d, F.lit(360.0))
    anomaly = turn(134.963, 13.064993)
    node_arg = turn(93.272, 13.229350)
    elongation = turn(297.850, 12.190749)
    sun_anomaly = turn(357.529, 0.985600)
    ecl_lon = rad(
        mean_lon
        + 6.289 * F.sin(anomaly)
        + 1.274 * F.sin(2 * elongation - anomaly)
        + 0.658 * F.sin(2 * elongation)
        + 0.214 * F.sin(2 * anomaly)
        - 0.186 * F.sin(sun_anomaly)
    )
    ecl_lat = rad(
        5.128 * F.sin(node_arg)
        + 0.281 * F.sin(anomaly + node_arg)
        + 0.278 * F.sin(anomaly - node_arg)
    )
    tilt = rad(F.lit(23.4397))
    ra = F.atan2(
        F.sin(ecl_lon) * F.cos(tilt) - F.tan(ecl_lat) * F.sin(tilt),
        F.cos(ecl_lon),
    )
    dec = F.asin(
        F.sin(ecl_lat) * F.cos(tilt) + F.cos(ecl_lat) * F.sin(tilt) * F.sin(ecl_lon)
    )
    sidereal = rad(F.pmod(280.46062 + 360.98564737 * d + lon, F.lit(360.0)))
    h = sidereal - ra
    phi = rad(lat)
    sin_alt = F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(h)
    alt = F.asin(sin_alt)
    azimuth = F.atan2(
        F.sin(h), F.cos(h) * F.sin(phi) - F.tan(dec) * F.cos(phi)
    )
    parallax = rad(F.lit(0.9507)) * F.cos(alt)
    return F.degrees(alt - parallax), F.pmod(F.degrees(azimuth) + 180.0, F.lit(360.0))


def effective_illumination(phase: Column, altitude: Column) -> Column:
    """Phase times altitude factor times atmospheric extinction, clamped to 0..1."""
    s = F.sin(F.radians(F.least(altitude, F.lit(90.0))))
    above = F.greatest(altitude, F.lit(0.0))
    airmass = F.least(1 / (s + 0.50572 * F.pow(above + 6.07995, F.lit(-1.6364))), F.lit(10.0))
    raw = phase * s * F.exp(-0.1 * airmass)
    return F.when(altitude <= 0, F.lit(0.0)).otherwise(
        F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    )


def cloud_adjusted(effective: Column, cloud_percent: Column) -> Column:
    return effective * F.exp(-2.5 * cloud_percent / 100.0)


def _night_altitudes(df: DataFrame, lat: Column, lon: Column, date: Column) -> DataFrame:
    """Adds ``_alt``: moon altitude at each night hour.

    Each step of the ephemeris is one array column over the ten hours, so no step is
    copied into the next and generated code stays short.
    """
    base = F.datediff(date, F.to_date(F.lit("2000-01-01"))).cast("double")
    offsets = [h / 24.0 + (0.0 if h >= 12 else 1.0) - 0.5 for h in NIGHT_HOURS]
    rad = F.radians

    def turn(start: float, rate: float, d: Column) -> Column:
        return rad(F.pmod(F.lit(start) + rate * d, F.lit(360.0)))

    def arguments(d: Column) -> Column:
        return F.struct(
            d.alias("d"),
            F.pmod(218.316 + 13.176396 * d, F.lit(360.0)).alias("ml"),
            turn(134.963, 13.064993, d).alias("an"),
            turn(93.272, 13.229350, d).alias("nd"),
            turn(297.850, 12.190749, d).alias("el"),
            turn(357.529, 0.985600, d).alias("sn"),
        )

    def ecliptic(x: Column) -> Column:
        an, el = x["an"], x["el"]
        lo = rad(
            x["ml"] + 6.289 * F.sin(an) + 1.274 * F.sin(2 * el - an) + 0.658 * F.sin(2 * el)
            + 0.214 * F.sin(2 * an) - 0.186 * F.sin(x["sn"])
        )
        la = rad(5.128 * F.sin(x["nd"]) + 0.281 * F.sin(an + x["nd"]) + 0.278 * F.sin(an - x["nd"]))
        return F.struct(x["d"].alias("d"), lo.alias("lo"), la.alias("la"))

    tilt = rad(F.lit(23.4397))

    def equatorial(x: Column) -> Column:
        lo, la = x["lo"], x["la"]
        ra = F.atan2(F.sin(lo) * F.cos(tilt) - F.tan(la) * F.sin(tilt), F.cos(lo))
        dec = F.asin(F.sin(la) * F.cos(tilt) + F.cos(la) * F.sin(tilt) * F.sin(lo))
        hour_angle = rad(F.pmod(280.46062 + 360.98564737 * x["d"] + lon, F.lit(360.0))) - ra
        return F.struct(dec.alias("dec"), hour_angle.alias("h"))

    def altitude(x: Column) -> Column:
        phi = rad(lat)
        return F.asin(F.sin(phi) * F.sin(x["dec"]) + F.cos(phi) * F.cos(x["dec"]) * F.cos(x["h"]))

    steps = [
        F.transform(F.array(*[F.lit(o) for o in offsets]), lambda o: arguments(base + o)),
        F.transform("_alt", ecliptic),
        F.transform("_alt", equatorial),
        F.transform("_alt", altitude),
        F.transform("_alt", lambda a: F.degrees(a - rad(F.lit(0.9507)) * F.cos(a))),
    ]
    for step in steps:
        df = df.withColumn("_alt", step)
    return df


def with_night_features(
    df: DataFrame, lat: Column, lon: Column, date: Column, cloud_percent: Column | None = None, ephemeris: bool = True
) -> DataFrame:
    """Night-time moon features over 20:00-05:00 as columns.

    Hours after midnight belong to the following calendar day. Without ``ephemeris`` the
    altitude is the guess from phase alone.
    """
    phases = [moon_phase(date), moon_phase(F.date_add(date, 1))]
    df = df.withColumns({"_p0": phases[0], "_p1": phases[1]})
    if ephemeris:
        df = _night_altitudes(df, lat, lon, date)
        same_day = moon_position(lat, lon, date, F.lit(0.0))[0]
    else:
        guess = [45 * F.col("_p0" if h >= 12 else "_p1") - 10 for h in NIGHT_HOURS]
        df = df.withColumn("_alt", F.array(*guess))
        same_day = 45 * F.col("_p0") - 10
    n = len(NIGHT_HOURS)
    evening = sum(1 for h in NIGHT_HOURS if h >= 12)
    phase_at = lambda i: F.when(i < evening, F.col("_p0")).otherwise(F.col("_p1"))
    df = df.withColumn("_lum", F.transform("_alt", lambda a, i: effective_illumination(phase_at(i), a)))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) / n
    midnight = NIGHT_HOURS.index(0)
    new = {
        "moon_phase": F.col("_p0"),
        "moon_altitude_midnight": F.col("_alt")[midnight],
        "moon_altitude_mean": mean("_alt"),
        "moon_visible_hours": F.size(F.filter("_alt", lambda a: a > 0)),
        "effective_illumination_midnight": F.col("_lum")[midnight],
        "effective_illumination_mean": mean("_lum"),
    }
    if cloud_percent is not None:
        # clouds dim every hour alike, so the mean scales with the mean light
        df = df.withColumns({"_now": same_day, "_cloud": cloud_adjusted(F.lit(1.0), cloud_percent)})
        new["cloud_adjusted_illumination"] = effective_illumination(F.col("_p0"), F.col("_now")) * F.col("_cloud")
        new["cloud_adjusted_illumination_mean"] = mean("_lum") * F.col("_cloud")
    return df.withColumns(new).drop("_p0", "_p1", "_alt", "_lum", "_now", "_cloud")
