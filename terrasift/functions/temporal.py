"""Calendar expressions: seasons, cyclic day-of-year, rut calendar, date rebuilding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 365.25


def season_code(month: Column) -> Column:
    """wi / sp / su / fa for a month number (null month gives null)."""
    return (
        F.when(month.isin(12, 1, 2), "wi")
        .when(month.isin(3, 4, 5), "sp")
        .when(month.isin(6, 7, 8), "su")
        .when(month.isin(9, 10, 11), "fa")
    )


def season_name(month: Column) -> Column:
    return (
        F.when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "fall")
        .when(month.isNotNull(), "winter")
    )


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def day_of_year_cyclic(doy: Column) -> tuple[Column, Column]:
    """(sin, cos) of the day of year on a 365.25-day circle."""
    angle = F.lit(2.0) * F.pi() * doy / F.lit(YEAR_DAYS)
    return F.sin(angle), F.cos(angle)


def day_of_year_from_cyclic(sin_col: Column, cos_col: Column) -> Column:
    """Inverse of :func:`day_of_year_cyclic`, clamped to 1..366."""
    raw = F.atan2(sin_col, cos_col)
    angle = F.when(raw < 0, raw + 2 * F.pi()).otherwise(raw)
    doy = F.rint(angle * YEAR_DAYS / (2 * F.pi())).cast("int")
    return F.least(F.greatest(doy, F.lit(1)), F.lit(366))


def date_from_year_day(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def mid_month_date(year: Column, month: Column) -> Column:
    """The given month's date at half its length (day 15 in 30/31-day months)."""
    half = F.floor(days_in_month(year, month) / 2).cast("int")
    return F.make_date(year, month, half)


def date_from_cyclic(
    year: Column, month: Column, sin_col: Column, cos_col: Column, fallback_day: int | None = None
) -> Column:
    """Date from year plus cyclic day-of-year; the stated month wins on disagreement.

    ``fallback_day`` selects the fixed-day variant instead of the half-month day.
    """
    candidate = date_from_year_day(year, day_of_year_from_cyclic(sin_col, cos_col))
    if fallback_day is None:
        fallback = mid_month_date(year, month)
    else:
        fallback = F.make_date(year, month, F.lit(fallback_day))
    return F.when(F.month(candidate) == month, candidate).otherwise(fallback)


def rebuild_date(
    year: Column,
    month: Column,
    doy: Column | None = None,
    sin_col: Column | None = None,
    cos_col: Column | None = None,
) -> Column:
    """First available of: year+day-of-year, cyclic pair, middle of the month."""
    parts = []
    if doy is not None:
        parts.append(F.when(doy.between(1, 366), date_from_year_day(year, doy)))
    if sin_col is not None and cos_col is not None:
        parts.append(
            F.when(
                sin_col.isNotNull() & cos_col.isNotNull(),
                date_from_cyclic(year, month, sin_col, cos_col),
            )
        )
    parts.append(mid_month_date(year, month))
    return F.coalesce(*parts)


# Day count before each month in a 365-day year.
DAYS_BEFORE_MONTH = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


def encode_month_day(month: Column, day: Column | None = None) -> tuple[Column, Column]:
    """Cyclic pair for a month (and day, 15 by default) without leap days."""
    day = F.lit(15) if day is None else day
    before = F.element_at(F.array(*[F.lit(v) for v in DAYS_BEFORE_MONTH]), month.cast("int"))
    return day_of_year_cyclic((before + day).cast("double"))


def shift_months(date: Column, months: Column | int) -> Column:
    """Month offset that clamps to the end of shorter months."""
    return F.add_months(date, months)


def quarter_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Widen a date range to whole calendar quarters."""
    first = F.trunc(start, "quarter")
    last = F.last_day(F.add_months(F.trunc(end, "quarter"), 2))
    return first, last


def summer_year(date: Column) -> Column:
    """Year of the last complete summer: this year from September on, else the previous."""
    return F.when(F.month(date) >= 9, F.year(date)).otherwise(F.year(date) - 1)


def rut_phase(month: Column, day: Column) -> Column:
    """pre_rut, peak_rut, post_rut or null outside the rut."""
    return (
        F.when((month == 9) & (day < 15), "pre_rut")
        .when(month == 9, "peak_rut")
        .when((month == 10) & (day < 10), "peak_rut")
        .when(month == 10, "post_rut")
    )


RUT_START_DAY = 243


def days_since_rut_start(month: Column, doy: Column) -> Column:
    """Days since 1 September of a 365-day year, null before September."""
    return F.when(month >= 9, doy - RUT_START_DAY)


def parse_date(*candidates: Column) -> Column:
    """First candidate string that parses as a date in a known layout."""
    layouts = ["yyyy-MM-dd", "M/d/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy"]
    tries = []
    for c in candidates:
        text = F.trim(c.cast("string"))
        tries.append(F.to_date(F.try_to_timestamp(text)))
        for layout in layouts[1:]:
            tries.append(F.to_date(F.try_to_timestamp(text, F.lit(layout))))
    return F.coalesce(*tries)
