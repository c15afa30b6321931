"""Keys and names derived from row values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_key(lat: Column, lon: Column, date: Column, *params, digits: int = 4) -> Column:
    """Dedupe key over rounded location, date and request parameters."""
    fmt = f"%.{digits}f"
    extra = [p if isinstance(p, Column) else F.lit(str(p)) for p in params]
    return F.sha2(
        F.concat_ws("|", F.format_string(fmt, lat), F.format_string(fmt, lon), date.cast("string"), *extra), 256
    )


def dataset_from_file(stem: Column) -> Column:
    """Dataset name from a file stem such as ``combined_<name>_presence_absence``."""
    return F.regexp_replace(
        F.regexp_replace(stem, "^combined_", ""), "_(presence_absence|test)$", ""
    )


def title_case(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, "_", " "))
