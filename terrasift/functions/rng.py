"""Reproducible per-row draws that do not depend on partitioning.

``rand(seed)`` changes with the number of partitions and on task retry order, so
every sampling operator derives its uniforms from a hash of the row's own key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int, stream: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in keys]))


def hash_int(seed: int, stream: str, *keys: Column) -> Column:
    """Unsigned 52-bit integer as bigint; every value is exact as a double."""
    return F.conv(F.substring(hash_hex(seed, stream, *keys), 1, 13), 16, 10).cast("bigint")


def hash_uniform(seed: int, stream: str, *keys: Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(seed, stream, *keys) / F.lit(4503599627370496.0)
