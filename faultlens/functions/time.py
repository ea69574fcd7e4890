"""Timestamp <-> epoch-nanosecond helpers that do not depend on the
session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultlens.functions.numeric import floor_div

NS_PER_US = 1_000
NS_PER_SEC = 1_000_000_000
NS_PER_MIN = 60 * NS_PER_SEC
NS_PER_HOUR = 60 * NS_PER_MIN
NS_PER_DAY = 24 * NS_PER_HOUR

# Fixed value: display offset for local wall-clock text (UTC+8).
LOCAL_OFFSET_HOURS = 8


def _epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def epoch_ns(c: Column, dtype: T.DataType | None = None) -> Column:
    """Epoch nanoseconds of a timestamp column.

    A naive (``TIMESTAMP_NTZ``) value is read as UTC wall clock, so the result
    does not move with ``spark.sql.session.timeZone``.
    """
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c) * NS_PER_US
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), c) * NS_PER_US


def ns_to_ntz(c: Column) -> Column:
    """Epoch nanoseconds -> naive timestamp (UTC wall clock)."""
    return F.timestamp_add("MICROSECOND", floor_div(c, NS_PER_US), _epoch_ntz())


def local_time(c: Column, offset_hours: int = LOCAL_OFFSET_HOURS) -> Column:
    """Epoch ns -> naive local timestamp (UTC + offset)."""
    return ns_to_ntz(c + F.lit(offset_hours * NS_PER_HOUR))
