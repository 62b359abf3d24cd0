"""Time buckets aligned like ``time_bucket`` and bucket-size parsing."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2000-01-03, the Monday that wide buckets are aligned to, in seconds since 1970.
ORIGIN_SECONDS = 10_959 * 86_400

_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3_600, "d": 86_400}


def resolution_seconds(resolution: str) -> int:
    """``5m``, ``1h``, ``7d`` -> seconds. Text without a unit suffix means 1 hour."""
    text = resolution.strip().lower()
    if not text or text[-1] not in "mhd":
        return 3_600
    if not re.fullmatch(r"[1-9]\d*", text[:-1]):
        raise ValueError(f"bad resolution {resolution!r}")
    return int(text[:-1]) * _UNIT_SECONDS[text[-1]]


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket ``ts`` falls in.

    ``window`` aligns to 1970-01-01; the start offset moves it to 2000-01-03,
    which matters for widths that do not divide the distance (2 d, 7 d, 7 min).
    """
    width = f"{seconds} seconds"
    return F.window(ts, width, width, f"{ORIGIN_SECONDS % seconds} seconds")


def bucket_start(ts: Column, seconds: int) -> Column:
    """``bucket`` as plain arithmetic, for use outside a grouping."""
    offset = ORIGIN_SECONDS % seconds
    return F.timestamp_seconds(
        F.floor((F.unix_seconds(ts) - F.lit(offset)) / F.lit(seconds)) * F.lit(seconds)
        + F.lit(offset)
    )


def literal_ts(value: dt.datetime | str) -> Column:
    """A UTC instant as a literal, so range filters reach the Parquet scan."""
    if isinstance(value, str):
        value = parse_iso(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.UTC)
    return F.lit(value)


def parse_iso(text: str) -> dt.datetime:
    """ISO-8601 text, with ``Z`` or an offset, as an aware UTC time."""
    value = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.UTC)
    return value.astimezone(dt.UTC)


def latest_time(df: DataFrame, column: str = "event_time") -> dt.datetime:
    """Newest event time, the default for every ``as_of`` (one-row result).

    On a table with an ``event_date`` only the last day's times are read.
    """
    if "event_date" in df.columns and column == "event_time":
        day = df.agg(F.max("event_date")).first()[0]
        if day is not None:
            df = df.filter(F.col("event_date") == F.lit(day))
    micros = df.agg(F.unix_micros(F.max(column))).first()[0]
    if micros is None:
        return dt.datetime.now(dt.UTC)
    return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=micros)


def time_range(
    df: DataFrame,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    column: str = "event_time",
    start_open: bool = False,
    end_open: bool = False,
) -> DataFrame:
    """Keep rows with ``start <= time <= end`` (either bound may be open).

    On a table partitioned by ``event_date`` the same range is also stated on
    the date, because a date column stored beside the time is not pruned from a
    predicate on the time alone.
    """
    has_date = "event_date" in df.columns and column == "event_time"
    if start is not None:
        bound = literal_ts(start)
        df = df.filter(F.col(column) > bound if start_open else F.col(column) >= bound)
        if has_date:
            df = df.filter(F.col("event_date") >= F.lit(start.astimezone(dt.UTC).date()))
    if end is not None:
        bound = literal_ts(end)
        df = df.filter(F.col(column) < bound if end_open else F.col(column) <= bound)
        if has_date:
            df = df.filter(F.col("event_date") <= F.lit(end.astimezone(dt.UTC).date()))
    return df
