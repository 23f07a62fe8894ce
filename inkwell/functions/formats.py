"""Scalar formatting helpers; all JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output formats of the read queries (fixed values).
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
DAY = "yyyy-MM-dd"
NO_DATA = "No data"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_seconds(c: str | Column) -> Column:
    """``FORMAT_TIMESTAMP('%Y-%m-%dT%H:%M:%SZ', ts)`` in a UTC session."""
    return F.date_format(col_of(c), ISO_SECONDS)


def iso_micros(c: str | Column) -> Column:
    """Lossless ISO text of a timestamp (for served tables and comparisons)."""
    return F.date_format(col_of(c), ISO_MICROS)


def iso_day(c: str | Column) -> Column:
    """``FORMAT_DATE('%Y-%m-%d', d)``."""
    return F.date_format(col_of(c), DAY)


def lag_minutes(later: str | Column, earlier: str | Column) -> Column:
    """Whole minutes from ``earlier`` to ``later``, truncated toward zero.

    Matches ``TIMESTAMP_DIFF(later, earlier, MINUTE)``.
    """
    return F.timestamp_diff("MINUTE", col_of(earlier), col_of(later))


def thousands(c: str | Column) -> Column:
    """Integer with thousands separators, like Python's ``f"{n:,}"``."""
    return F.format_number(col_of(c).cast("long"), 0)


def minutes_label(c: str | Column) -> Column:
    """``"N min"``, or ``No data`` for a null lag."""
    c = col_of(c)
    return F.when(c.isNull(), F.lit(NO_DATA)).otherwise(F.concat(c.cast("string"), F.lit(" min")))


def joined(c: str | Column, sep: str = "|") -> Column:
    """Array as one string, elements in their stored order."""
    return F.array_join(col_of(c), sep)


def plain_types(df):
    """Served form of a table: timestamps as ISO text with microseconds,
    dates as ``yyyy-MM-dd``, string arrays joined by ``|``. Used where a
    table leaves Spark (exports, cross-engine comparison)."""
    from pyspark.sql.types import ArrayType, DateType, TimestampNTZType, TimestampType

    cols = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            c = iso_micros(c)
        elif isinstance(field.dataType, DateType):
            c = iso_day(c)
        elif isinstance(field.dataType, ArrayType):
            c = joined(c)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def utc_literal(value):
    """A Python datetime as a UTC timestamp literal (naive means UTC).

    Goes through text so that the Python process's local zone never applies.
    """
    from datetime import UTC

    if value.tzinfo is not None:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
