"""Timestamps that come in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def created_micros(c: str | Column) -> Column:
    """Microseconds since the epoch of a time as text, null where it cannot be read.

    Read are the feed's own notation (``Sun Oct 01 01:17:39 +0000 2017``), ISO 8601 with a zone or
    without (then the session's), and seconds or milliseconds since the epoch.
    """
    x = F.trim(F.col(c) if isinstance(c, str) else c)
    number = x.try_cast("bigint")
    feed = F.try_to_timestamp(F.regexp_extract(x, r"^\w{3} (\w{3} \d{2} \d{2}:\d{2}:\d{2} [+-]\d{4} \d{4})$", 1), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return (
        F.when(x.rlike(r"^\d{13}$"), number * 1000)
        .when(x.rlike(r"^\d{1,11}$"), number * 1_000_000)
        .when(x.rlike(r"^\d{4}-\d\d-\d\d"), F.unix_micros(x.try_cast("timestamp")))
        .otherwise(F.unix_micros(feed))
    )
