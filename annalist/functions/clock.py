"""Time: epoch seconds in, UTC months and days out, whatever the session time zone."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
# Seconds per unit of a relative date.
UNIT_SECONDS = {"d": DAY, "m": 30 * DAY, "y": 365 * DAY}


def parse_date_filter(value: str, as_of: int) -> int:
    """``30d`` / ``6m`` / ``1y`` before *as_of*, or an ISO date, as epoch seconds."""
    text = value.strip()
    relative = re.fullmatch(r"(\d+)([dmy])", text)
    if relative:
        return as_of - int(relative[1]) * UNIT_SECONDS[relative[2]]
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"neither an ISO date nor a span such as 30d, 6m, 1y: {value!r}") from None
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return int(moment.timestamp())


def date_filter(value: Column, as_of: int) -> Column:
    """Column form of :func:`parse_date_filter` for a table of filters."""
    text = F.trim(value)
    pattern = r"^(\d+)([dmy])$"
    amount = F.regexp_extract(text, pattern, 1).cast("bigint")
    unit = F.regexp_extract(text, pattern, 2)
    seconds = F.when(unit == "d", UNIT_SECONDS["d"]).when(unit == "m", UNIT_SECONDS["m"])
    relative = F.lit(as_of) - amount * seconds.otherwise(UNIT_SECONDS["y"])
    zoned = text.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    full = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")
    moment = F.when(zoned, full).otherwise(F.concat(full, F.lit("Z"))).try_cast("timestamp")
    return (
        F.when(text.rlike(pattern), relative)
        .when(
            text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"),
            F.unix_seconds(moment),
        )
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_date(text.try_cast("date")) * DAY)
        .otherwise(F.raise_error(F.concat(F.lit("not a date filter: "), value)).cast("bigint"))
        .cast("bigint")
    )


def utc_date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts / DAY).cast("int"))


def month_of(ts: Column) -> Column:
    """UTC ``yyyy-MM``."""
    return F.date_format(utc_date(ts), "yyyy-MM")


def known(ts: Column) -> Column:
    """A stored 0 means that the time is not known."""
    return F.nullif(ts, F.lit(0))


def months_back(as_of: int, months: int) -> int:
    return as_of - months * UNIT_SECONDS["m"]
