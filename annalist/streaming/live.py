"""Running activity over a stream of commits or changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import clock


def _by_month(changes: DataFrame, late: str) -> DataFrame:
    """*changes* with ``month_at``, the start of their month, as event time. A month that begins more than *late*
    before the newest one is final: its state is dropped, and what comes for it afterwards is left out."""
    at = F.date_trunc("month", F.timestamp_seconds("timestamp"))
    return changes.withColumn("month_at", at).withWatermark("month_at", late)


def monthly_activity(changes: DataFrame, late: str = "62 days") -> DataFrame:
    """Changes and authors per month so far; one state row per month that is not final.

    Exact distinct counts do not exist in a running aggregate, so authors are approximate.
    """
    months = _by_month(changes, late).groupBy("month_at").agg(
        F.count("*").alias("changes"), F.approx_count_distinct("author").alias("authors")
    )
    return months.select(clock.month_of(F.unix_timestamp("month_at")).alias("month"), "changes", "authors")


def monthly_authors(changes: DataFrame, late: str = "62 days") -> DataFrame:
    """(month, author, changes) so far: the rows of a month are its authors, exactly."""
    pairs = _by_month(changes, late).groupBy("month_at", "author").agg(F.count("*").alias("changes"))
    return pairs.select(clock.month_of(F.unix_timestamp("month_at")).alias("month"), "author", "changes")


def daily_activity(changes: DataFrame, late: str = "7 days") -> DataFrame:
    """Changes per day; a day is final, and its state dropped, *late* after its end."""
    timed = changes.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    days = timed.groupBy(F.window("at", "1 day")).agg(F.count("*").alias("changes"))
    return days.select((F.unix_timestamp("window.start")).alias("day"), "changes")


def running_hotspots(changes: DataFrame, late: str = "62 days") -> DataFrame:
    """Changes per function and month so far; one state row per function of a month that is not final.

    Months add up to the whole count of a function, see :func:`total_hotspots`, so state does not grow with
    the functions that were ever changed.
    """
    spots = _by_month(changes, late).groupBy("month_at", "function_name", "file_path").agg(
        F.count("*").alias("change_count"), F.max("timestamp").alias("last_changed")
    )
    month = clock.month_of(F.unix_timestamp("month_at")).alias("month")
    return spots.select(month, "function_name", "file_path", "change_count", "last_changed")


def total_hotspots(written: DataFrame) -> DataFrame:
    """Changes per function from all rows that :func:`running_hotspots` wrote in update mode."""
    function = ["function_name", "file_path"]
    newest = written.groupBy("month", *function).agg(
        F.max("change_count").alias("change_count"), F.max("last_changed").alias("last_changed")
    )
    return newest.groupBy(*function).agg(
        F.sum("change_count").alias("change_count"), F.max("last_changed").alias("last_changed")
    )
