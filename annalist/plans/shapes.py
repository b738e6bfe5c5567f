"""Top-k and ordered chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.session import cut


def top(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """Ordered, and cut to *limit* rows if one is given (a top-k, no full sort)."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def window(df: DataFrame, ts: Column, since: int | None, until: int | None) -> DataFrame:
    """Rows with ``since <= ts <= until``; either end may be open."""
    if since is not None:
        df = df.filter(ts >= since)
    if until is not None:
        df = df.filter(ts <= until)
    return df


@dataclass(frozen=True)
class Chunked:
    """Rows cut into consecutive ranges of ``order``; ``chunk`` numbers the ranges."""

    rows: DataFrame
    order: tuple[str, ...]


def ordered_chunks(df: DataFrame, *order: str) -> Chunked:
    """*df* with ``chunk``: consecutive ranges of *order*, of even size.

    Range bounds come from a sample, so they split runs of equal leading keys as long
    as the last key differs. The result is materialised: the bounds would otherwise be
    drawn anew by every branch that reads it. Work that needs the whole order (running
    sums, the row before) is done inside a chunk, and one row per chunk carries the
    state across, so no task ever sorts everything.
    """
    ranged = df.repartitionByRange(*order)
    return Chunked(cut(ranged.withColumn("chunk", F.spark_partition_id())), order)


def running_count(chunked: Chunked, amount: Column, name: str, *keys: str) -> DataFrame:
    """The rows with *name*: the sum of *amount* over all rows before, among equal *keys*."""
    rows = chunked.rows.withColumn("amount", amount.cast("bigint"))
    inside = (
        Window.partitionBy("chunk", *keys)
        .orderBy(*chunked.order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    over_chunks = (
        Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy("chunk", *keys)
        .agg(F.sum("amount").alias("amount"))
        .select("chunk", *keys, F.sum("amount").over(over_chunks).alias("carried"))
    )
    zero = F.lit(0)
    return (
        rows.withColumn("inside", F.sum("amount").over(inside))
        .join(carried, ["chunk", *keys])
        .withColumn(name, F.coalesce("carried", zero) + F.coalesce("inside", zero))
        .drop("chunk", "amount", "inside", "carried")
    )


def with_previous(chunked: Chunked, column: str, name: str) -> DataFrame:
    """The rows with *name*: the value of *column* in the row before, NULL for the first."""
    inside = Window.partitionBy("chunk").orderBy(*chunked.order)
    last = chunked.rows.groupBy("chunk").agg(
        F.max_by(column, F.struct(*chunked.order)).alias("last")
    )
    carried = last.select("chunk", F.lag("last").over(Window.orderBy("chunk")).alias("carried"))
    first = F.row_number().over(inside) == 1
    return (
        chunked.rows.withColumn("inside", F.lag(column).over(inside))
        .withColumn("first", first)
        .join(carried, "chunk")
        .withColumn(name, F.when(F.col("first"), F.col("carried")).otherwise(F.col("inside")))
        .drop("chunk", "inside", "first", "carried")
    )
