"""Changes between tagged commits, in (timestamp, hash) order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.plans.shapes import ordered_chunks, running_count, with_previous
from annalist.schema import History

_COUNTS = ["added", "modified", "deleted", "total", "files_touched", "authors"]


def _collapse(changes: DataFrame, *keys: str) -> DataFrame:
    """Counts per release; changes collapse to (file, author) before the distinct counts."""
    def of(kind: str) -> F.Column:
        return F.count_if(F.col("change_type") == kind).alias(kind)

    pairs = changes.groupBy(*keys, "file_path", "author").agg(
        of("added"), of("modified"), of("deleted"), F.count("*").alias("total")
    )
    return pairs.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS[:4]],
        F.count_distinct("file_path").alias("files_touched"),
        F.count_distinct("author").alias("authors"),
    )


def release_summary(h: History, until_hash: str, since_hash: str | None = None) -> DataFrame:
    """One row about the commits after *since_hash*, up to and with *until_hash*.

    Zeros if either commit is unknown; without *since_hash*, everything before counts.
    """
    at = F.struct("timestamp", "hash")
    bounds = h.commits.agg(
        F.max(F.when(F.col("hash") == until_hash, at)).alias("high"),
        *([F.max(F.when(F.col("hash") == since_hash, at)).alias("low")] if since_hash else []),
    )
    inside = at <= F.col("high")
    if since_hash:
        inside = inside & (at > F.col("low"))
    commits = h.commits.join(F.broadcast(bounds)).filter(inside)  # bounds: one row
    hashes = commits.select(F.col("hash").alias("commit_hash"))
    return _collapse(h.function_changes.join(hashes, "commit_hash", "left_semi"))


def releases(h: History) -> DataFrame:
    """Every tag with the summary of the commits since the tag before it.

    Tagged commits cut the commit order into segments; one ordered pass numbers the
    segment of every commit. A tag then covers the segments after the previous tag's
    commit up to its own: one segment if tag times and commit times agree, several or
    none if they do not. A tag whose commit is unknown, and the tag after it, cover none.
    """
    marked = h.tags.select("hash").distinct().withColumn("tagged", F.lit(1))
    order = ordered_chunks(
        h.commits.select("hash", "timestamp").join(marked, "hash", "left"), "timestamp", "hash"
    )
    placed = running_count(order, F.coalesce("tagged", F.lit(0)), "segment")
    points = placed.filter("tagged = 1").select("hash", "segment")

    chain = with_previous(ordered_chunks(h.tags, "timestamp", "name"), "hash", "previous")
    covered = (
        chain.join(points.withColumnRenamed("segment", "high"), "hash")
        .join(
            points.select(F.col("hash").alias("previous"), F.col("segment").alias("low")),
            "previous",
            "left",
        )
        .filter(F.col("previous").isNull() | F.col("low").isNotNull())
        .withColumn("low", F.coalesce(F.col("low") + 1, F.lit(0)))
        .filter("low <= high")
        .select("name", F.explode(F.sequence("low", "high")).alias("segment"))
    )
    of_commit = placed.select(F.col("hash").alias("commit_hash"), "segment")
    # commits meet the segments first: a release with most of the changes is no key of theirs
    of_release = of_commit.join(covered, "segment").select("commit_hash", "name")
    changes = h.function_changes.join(of_release, "commit_hash")
    counted = _collapse(changes, "name")
    return (
        h.tags.join(counted, "name", "left")
        .select(
            "name", "hash", "timestamp",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS],
        )
        .orderBy("timestamp", "name")
    )
