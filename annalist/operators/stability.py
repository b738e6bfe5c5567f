"""Stability scores, their distribution, and the ranked risk list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import clock, labels, text
from annalist.functions.numbers import round_exact, truncate
from annalist.operators.activity import (
    FUNCTION,
    change_profile,
    fragile_rows,
    hotspot_rows,
)
from annalist.operators.ownership import bus_factor
from annalist.plans.shapes import top
from annalist.schema import History
from annalist.session import cut, staged

# Weight of each part of the score, and the age that counts as settled.
WEIGHTS = {"rate": 0.5, "recency": 0.3, "spread": 0.2}
SETTLED_DAYS = 365


def scores(h: History, as_of: int, file_filter: str | None = None) -> DataFrame:
    """Score of every function at HEAD: 0 volatile to 1 stable, without order.

    The largest counts are taken over all changed functions, deleted ones included.
    """
    functions, changes = h.functions, h.function_changes
    if file_filter is not None:
        functions = functions.filter(text.contains(F.col("file_path"), file_filter))
        changes = changes.filter(text.contains(F.col("file_path"), file_filter))
    return score_rows(functions, change_profile(changes), as_of)


def score_rows(functions: DataFrame, profile: DataFrame, as_of: int) -> DataFrame:
    profile = profile.select(*FUNCTION, "change_count", "author_count", "last_ts")
    largest = profile.agg(
        F.max("change_count").alias("max_changes"), F.max("author_count").alias("max_authors")
    )
    names = functions.select(F.col("name").alias("function_name"), "file_path").distinct()
    joined = names.join(profile, FUNCTION, "left").join(F.broadcast(largest))  # one row
    changed = F.col("change_count").isNotNull()
    days = F.when(
        changed & (F.col("last_ts") != 0), (F.lit(as_of) - F.col("last_ts")) / clock.DAY
    ).otherwise(F.lit(float(SETTLED_DAYS)))
    rate = F.when(changed, F.col("change_count") / F.col("max_changes")).otherwise(0.0)
    spread = F.when(changed & (F.col("max_authors") > 0), F.col("author_count") / F.col("max_authors"))
    recency = F.least(days / SETTLED_DAYS, F.lit(1.0))
    score = (
        (1 - rate) * WEIGHTS["rate"]
        + F.when(changed, recency).otherwise(1.0) * WEIGHTS["recency"]
        + (1 - F.coalesce(spread, F.lit(0.0))) * WEIGHTS["spread"]
    )
    zero = F.lit(0)
    scored = joined.select(
        *FUNCTION,
        round_exact(score, 3).alias("stability_score"),
        F.coalesce("change_count", zero).alias("change_count"),
        F.coalesce("author_count", zero).alias("author_count"),
        truncate(days).alias("days_ago"),
    )
    return scored.withColumn("rating", labels.stability_rating(F.col("stability_score")))


def stability(
    h: History,
    as_of: int,
    limit: int | None = 30,
    file_filter: str | None = None,
    volatile_first: bool = False,
) -> DataFrame:
    """Scores, the most stable first, or the most volatile first."""
    order = F.asc("stability_score") if volatile_first else F.desc("stability_score")
    return top(scores(h, as_of, file_filter), limit, order, "file_path", "function_name")


def listing_and_ratings(h: History, as_of: int, profile: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The report's listing, and the ratings of all changed functions behind it; the *profile* of the changes may be given."""
    if profile is None:
        profile = change_profile(h.function_changes)
    scored = staged(score_rows(h.functions, profile, as_of), "report-scores")
    return _sample(scored), distribution(scored, changed_only=True)


def distribution(scored: DataFrame, changed_only: bool = False) -> DataFrame:
    """Functions per rating, zero where a rating does not occur."""
    rows = scored.filter("change_count > 0") if changed_only else scored
    counted = rows.groupBy("rating").agg(F.count("*").alias("n"))
    spark = scored.sparkSession
    ratings = spark.range(len(labels.RATINGS)).select(
        F.element_at(F.array(*map(F.lit, labels.RATINGS)), (F.col("id") + 1).cast("int")).alias("rating")
    )
    return ratings.join(counted, "rating", "left").select(
        "rating", F.coalesce("n", F.lit(0)).alias("functions")
    )


def report_sample(h: History, as_of: int) -> DataFrame:
    """All volatile and critical functions, the 200 steadiest changed moderate ones and
    the 100 steadiest changed stable ones, least stable first. A listing: shares and
    counts come from all scores."""
    return _sample(scores(h, as_of))


def _sample(scored: DataFrame) -> DataFrame:
    rating = F.col("rating")
    changed = F.col("change_count") > 0
    best = [F.desc("stability_score"), F.col("file_path"), F.col("function_name")]
    moderate = top(scored.filter((rating == "moderate") & changed), 200, *best)
    stable = top(scored.filter((rating == "stable") & changed), 100, *best)
    rows = (
        scored.filter(rating.isin("volatile", "critical")).unionByName(moderate).unionByName(stable)
    )
    return rows.orderBy("stability_score", "file_path", "function_name")


def risks(h: History, as_of: int, limit: int | None = 10) -> DataFrame:
    """Four kinds of risk on one scale of 0 to 100, worst first; only *limit* cuts the listing."""
    changes = F.col("change_count")
    name = F.col("function_name")

    # one pass over the changes; what it leaves is one row per function
    profile = cut(change_profile(h.function_changes))
    fragile = fragile_rows(profile, limit=None)
    most = F.broadcast(fragile.agg(F.max("change_count").alias("most")))  # one row
    fragile_risks = fragile.join(most).select(
        F.concat(F.lit("Fragile function: "), name).alias("description"),
        F.least(F.lit(100), truncate(changes / F.col("most") * 85 + 15)).alias("severity"),
        F.col("file_path").alias("area"),
        F.lit("fragile").alias("category"),
    )

    shaky = score_rows(h.functions, profile, as_of).filter(F.col("rating").isin("volatile", "critical"))
    volatile_risks = shaky.select(
        F.concat(F.lit("Volatile function: "), name).alias("description"),
        F.least(F.lit(100), truncate((1 - F.col("stability_score")) * 90 + 10)).alias("severity"),
        F.col("file_path").alias("area"),
        F.lit("volatile").alias("category"),
    )

    share = F.col("percentage")
    bus_risks = bus_factor(h).select(
        F.concat(
            F.lit("Bus factor: "), F.col("directory"), F.lit("/ owned "), share.cast("string"),
            F.lit("% by "), F.col("dominant_author"),
        ).alias("description"),
        F.least(F.lit(80), truncate(share * 0.7 + 10)).alias("severity"),
        F.concat(F.col("directory"), F.lit("/")).alias("area"),
        F.lit("bus_factor").alias("category"),
    )

    people = F.col("author_count")
    convergence_risks = hotspot_rows(profile, limit=None).filter(people >= 3).select(
        F.concat(
            F.lit("Convergence point: "), name, F.lit(" ("), people.cast("string"),
            F.lit(" authors, "), changes.cast("string"), F.lit(" changes)"),
        ).alias("description"),
        F.least(F.lit(75), people * 15 + changes * 2).cast("int").alias("severity"),
        F.col("file_path").alias("area"),
        F.lit("convergence").alias("category"),
    )

    kinds = [fragile_risks, volatile_risks, bus_risks, convergence_risks]
    tagged = [k.withColumn("kind", F.lit(i)) for i, k in enumerate(kinds)]
    union = reduce(DataFrame.unionByName, tagged)
    order = [F.desc("severity"), F.col("kind"), F.col("area"), F.col("description")]
    listed = top(union, limit, *order)
    rank = F.row_number().over(Window.orderBy(*order))
    if limit is None:
        return listed.drop("kind")
    return listed.withColumn("rank", rank).select(  # at most *limit* rows
        "rank", "description", "severity", "area", "category"
    ).orderBy("rank")
