"""Development phases, their themes and bursts, and the facts told about them.

All tables here have one row per month, phase or theme, so windows without a partition
key and broadcasts are bounded by the length of the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import clock, text
from annalist.functions.numbers import round_exact
from annalist.schema import History

# Monthly changes against the median month.
HIGH_RATIO = 1.5
NORMAL_RATIO = 0.3

# Chapter titles by dominant theme.
CHAPTER_TITLES = {
    "fix": "Bug Fix Sprint",
    "feature": "Feature Development",
    "refactor": "Code Restructuring",
    "docs": "Documentation Push",
    "test": "Testing Phase",
    "config": "Configuration & Setup",
    "remove": "Cleanup & Removal",
    "other": "General Development",
}


def project_phases(timeline: DataFrame) -> DataFrame:
    """Runs of consecutive months with the same activity level.

    A high month after a high one belongs to the same run, so a run labelled as a peak
    of the run before it cannot occur.
    """
    by_month = Window.orderBy("month")
    median = timeline.agg(F.median("changes").alias("m"))
    ratio = F.col("changes") / F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("m"))
    level = (
        F.when(ratio > HIGH_RATIO, "high").when(ratio >= NORMAL_RATIO, "normal").otherwise("low")
    )
    levelled = timeline.join(F.broadcast(median)).withColumn("level", level)
    starts = F.coalesce(F.lag("level").over(by_month) != F.col("level"), F.lit(False))
    runs = levelled.withColumn("starts", starts.cast("int")).withColumn(
        "run", F.sum("starts").over(by_month)
    )
    grouped = runs.groupBy("run", "level").agg(
        F.min("month").alias("start_month"),
        F.max("month").alias("end_month"),
        F.count("*").alias("months"),
        F.sum("commits").alias("total_commits"),
        F.sum("changes").alias("total_changes"),
        round_exact(F.sum("authors") / F.count("*"), 1).alias("avg_authors"),
    )
    before = F.lag("level").over(Window.orderBy("run"))
    phase_type = (
        F.when(F.col("level") == "high", F.when(F.col("before") == "low", "revival").otherwise("growth"))
        .when(
            F.col("level") == "normal",
            F.when(F.col("before") == "high", "decline").otherwise("steady"),
        )
        .otherwise(F.when(F.col("before").isNull(), "dormant").otherwise("decline"))
    )
    return (
        grouped.withColumn("before", before)
        .select(
            F.col("run").cast("int").alias("phase_index"),
            "start_month", "end_month", phase_type.alias("phase_type"), "months",
            "total_commits", "total_changes", "avg_authors",
        )
        .orderBy("phase_index")
    )


def _spans(phases: DataFrame) -> DataFrame:
    return F.broadcast(phases.select("phase_index", "start_month", "end_month"))


def _in_phase(rows: DataFrame, phases: DataFrame) -> DataFrame:
    month = F.col("month")
    inside = (month >= F.col("start_month")) & (month <= F.col("end_month"))
    return rows.join(_spans(phases), inside)


def themed_commits(h: History) -> DataFrame:
    return h.commits.select(
        clock.month_of(F.col("timestamp")).alias("month"),
        text.commit_theme(F.col("message")).alias("theme"),
        F.struct("timestamp", "hash").alias("at"),
        text.first_line(F.coalesce("message", F.lit(""))).alias("sample"),
    )


def theme_counts(h: History, phases: DataFrame) -> DataFrame:
    """Commits per phase and theme, with the place of the first one."""
    monthly = themed_commits(h).groupBy("month", "theme").agg(
        F.count("*").alias("n"), F.min("at").alias("first")
    )
    return _in_phase(monthly, phases).groupBy("phase_index", "theme").agg(
        F.sum("n").alias("commits"), F.min("first").alias("first")
    )


def period_themes(h: History, phases: DataFrame, per_theme: int = 3, per_phase: int = 5) -> DataFrame:
    """Per phase: commits by theme, the dominant theme, and sample messages.

    Equal themes rank by which appeared first. Samples are the first three messages of a
    theme, the dominant theme first, five in all.
    """
    counts = theme_counts(h, phases)
    by_rank = Window.partitionBy("phase_index").orderBy(F.desc("commits"), "first")
    by_place = Window.partitionBy("phase_index").orderBy("first")
    ranked = counts.withColumn("rank", F.row_number().over(by_rank)).withColumn(
        "place", F.when(F.col("rank") == 1, 0).otherwise(F.row_number().over(by_place))
    )
    # the first few per month and theme are picked before the shuffle (window group limit)
    early = Window.partitionBy("month", "theme").orderBy("at")
    first = Window.partitionBy("phase_index", "theme").orderBy("at")
    samples = (
        themed_commits(h)
        .filter(F.col("sample") != "")
        .withColumn("r", F.row_number().over(early))
        .filter(F.col("r") <= per_theme)
    )
    samples = (
        _in_phase(samples, phases)
        .withColumn("r", F.row_number().over(first))
        .filter(F.col("r") <= per_theme)
        .join(F.broadcast(ranked.select("phase_index", "theme", "place")), ["phase_index", "theme"])
        .groupBy("phase_index")
        .agg(F.array_sort(F.collect_list(F.struct("place", "r", "sample"))).alias("s"))
        .select("phase_index", F.slice(F.col("s.sample"), 1, per_phase).alias("sample_messages"))
    )
    themes = ranked.groupBy("phase_index").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("theme", "commits")))
        ).alias("themes"),
        F.min_by("theme", "rank").alias("dominant_theme"),
    )
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,bigint>")
    return (
        phases.select("phase_index")
        .join(themes, "phase_index", "left")
        .join(samples, "phase_index", "left")
        .select(
            "phase_index",
            F.coalesce("themes", empty).alias("themes"),
            F.coalesce("dominant_theme", F.lit("other")).alias("dominant_theme"),
            F.coalesce("sample_messages", none).alias("sample_messages"),
        )
        .orderBy("phase_index")
    )


def activity_bursts(phases: DataFrame, timeline: DataFrame) -> DataFrame:
    """Phases with more than twice the changes per month of the whole timeline."""
    overall = timeline.agg((F.sum("changes") / F.count("*")).alias("mean"))
    monthly = F.col("total_changes") / F.col("months")
    intensity = F.when(F.col("mean") > 0, round_exact(monthly / F.col("mean"), 1)).otherwise(0.0)
    return (
        phases.join(F.broadcast(overall))
        .filter(monthly > 2 * F.col("mean"))
        .select(
            "start_month", "end_month", "phase_type", "total_changes",
            intensity.alias("intensity"),
        )
        .orderBy("start_month")
    )


def chapters(phases: DataFrame, themes: DataFrame) -> DataFrame:
    """A titled paragraph per phase."""
    title = F.create_map(*[F.lit(v) for pair in CHAPTER_TITLES.items() for v in pair])
    one = F.col("start_month") == F.col("end_month")
    text_of = F.format_string(
        "%d month(s) of %s activity with %d commits and %d function changes.",
        "months", "phase_type", "total_commits", "total_changes",
    )
    dominant = F.when(
        F.size("sample_messages") > 0,
        F.concat(F.lit(" Dominant activity: "), "dominant_theme", F.lit(".")),
    ).otherwise("")
    return (
        phases.join(themes, "phase_index")
        .select(
            "phase_index",
            F.when(one, F.col("start_month"))
            .otherwise(F.concat_ws(" to ", "start_month", "end_month"))
            .alias("period"),
            F.concat(
                title[F.col("dominant_theme")], F.lit(" ("), F.initcap("phase_type"), F.lit(")")
            ).alias("title"),
            F.concat(text_of, dominant).alias("summary"),
            F.format_string("A %s phase with %d commits.", "phase_type", "total_commits").alias(
                "significance"
            ),
        )
        .orderBy("phase_index")
    )


def project_arc(phases: DataFrame) -> DataFrame:
    """One row: the kind of story the phases tell."""
    def seen(kind: str) -> F.Column:
        return F.coalesce(F.bool_or(F.col("phase_type") == kind), F.lit(False))

    return phases.agg(
        F.when(seen("growth") & seen("peak"), "growth")
        .when(seen("revival"), "revival")
        .when(seen("decline"), "maturation")
        .otherwise("expansion")
        .alias("arc_type"),
        F.count("*").alias("phases"),
    )


def timeline_facts(timeline: DataFrame) -> DataFrame:
    """One row: totals and the busiest month (the first of equals)."""
    busiest = F.max(
        F.struct("changes", (-F.unix_date(F.to_date("month", "yyyy-MM"))).alias("early"), "month", "commits")
    )
    row = timeline.agg(
        F.count("*").alias("months"),
        F.sum("commits").alias("total_commits"),
        F.sum("changes").alias("total_changes"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        busiest.alias("peak"),
    )
    return row.select(
        "months", "total_commits", "total_changes", "first_month", "last_month",
        F.col("peak.month").alias("peak_month"),
        F.col("peak.changes").alias("peak_changes"),
        F.col("peak.commits").alias("peak_commits"),
    )
