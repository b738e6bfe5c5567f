"""Labels by threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds, highest first.
STABILITY = [(0.8, "stable"), (0.5, "moderate"), (0.3, "volatile")]
COSINE = [(0.40, "HIGH"), (0.30, "GOOD"), (0.20, "FAIR"), (0.10, "LOW")]
HYBRID = [(0.70, "HIGH"), (0.50, "GOOD"), (0.30, "FAIR"), (0.15, "LOW")]
RATINGS = ["stable", "moderate", "volatile", "critical"]


def _banded(value: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    (bound, label), *others = bands
    column = F.when(value >= bound, label)
    for bound, label in others:
        column = column.when(value >= bound, label)
    return column.otherwise(rest)


def stability_rating(score: Column) -> Column:
    return _banded(score, STABILITY, "critical")


def cosine_relevance(score: Column) -> Column:
    return _banded(score, COSINE, "WEAK")


def hybrid_relevance(score: Column) -> Column:
    return _banded(score, HYBRID, "WEAK")


def recent_phase(avg_changes: Column, avg_authors: Column) -> Column:
    """Label of the last months; NULL averages mean that there is no timeline."""
    return (
        F.when(avg_changes.isNull(), "unknown")
        .when((avg_changes > 50) & (avg_authors > 2), "active development")
        .when(avg_changes > 20, "steady iteration")
        .when(avg_changes > 5, "maintenance")
        .when(avg_changes > 0, "low activity")
        .otherwise("dormant")
    )


def hotspot_risk(change_count: Column) -> Column:
    return F.when(change_count > 15, "high").when(change_count > 5, "medium").otherwise("low")
