"""Composite answers: summary, why, facts about the project, and the report data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import labels, text
from annalist.functions.numbers import round_exact
from annalist.operators import activity, lineage, phases, stability
from annalist.plans.shapes import top
from annalist.schema import History
from annalist.session import cut, staged


def read_once(h: History) -> History:
    """*h* with its changes written down once, without hash and message: a report goes through them many times,
    and every time would repeat the joins they come from."""
    kept = [c for c in h.function_changes.columns if c not in ("commit_hash", "message")]
    return h.with_tables(function_changes=staged(h.function_changes.select(*kept), "report-changes"))


def _profile(h: History) -> DataFrame:
    """One row per function of *h*, read by several sections."""
    return staged(activity.change_profile(h.function_changes), "report-profile")


def recent_phase(timeline: DataFrame) -> DataFrame:
    """One row: averages of the last three months and what they are called."""
    last = top(timeline, 3, F.desc("month"))
    means = last.agg(F.avg("changes").alias("avg_changes"), F.avg("authors").alias("avg_authors"))
    return means.withColumn(
        "phase", labels.recent_phase(F.col("avg_changes"), F.col("avg_authors"))
    )


def summary(h: History, as_of: int) -> dict[str, DataFrame]:
    """The one-screen overview, a DataFrame per section."""
    named = [F.col("function_name").alias("name"), F.col("file_path").alias("file")]
    changes = F.col("change_count").alias("changes")
    h = read_once(h)
    profile = _profile(h)
    return {
        "stats": activity.stats(h),
        "hotspots": activity.hotspot_rows(profile, limit=5).select(*named, changes),
        "fragile_zones": activity.fragile_rows(profile, limit=3).select(*named, changes),
        "top_authors": activity.authors(h, limit=3).select("author", changes),
        "languages": activity.languages(h),
        "stability_distribution": stability.distribution(stability.score_rows(h.functions, profile, as_of)),
        "phase": recent_phase(activity.timeline(h, as_of, months=12)).select("phase"),
    }


def why(
    h: History, function_name: str, as_of: int, file_filter: str | None = None
) -> dict[str, DataFrame]:
    """History, blame, stability and coupling of one function."""
    if file_filter is not None:
        history = lineage.function_history(h, function_name, file_filter, fuzzy=True, limit=10)
        fuzzy = text.contains(F.col("file_path"), file_filter)
        blame = h.blame_entries.filter(fuzzy & (F.col("function_name") == function_name))
    else:
        # the first ten of a listing that is ordered by file, then newest first
        history = top(
            lineage.history_by_name(h, function_name), 10,
            "file_path", F.desc("timestamp"), "commit_hash", "function_name",
        )
        blame = h.blame_entries.filter(F.lit(False))
    scored = stability.scores(h, as_of, file_filter).filter(F.col("function_name") == function_name)
    return {
        "history": history.select(
            text.short_hash(F.col("commit_hash")).alias("commit"),
            F.col("change_type").alias("type"), "author", "timestamp",
            F.substring("message", 1, 80).alias("message"),
        ),
        "blame": blame.select(
            "author", F.col("line_count").alias("lines"), F.col("percentage").alias("pct")
        ).orderBy(F.desc("pct"), "author"),
        "stability": top(scored, 5, F.desc("stability_score"), "file_path"),
        "coupled": activity.coupled_functions(h, function_name, file_filter, limit=10),
    }


# ---- facts ---------------------------------------------------------------------


def ownership_facts(h: History) -> DataFrame:
    """One row over all named authors: contributors, the leader and the leader's share."""
    listed = activity.authors(h, limit=None)
    row = listed.agg(
        F.count("*").alias("contributors"),
        F.sum("change_count").alias("total_changes"),
        F.min(F.struct((-F.col("change_count")).alias("n"), "author")).alias("lead"),
    )
    lead = -F.col("lead.n")
    share = round_exact(lead / F.col("total_changes") * 100).cast("int")
    return row.filter("contributors > 0").select(
        "contributors", "total_changes",
        F.col("lead.author").alias("top_author"),
        lead.alias("top_changes"),
        share.alias("top_pct"),
        (share > 50).alias("dominated"),
    )


def convergence_points(h: History) -> DataFrame:
    """The first five functions many authors share, as text."""
    shared = activity.coauthorship(h, limit=5)
    return shared.select(
        *activity.FUNCTION, "author_count",
        F.concat(
            F.col("function_name"), F.lit(" in "), F.col("file_path"), F.lit(" ("),
            F.col("author_count").cast("string"), F.lit(" authors: "),
            F.array_join("authors", ", "), F.lit(")"),
        ).alias("point"),
    )


def contributor_facts(h: History) -> DataFrame:
    """One row of sentences about the contributors."""
    facts = ownership_facts(h)
    return facts.select(
        F.format_string(
            "%d contributors with %d total changes.", "contributors", "total_changes"
        ).alias("overview"),
        F.when(
            F.col("dominated"), F.format_string("Top contributor owns %d%% of all changes.", "top_pct")
        )
        .otherwise(
            F.format_string("Changes distributed across %d contributors.", "contributors")
        )
        .alias("bus_factor"),
        F.format_string(
            "%s leads with %d changes (%d%% of total)", "top_author", "top_changes", "top_pct"
        ).alias("highlight"),
    )


def stability_facts(distribution: DataFrame) -> DataFrame:
    """One row: functions rated, share of stable ones, concerns."""
    def of(rating: str) -> F.Column:
        return F.coalesce(F.sum(F.when(F.col("rating") == rating, F.col("functions"))), F.lit(0))

    row = distribution.agg(
        F.sum("functions").alias("total"), of("stable").alias("stable"),
        of("critical").alias("critical"), of("volatile").alias("volatile"),
    )
    pct = F.when(
        F.col("total") > 0, round_exact(F.col("stable") / F.col("total") * 100)
    ).otherwise(0.0)
    return row.select("total", pct.cast("int").alias("stable_pct"), "critical", "volatile")


def hotspot_notes(h: History, limit: int = 10, profile: DataFrame | None = None) -> DataFrame:
    """The first hotspots in words; the *profile* of the changes may be given."""
    if profile is None:
        profile = activity.change_profile(h.function_changes)
    return activity.hotspot_rows(profile, limit).select(
        F.col("function_name").alias("name"), F.col("file_path").alias("file"),
        F.format_string("Changed %d times by %d author(s).", "change_count", "author_count").alias(
            "explanation"
        ),
        labels.hotspot_risk(F.col("change_count")).alias("risk"),
    )


def archaeology(h: History, limit: int = 10, profile: DataFrame | None = None) -> DataFrame:
    """Notes on the first fragile and the first stale functions; the *profile* of the changes may be given."""
    if profile is None:
        profile = activity.change_profile(h.function_changes)
    name = [F.col("function_name").alias("name"), F.col("file_path").alias("file")]
    day = F.date_format(F.date_from_unix_date(F.floor(F.col("last_changed") / 86400).cast("int")), "yyyy-MM-dd")
    fragile = activity.fragile_rows(profile, limit).select(
        F.lit("fragile").alias("kind"), *name,
        F.format_string("Modified %d times by %d author(s).", "modify_count", "author_count").alias(
            "observation"
        ),
    )
    stale = activity.stale_functions(h, limit=limit).select(
        F.lit("stale").alias("kind"), *name,
        F.when(
            F.col("last_changed").isNotNull(),
            F.format_string("Last changed %s, %d total changes.", day, "total_changes"),
        )
        .otherwise("Never changed since indexing.")
        .alias("observation"),
    )
    return fragile.unionByName(stale)


def executive_facts(
    h: History,
    as_of: int,
    months: int = 120,
    spells: DataFrame | None = None,
    ratings: DataFrame | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """One row of the counts an overview starts with; phases, ratings and the profile of the changes may be given,
    by a caller whose changes are written down."""
    if profile is None:
        h = read_once(h)
        profile = _profile(h)
    if spells is None:
        spells = phases.project_phases(activity.timeline(h, as_of, months))
    if ratings is None:
        ratings = stability.distribution(stability.score_rows(h.functions, profile, as_of), changed_only=True)
    flagged = F.col("rating").isin("volatile", "critical")
    counts = [
        activity.stats(h, ["functions", "commits", "changes"]),
        spells.agg(F.count("*").alias("phases")),
        activity.fragile_rows(profile, limit=None).agg(F.count("*").alias("fragile")),
        ratings.agg(
            F.coalesce(F.sum(F.when(flagged, F.col("functions"))), F.lit(0)).alias("flagged")
        ),
        activity.authors(h, limit=None).agg(F.count("*").alias("contributors")),
    ]
    first, *rest = counts
    for one_row in rest:
        first = first.join(F.broadcast(one_row))
    return first


def report_data(h: History, as_of: int) -> dict[str, DataFrame]:
    """Everything a report page shows, a DataFrame per section.

    What several sections read, by month, phase or sampled function, is computed once.
    """
    h = read_once(h)
    profile = _profile(h)
    timeline = cut(activity.timeline(h, as_of, months=120))
    spells = cut(phases.project_phases(timeline))
    themes = cut(phases.period_themes(h, spells))
    sample, ratings = stability.listing_and_ratings(h, as_of, profile)
    return {
        "stats": activity.stats(h),
        "timeline": timeline,
        "hotspots": activity.hotspot_rows(profile, limit=20),
        "stability": sample,
        "stability_dist": ratings,
        "authors": activity.authors(h, limit=100),
        "languages": activity.languages(h),
        "commits_by_month": activity.commits_by_month(h),
        "fragile_zones": activity.fragile_rows(profile, limit=15),
        "stale_zones": activity.stale_functions(h),
        "coauthorship_patterns": activity.coauthorship(h),
        "feature_expansion": activity.feature_expansion(h),
        "phases": spells,
        "period_themes": themes,
        "activity_bursts": phases.activity_bursts(spells, timeline),
        "chapters": phases.chapters(spells, themes),
        "project_arc": phases.project_arc(spells),
        "timeline_facts": phases.timeline_facts(timeline),
        "stability_facts": stability_facts(ratings),
        "ownership_facts": ownership_facts(h),
        "contributor_facts": contributor_facts(h),
        "convergence_points": convergence_points(h),
        "hotspot_notes": hotspot_notes(h, profile=profile),
        "archaeology": archaeology(h, profile=profile),
        "executive_facts": executive_facts(h, as_of, spells=spells, ratings=ratings, profile=profile),
    }
