"""How much changed, where, when and by whom: aggregates of the change fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import clock, paths, text
from annalist.functions.numbers import round_exact
from annalist.plans.shapes import ordered_chunks, running_count, top, window
from annalist.schema import History

FUNCTION = ["function_name", "file_path"]


def _of_type(change_type: str) -> F.Column:
    return F.count_if(F.col("change_type") == change_type)


def _filtered(
    h: History,
    author: str | None = None,
    file_filter: str | None = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    changes = h.function_changes
    if author is not None:
        changes = changes.filter(F.col("author") == author)
    if file_filter is not None:
        changes = changes.filter(text.contains(F.col("file_path"), file_filter))
    return window(changes, F.col("timestamp"), since, until)


def change_profile(changes: DataFrame) -> DataFrame:
    """One row per function: counts by type, distinct authors, first and last time.

    Changes collapse to (function, author) first. That shuffle is the one the distinct
    count needs anyway, and a function with very many changes is spread over its authors.
    """
    by_author = changes.groupBy(*FUNCTION, "author").agg(
        F.count("*").alias("n"),
        _of_type("added").alias("added"),
        _of_type("modified").alias("modified"),
        _of_type("deleted").alias("deleted"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    return by_author.groupBy(*FUNCTION).agg(
        F.sum("n").alias("change_count"),
        F.count("author").alias("author_count"),
        F.sum("added").alias("added"),
        F.sum("modified").alias("modified"),
        F.sum("deleted").alias("deleted"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def hotspots(
    h: History,
    limit: int | None = 20,
    author: str | None = None,
    file_filter: str | None = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Most-changed functions. ``renamed`` rows count in ``change_count`` only."""
    return hotspot_rows(change_profile(_filtered(h, author, file_filter, since, until)), limit)


def hotspot_rows(profile: DataFrame, limit: int | None) -> DataFrame:
    rows = profile.select(
        *FUNCTION, "change_count", "author_count", "added", "modified", "deleted",
        clock.known(F.col("last_ts")).alias("last_changed"),
    )
    return top(rows, limit, F.desc("change_count"), *FUNCTION)


def fragile_functions(
    h: History, limit: int | None = 15, since: int | None = None, until: int | None = None
) -> DataFrame:
    """At least five changes, three of them modifications."""
    return fragile_rows(change_profile(_filtered(h, since=since, until=until)), limit)


def fragile_rows(profile: DataFrame, limit: int | None) -> DataFrame:
    rows = profile.filter((F.col("change_count") >= 5) & (F.col("modified") >= 3)).select(
        *FUNCTION, "change_count", "author_count",
        F.col("modified").alias("modify_count"),
        clock.known(F.col("first_ts")).alias("first_change"),
        clock.known(F.col("last_ts")).alias("last_change"),
    )
    return top(rows, limit, F.desc("change_count"), *FUNCTION)


def authors(
    h: History, limit: int | None = 20, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Contribution of each named author."""
    changes = _filtered(h, since=since, until=until).filter(F.col("author") != "")
    # few authors, many changes: collapse to (author, function) before the distinct counts
    collapsed = changes.groupBy("author", *FUNCTION).agg(
        F.count("*").alias("n"),
        F.sum("lines_added").alias("added"),
        F.sum("lines_removed").alias("removed"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    rows = collapsed.groupBy("author").agg(
        F.sum("n").alias("change_count"),
        F.count_distinct("function_name").alias("functions_touched"),
        F.count_distinct("file_path").alias("files_touched"),
        F.sum("added").alias("total_added"),
        F.sum("removed").alias("total_removed"),
        clock.known(F.min("first_ts")).alias("first_commit"),
        clock.known(F.max("last_ts")).alias("last_commit"),
    )
    return top(rows, limit, F.desc("change_count"), "author")


def coauthorship(h: History, limit: int | None = 20) -> DataFrame:
    """Functions that two or more authors changed, with the sorted author list.

    The lists are gathered only for the functions that stay in the listing.
    """
    pairs = h.function_changes.groupBy(*FUNCTION, "author").agg(F.count("*").alias("n"))
    counted = pairs.groupBy(*FUNCTION).agg(
        F.count("author").alias("author_count"), F.sum("n").alias("change_count")
    )
    order = [F.desc("author_count"), F.desc("change_count"), *map(F.col, FUNCTION)]
    kept = counted.filter(F.col("author_count") >= 2)
    if limit is None:
        names = pairs.groupBy(*FUNCTION).agg(F.sort_array(F.collect_set("author")).alias("authors"))
    else:
        kept = top(kept, limit, *order)
        names = (
            pairs.join(kept.select(*FUNCTION), FUNCTION, "left_semi")
            .groupBy(*FUNCTION)
            .agg(F.sort_array(F.collect_set("author")).alias("authors"))
        )
    rows = kept.join(names, FUNCTION).select(
        *FUNCTION, "author_count", "authors", "change_count"
    )
    return rows.orderBy(*order)


def changed_since(h: History, since: int, limit: int | None = 50) -> DataFrame:
    rows = (
        _filtered(h, since=since)
        .groupBy(*FUNCTION)
        .agg(F.max("timestamp").alias("last_ts"), F.count("*").alias("change_count"))
        .select(*FUNCTION, clock.known(F.col("last_ts")).alias("last_changed"), "change_count")
    )
    return top(rows, limit, F.desc("last_changed"), *FUNCTION)


def function_ages(
    h: History,
    as_of: int,
    limit: int | None = 50,
    file_filter: str | None = None,
    recent_first: bool = False,
) -> DataFrame:
    """Definitions by staleness; never-changed ones lead in both orders."""
    functions = h.functions
    changes = h.function_changes
    if file_filter is not None:
        functions = functions.filter(text.contains(F.col("file_path"), file_filter))
        changes = changes.filter(text.contains(F.col("file_path"), file_filter))
    last = changes.groupBy(F.col("function_name").alias("name"), "file_path").agg(
        F.max("timestamp").alias("last_ts"), F.count("*").alias("n")
    )
    rows = functions.join(last, ["name", "file_path"], "left").select(
        "name", "file_path", "kind", "start_line",
        clock.known(F.col("last_ts")).alias("last_changed"),
        F.when(F.col("last_ts") > 0, F.expr(f"({int(as_of)} - last_ts) div 86400"))
        .otherwise(-1)
        .alias("days_ago"),
        F.coalesce("n", F.lit(0)).alias("change_count"),
    )
    changed = F.col("last_changed")
    direction = changed.desc_nulls_last() if recent_first else changed.asc_nulls_last()
    listed = top(
        rows, limit, changed.isNull().desc(), direction, "file_path", "name", "kind", "start_line"
    )
    return listed.drop("start_line")


def stale_functions(
    h: History, limit: int | None = 15, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Longest untouched first. A window limits the changes, not the functions.

    A name defined n times in a file counts every change n times. Both sides are
    collapsed before the join, and the count is multiplied afterwards.
    """
    definitions = h.functions.groupBy(F.col("name").alias("function_name"), "file_path").agg(
        F.count("*").alias("definitions"),
        F.min("kind").alias("kind"),
        F.min("language").alias("language"),
    )
    last = (
        window(h.function_changes, F.col("timestamp"), since, until)
        .groupBy(*FUNCTION)
        .agg(F.max("timestamp").alias("last_ts"), F.count("*").alias("n"))
    )
    rows = definitions.join(last, FUNCTION, "left").select(
        *FUNCTION, "kind", "language", F.col("last_ts").alias("last_changed"),
        (F.coalesce("n", F.lit(0)) * F.col("definitions")).alias("total_changes"),
    )
    listed = top(rows, limit, F.asc_nulls_first("last_changed"), *FUNCTION)
    return listed.withColumn("last_changed", clock.known(F.col("last_changed")))


def _monthly_changes(changes: DataFrame) -> DataFrame:
    collapsed = (
        changes.groupBy(
            clock.month_of(F.col("timestamp")).alias("month"), "function_name", "author"
        )
        .agg(F.count("*").alias("n"))
    )
    return collapsed.groupBy("month").agg(
        F.sum("n").alias("changes"),
        F.count_distinct("function_name").alias("functions"),
        F.count_distinct("author").alias("authors"),
    )


def timeline(h: History, as_of: int, months: int | None = 12) -> DataFrame:
    """Monthly commits, changes, functions and authors of the last *months*, or of all; months without either
    are absent."""
    recent = F.lit(True) if months is None else F.col("timestamp") > clock.months_back(as_of, months)
    changes = _monthly_changes(h.function_changes.filter(recent))
    commits = (
        h.commits.filter(recent)
        .groupBy(clock.month_of(F.col("timestamp")).alias("month"))
        .agg(F.count("*").alias("commits"))
    )
    zero = F.lit(0)
    return (
        changes.join(commits, "month", "full_outer")
        .select(
            "month",
            F.coalesce("commits", zero).alias("commits"),
            F.coalesce("changes", zero).alias("changes"),
            F.coalesce("functions", zero).alias("functions"),
            F.coalesce("authors", zero).alias("authors"),
        )
        .orderBy("month")
    )


def churn(
    h: History, as_of: int, months: int = 12, dir_filter: str | None = None
) -> DataFrame:
    """Changes by top directory and month."""
    changes = h.function_changes.filter(F.col("timestamp") >= clock.months_back(as_of, months))
    if dir_filter is not None:
        changes = changes.filter(text.contains(F.col("file_path"), dir_filter))
    return (
        changes.groupBy(
            paths.top_directory(F.col("file_path")).alias("directory"),
            clock.month_of(F.col("timestamp")).alias("month"),
        )
        .agg(F.count("*").alias("changes"))
        .orderBy("directory", "month")
    )


def languages(h: History) -> DataFrame:
    counted = h.functions.groupBy("language").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "language")


def file_lifecycle(h: History, file_path: str) -> DataFrame:
    """One row about every file whose path contains *file_path*; none without changes."""
    changes = h.function_changes.filter(text.contains(F.col("file_path"), file_path))
    collapsed = changes.groupBy("function_name", "author").agg(
        F.count("*").alias("n"),
        _of_type("added").alias("added"),
        _of_type("modified").alias("modified"),
        _of_type("deleted").alias("deleted"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    row = collapsed.agg(
        clock.known(F.min("first_ts")).alias("first_commit"),
        clock.known(F.max("last_ts")).alias("last_commit"),
        F.sum("n").alias("total_changes"),
        F.count_distinct("author").alias("unique_authors"),
        F.sum("added").alias("functions_added"),
        F.sum("modified").alias("functions_modified"),
        F.sum("deleted").alias("functions_deleted"),
        F.count_distinct("function_name").alias("unique_functions"),
    )
    return row.filter(F.col("total_changes") > 0).select(
        F.lit(file_path).alias("file_path"), "*"
    )


def feature_expansion(h: History) -> DataFrame:
    """Functions added per month, a running total, and the first ten files and directories.

    Changes collapse to (month, file) before anything else.
    """
    added = h.function_changes.filter(F.col("change_type") == "added")
    by_file = added.groupBy(
        clock.month_of(F.col("timestamp")).alias("month"), "file_path"
    ).agg(F.count("*").alias("n"))
    counts = by_file.groupBy("month").agg(F.sum("n").alias("new_functions"))
    directory = paths.parent_directory(F.col("file_path"))
    directories = by_file.select("month", directory.alias("path")).filter("path <> ''").distinct()
    files = by_file.select("month", F.col("file_path").alias("path"))
    none = F.array().cast("array<string>")
    running = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counts.join(_first_paths(files, "new_files"), "month", "left")
        .join(_first_paths(directories, "expanding_areas"), "month", "left")
        # one row per month, so the unpartitioned window stays small
        .select(
            "month",
            "new_functions",
            F.coalesce("new_files", none).alias("new_files"),
            F.coalesce("expanding_areas", none).alias("expanding_areas"),
            F.sum("new_functions").over(running).alias("cumulative_functions"),
        )
        .orderBy("month")
    )


def _first_paths(monthly: DataFrame, name: str, keep: int = 10) -> DataFrame:
    """The *keep* smallest distinct paths of each month, as a sorted array.

    The rank filter is applied in every input partition before the shuffle (a window
    group limit), so only the candidates of a month meet in one task.
    """
    by_path = Window.partitionBy("month").orderBy("path")
    least = monthly.withColumn("r", F.row_number().over(by_path)).filter(F.col("r") <= keep)
    return least.groupBy("month").agg(F.sort_array(F.collect_list("path")).alias(name))


def commits_by_month(h: History) -> DataFrame:
    """Commits with their month and their position in it, one row per commit.

    A list per month would put a whole month of a large history into one row, so the
    grouping is expressed by ``month`` and ``position`` instead.
    """
    commits = h.commits.select(
        clock.month_of(F.col("timestamp")).alias("month"),
        F.coalesce("message", F.lit("")).alias("message"),
        "author",
        "hash",
        "timestamp",
    )
    placed = running_count(
        ordered_chunks(commits, "timestamp", "hash"), F.lit(1), "position", "month"
    )
    return placed.select(
        "month", (F.col("position") + 1).alias("position"), "message", "author", "hash"
    ).orderBy("month", "position")


def config_keys(h: History, limit: int | None = 100, file_filter: str | None = None) -> DataFrame:
    changes = h.config_changes
    if file_filter is not None:
        changes = changes.filter(text.contains(F.col("file_path"), file_filter))
    rows = changes.groupBy("key_path", "file_path").agg(
        F.count("*").alias("change_count"), F.max("timestamp").alias("last_changed")
    )
    return top(rows, limit, F.desc("change_count"), "key_path", "file_path")


def dependency_summary(h: History, limit: int | None = 100) -> DataFrame:
    rows = h.dep_changes.groupBy("package", "file_path").agg(
        F.count("*").alias("change_count"),
        F.max("timestamp").alias("last_changed"),
        _of_type("bumped").alias("bumps"),
        _of_type("added").alias("adds"),
        _of_type("removed").alias("removes"),
    )
    return top(rows, limit, F.desc("change_count"), "package", "file_path")


def stats(h: History, names: list[str] | None = None) -> DataFrame:
    """Row counts of the index tables, as one row; of all, or of the *names* alone."""
    tables = {
        "commits": "commits",
        "functions": "functions",
        "changes": "function_changes",
        "blame_entries": "blame_entries",
    }
    counts = [getattr(h, tables[name]).agg(F.count("*").alias(name)) for name in names or tables]
    first, *rest = counts
    for one_row in rest:
        first = first.join(F.broadcast(one_row))
    return first


def coupled_functions(
    h: History, function_name: str, file_path: str | None = None, limit: int | None = 20
) -> DataFrame:
    """What else changes in the commits that change the target."""
    name = F.col("function_name")
    target = h.function_changes.filter(name == function_name)
    if file_path is not None:
        target = target.filter(text.contains(F.col("file_path"), file_path))
    hashes = target.select("commit_hash").distinct()
    total = hashes.agg(F.count("*").alias("total_target_commits"))
    together = (
        h.function_changes.filter(name != function_name)
        .join(hashes, "commit_hash", "left_semi")
        .groupBy(*FUNCTION)
        .agg(F.count("*").alias("co_change_count"))
    )
    ratio = F.col("co_change_count") / F.col("total_target_commits")
    rows = together.join(F.broadcast(total)).select(
        "*", round_exact(ratio, 2).alias("coupling_ratio")
    )
    return top(rows, limit, F.desc("co_change_count"), *FUNCTION)


def untested_changes(
    h: History, limit: int | None = 20, file_filter: str | None = None
) -> DataFrame:
    """Changes whose commit touched no test-like path, newest first."""
    path = F.col("file_path")
    tested = h.function_changes.filter(paths.is_test(path)).select("commit_hash").distinct()
    changes = h.function_changes.filter(~paths.is_test(path))
    if file_filter is not None:
        changes = changes.filter(text.contains(path, file_filter))
    rows = changes.join(tested, "commit_hash", "left_anti").select(
        "function_name", "file_path", "commit_hash", "change_type", "author", "timestamp", "message"
    )
    listed = top(
        rows, limit, F.desc("timestamp"), "commit_hash", "file_path", "function_name", "change_type"
    )
    return listed.withColumn("timestamp", clock.known(F.col("timestamp")))


def deleted_functions(
    h: History, limit: int | None = 50, pattern: str | None = None
) -> DataFrame:
    """Deleted and gone from HEAD; the author is the one of the last deletion."""
    gone = h.function_changes.filter(F.col("change_type") == "deleted")
    if pattern is not None:
        gone = gone.filter(text.contains(F.col("function_name"), pattern))
    # collapsed before the anti join, so that a much-deleted function is one row there
    last = gone.groupBy(*FUNCTION).agg(
        F.max(F.struct("timestamp", "author")).alias("last")
    )
    live = h.functions.select(F.col("name").alias("function_name"), "file_path").distinct()
    rows = last.join(live, FUNCTION, "left_anti").select(
        *FUNCTION,
        clock.known(F.col("last.timestamp")).alias("deleted_at"),
        F.col("last.author").alias("author"),
    )
    return top(rows, limit, F.desc("deleted_at"), *FUNCTION)
