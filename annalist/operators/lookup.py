"""Lookups: commits, definitions, blame, sources and histories by key or pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import clock, paths, text
from annalist.operators.definitions import once
from annalist.plans.shapes import top, window
from annalist.schema import History

_FUNCTION_COLUMNS = [
    "name", "file_path", "language", "start_line", "end_line", "kind", "signature"
]


def commits(
    h: History,
    limit: int | None = 20,
    file_filter: str | None = None,
    function_filter: str | None = None,
    author_filter: str | None = None,
    message_filter: str | None = None,
    since: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """Commits, newest first. Changes are read only for a file or function filter."""
    rows = window(h.commits, F.col("timestamp"), since, until)
    if author_filter is not None:
        rows = rows.filter(text.contains(F.col("author"), author_filter))
    if message_filter is not None:
        rows = rows.filter(text.message_matches(F.col("message"), message_filter))
    if file_filter is not None or function_filter is not None:
        touched = h.function_changes
        if file_filter is not None:
            touched = touched.filter(text.contains(F.col("file_path"), file_filter))
        if function_filter is not None:
            touched = touched.filter(text.contains(F.col("function_name"), function_filter))
        hashes = touched.select(F.col("commit_hash").alias("hash")).distinct()
        rows = rows.join(hashes, "hash", "left_semi")
    rows = rows.select("hash", "author", "timestamp", "message", "files_changed")
    listed = top(rows, limit, F.desc("timestamp"), "hash")
    return listed.withColumn("timestamp", clock.known(F.col("timestamp")))


def commit(h: History, commit_hash: str) -> DataFrame:
    return h.commits.filter(F.col("hash") == commit_hash)


def commit_files(h: History, commit_hash: str) -> DataFrame:
    return h.commit_files.filter(F.col("commit_hash") == commit_hash).select(
        "path", "insertions", "deletions", "lines"
    )


def indexed_hashes(h: History) -> DataFrame:
    return h.commits.select("hash")


def functions_in_file(h: History, file_path: str) -> DataFrame:
    rows = h.functions.filter(F.col("file_path") == file_path)
    return rows.select(*_FUNCTION_COLUMNS).orderBy("start_line", "name", "kind")


def find_functions(
    h: History,
    pattern: str,
    kind: str | None = None,
    file_filter: str | None = None,
    limit: int | None = 50,
) -> DataFrame:
    rows = h.functions.filter(text.contains(F.col("name"), pattern))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if file_filter is not None:
        rows = rows.filter(text.contains(F.col("file_path"), file_filter))
    return top(rows.select(*_FUNCTION_COLUMNS), limit, "file_path", "start_line", "name", "kind")


def function_info(h: History, file_path: str, function_name: str) -> DataFrame:
    """At most one definition: the exact path if there is one, else a path containing it."""
    path = F.col("file_path")
    named = h.functions.filter(F.col("name") == function_name)
    ranked = named.select(*_FUNCTION_COLUMNS, (path != file_path).cast("int").alias("distance"))
    near = ranked.filter((path == file_path) | text.contains(path, file_path))
    return top(near, 1, "distance", "file_path", "start_line", "kind").drop("distance")


def show_source(h: History, file_path: str, function_name: str) -> DataFrame:
    """The definition found by :func:`function_info`, with its lines of the HEAD file."""
    found = F.broadcast(function_info(h, file_path, function_name))  # at most one row
    return found.join(h.head_files.select("file_path", "content"), "file_path").select(
        "name", "file_path", "start_line", "end_line", sliced("content").alias("source")
    )


def definition_sources(h: History) -> DataFrame:
    """Every definition with its source lines. The definitions of a file meet its text once, and texts are never
    broadcast: their size is not known before they are made."""
    facts = ["name", "kind", "start_line", "end_line"]
    listed = h.functions.groupBy("file_path").agg(F.collect_list(F.struct(*facts)).alias("listed"))
    heads = h.head_files.select("file_path", "content").hint("merge")
    met = heads.join(listed.hint("merge"), "file_path")
    lines = once(met, {"lines": F.split("content", "\n")}).select("file_path", "listed", "lines")
    described = F.transform("listed", lambda d: F.struct(*[d[f] for f in facts], _between(F.col("lines"), d["start_line"], d["end_line"]).alias("source")))
    return lines.select("file_path", F.inline(described)).select("name", "file_path", "kind", "start_line", "end_line", "source")


def sliced(content: str) -> F.Column:
    return _between(F.split(F.col(content), "\n"), F.col("start_line"), F.col("end_line"))


def _between(lines: F.Column, first: F.Column, last: F.Column) -> F.Column:
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def file_at_commit(h: History, commit: str, file_path: str) -> DataFrame:
    """Content of a file at the commit named by a hash or hash prefix."""
    return h.file_versions.filter(
        F.col("commit_hash").startswith(commit)
        & (F.col("file_path") == file_path)
        & (F.col("after_content") != "")
    ).select(
        F.col("commit_hash").alias("commit"),
        F.col("file_path").alias("file"),
        F.col("after_content").alias("content"),
    )


def source_files(h: History) -> DataFrame:
    """HEAD files in a supported language."""
    return h.head_files.select(
        "file_path", paths.language_of(F.col("file_path")).alias("language"), "content"
    ).filter(F.col("language").isNotNull())


def newest_commits(h: History, max_count: int | None = None) -> DataFrame:
    return top(h.commits, max_count, F.desc("timestamp"), "hash")


def tags(h: History) -> DataFrame:
    return h.tags.orderBy("timestamp", "name")


def files_between(h: History, old_commit: str, new_commit: str) -> DataFrame:
    """Source files touched after one commit, up to another, in (time, hash) order.

    A file that was changed and put back is listed as well.
    """
    at = F.struct("timestamp", "hash")
    bounds = h.commits.agg(
        F.max(F.when(F.col("hash") == old_commit, at)).alias("low"),
        F.max(F.when(F.col("hash") == new_commit, at)).alias("high"),
    )
    between = h.commits.join(F.broadcast(bounds)).filter(
        (at > F.col("low")) & (at <= F.col("high"))
    )
    touched = h.commit_files.join(
        between.select(F.col("hash").alias("commit_hash")), "commit_hash", "left_semi"
    )
    listed = touched.filter(paths.is_source(F.col("path"))).select("path").distinct()
    return listed.orderBy("path")


def function_blame(
    h: History, file_path: str | None, function_name: str
) -> DataFrame:
    """Owners of a function: exact path if it has blame, else paths containing it."""
    rows = h.blame_entries.filter(F.col("function_name") == function_name)
    if file_path is not None:
        path = F.col("file_path")
        exact = path == file_path
        rows = rows.filter(exact | text.contains(path, file_path)).withColumn("exact", exact)
        any_exact = rows.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("any_exact"))
        rows = rows.join(F.broadcast(any_exact)).filter(F.col("exact") | ~F.col("any_exact"))
    return rows.select(
        "function_name", "file_path", "author", "line_count", "percentage", "commit_hash"
    ).orderBy(F.desc("percentage"), "file_path", "author")


def commit_changes(h: History, commit: str, contains: str | None = None) -> DataFrame:
    """Function changes of the commit named by a hash or hash prefix."""
    rows = h.function_changes.filter(F.col("commit_hash").startswith(commit))
    return _diff_filter(rows, contains).select(*_DIFF).orderBy("file_path", "function_name")


_DIFF = [
    "function_name", "file_path", "change_type", "lines_added", "lines_removed", "author",
    "commit_hash",
]


def _diff_filter(rows: DataFrame, needle: str | None) -> DataFrame:
    if needle is None:
        return rows
    wanted = F.lit(needle.lower())
    return rows.filter(
        F.contains(F.lower("file_path"), wanted) | F.contains(F.lower("function_name"), wanted)
    )


def range_changes(
    h: History, first: str, last: str, contains: str | None = None
) -> DataFrame:
    """Function changes of the commits dated between two commits, both ends included."""
    ts = F.col("timestamp")
    bounds = h.commits.agg(
        F.min(F.when(F.col("hash").startswith(first), ts)).alias("low"),
        F.max(F.when(F.col("hash").startswith(last), ts)).alias("high"),
    )
    between = (
        h.commits.join(F.broadcast(bounds))  # one row
        .filter(ts.between(F.col("low"), F.col("high")))
        .select(F.col("hash").alias("commit_hash"))
    )
    rows = _diff_filter(h.function_changes, contains).join(between, "commit_hash")
    return rows.orderBy("timestamp", "file_path", "function_name").select(*_DIFF)


def config_history(
    h: History, key_path: str, file_path: str | None = None, limit: int | None = 50
) -> DataFrame:
    rows = h.config_changes.filter(text.contains(F.col("key_path"), key_path))
    if file_path is not None:
        rows = rows.filter(text.contains(F.col("file_path"), file_path))
    rows = rows.select(
        "file_path", "key_path", "change_type", "old_value", "new_value", "author",
        "commit_hash", "timestamp",
    )
    return top(rows, limit, F.desc("timestamp"), "commit_hash", "file_path", "key_path")


def dependency_history(
    h: History,
    package: str | None = None,
    file_filter: str | None = None,
    added: bool = False,
    removed: bool = False,
    bumped: bool = False,
    limit: int | None = 50,
) -> DataFrame:
    """Dependency changes, newest first; at most one of the three type flags."""
    wanted = [
        name for name, on in [("added", added), ("removed", removed), ("bumped", bumped)] if on
    ]
    if len(wanted) > 1:
        raise ValueError("choose one of added, removed, bumped")
    rows = h.dep_changes
    if package is not None:
        rows = rows.filter(text.contains(F.col("package"), package))
    if file_filter is not None:
        rows = rows.filter(text.contains(F.col("file_path"), file_filter))
    if wanted:
        rows = rows.filter(F.col("change_type") == wanted[0])
    rows = rows.select(
        "file_path", "package", "change_type", "old_version", "new_version", "author",
        "commit_hash", "timestamp",
    )
    return top(rows, limit, F.desc("timestamp"), "commit_hash", "file_path", "package")


def primary_owners(blame: DataFrame) -> DataFrame:
    """Largest share per function; equal shares go to the first author by name."""
    best = blame.groupBy("function_name", "file_path").agg(
        F.min(F.struct((-F.col("percentage")).alias("rank"), "author")).alias("best")
    )
    return best.select(
        "function_name", "file_path",
        F.col("best.author").alias("owner"),
        (-F.col("best.rank")).alias("ownership_pct"),
    )


def _owned_functions(functions: DataFrame, h: History) -> DataFrame:
    """Definitions with their main owner, change count and last change."""
    keys = ["function_name", "file_path"]
    owners = primary_owners(h.blame_entries)
    counts = h.function_changes.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("timestamp").alias("last_ts")
    )
    return (
        functions.withColumnRenamed("name", "function_name")
        .join(owners, keys, "left")
        .join(counts, keys, "left")
        .withColumnRenamed("function_name", "name")
        .withColumn("owner", F.coalesce("owner", F.lit("")))
        .withColumn("ownership_pct", F.coalesce("ownership_pct", F.lit(0.0)))
        .withColumn("change_count", F.coalesce("n", F.lit(0)))
    )


def blame_summary(h: History, file_path: str | None = None) -> DataFrame:
    """Functions of a file (or of all files) with main owner and change count."""
    functions, part = h.functions, h
    if file_path is not None:
        same = F.col("file_path") == file_path
        functions = functions.filter(same)
        part = h.with_tables(
            blame_entries=h.blame_entries.filter(same),
            function_changes=h.function_changes.filter(same),
        )
    return (
        _owned_functions(functions, part)
        .select(
            "file_path", "name", "kind", "start_line", "end_line", "language",
            F.col("owner").alias("primary_owner"), "ownership_pct", "change_count",
        )
        .orderBy("file_path", "start_line", "name")
    )


def _report_path(h: History, file_path: str) -> DataFrame:
    """One row: the exact path, else the first path that contains it."""
    path = F.col("file_path")
    hits = h.functions.filter((path == file_path) | text.contains(path, file_path))
    return hits.agg(
        F.min(F.struct((path != file_path).alias("fuzzy"), "start_line", path)).alias("m")
    ).select(F.col("m.file_path").alias("file_path"))


def file_report(h: History, file_path: str, as_of: int) -> dict[str, DataFrame]:
    """``header``: one row of totals. ``functions``: owner, changes and age of each."""
    chosen = F.broadcast(_report_path(h, file_path))  # one row

    def only(table: DataFrame) -> DataFrame:
        return table.join(chosen, "file_path", "left_semi")

    part = h.with_tables(
        blame_entries=only(h.blame_entries), function_changes=only(h.function_changes)
    )
    functions = _owned_functions(only(h.functions), part).select(
        "file_path", "name", "kind", "start_line", "end_line", "owner", "ownership_pct",
        "change_count",
        clock.known(F.col("last_ts")).alias("last_changed"),
        F.when(F.col("last_ts") != 0, F.expr(f"({int(as_of)} - last_ts) div 86400"))
        .otherwise(-1)
        .alias("days_ago"),
    )
    owners = primary_owners(part.blame_entries)
    header = (
        only(h.functions)
        .groupBy("file_path")
        .agg(
            F.min_by("language", "start_line").alias("language"),
            F.count("*").alias("total_functions"),
        )
        .join(part.function_changes.agg(F.count("*").alias("total_changes")))
        .join(owners.agg(F.count_distinct("owner").alias("unique_owners")))
    )
    return {"header": header, "functions": functions.orderBy("start_line", "name")}
