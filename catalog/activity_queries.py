"""Counts, listings and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import clock, paths
from annalist.operators import activity, lookup
from annalist.sources import tables
from catalog.registry import direct, over
from catalog.views import AS_OF, RECENT, history, read

NULL_ZERO = 'nullif("timestamp", 0) AS "timestamp"'


@over("function_changes", sql="""
    SELECT function_name, file_path, change_count, author_count, added, modified, deleted,
           last_ts AS last_changed
    FROM h_profile ORDER BY change_count DESC, function_name, file_path LIMIT 20""")
def hotspots(h):
    return activity.hotspots(h)


@over("function_changes", sql="""
    SELECT function_name, file_path, change_count, author_count, added, modified, deleted,
           last_ts AS last_changed FROM h_profile""")
def change_counts(h):
    return activity.hotspots(h, limit=None)


@over("function_changes", sql=f"""
    SELECT function_name, file_path, count(*) AS change_count, count(DISTINCT author) AS author_count,
           count(*) FILTER (change_type = 'added') AS added,
           count(*) FILTER (change_type = 'modified') AS modified,
           count(*) FILTER (change_type = 'deleted') AS deleted, max("timestamp") AS last_changed
    FROM h_function_changes
    WHERE author = 'dev_7' AND file_path ILIKE '%brand_%' AND "timestamp" >= {RECENT}
    GROUP BY 1, 2""")
def hotspots_filtered(h):
    return activity.hotspots(h, None, author="dev_7", file_filter="Brand_", since=RECENT)


@over("function_changes", sql=f"""
    SELECT author, count(*) AS change_count, count(DISTINCT function_name) AS functions_touched,
           count(DISTINCT file_path) AS files_touched, CAST(sum(lines_added) AS BIGINT) AS total_added,
           CAST(sum(lines_removed) AS BIGINT) AS total_removed, min("timestamp") AS first_commit,
           max("timestamp") AS last_commit
    FROM h_function_changes WHERE author <> '' AND "timestamp" <= {RECENT} GROUP BY 1""")
def authors(h):
    return activity.authors(h, limit=None, until=RECENT)


@over("function_changes", sql=f"""
    SELECT function_name, file_path, count(*) AS change_count, count(DISTINCT author) AS author_count,
           count(*) FILTER (change_type = 'modified') AS modify_count, min("timestamp") AS first_change,
           max("timestamp") AS last_change
    FROM h_function_changes WHERE "timestamp" >= {RECENT}
    GROUP BY 1, 2 HAVING count(*) >= 5 AND count(*) FILTER (change_type = 'modified') >= 3""")
def fragile_functions(h):
    return activity.fragile_functions(h, limit=None, since=RECENT)


@over("function_changes", sql="""
    SELECT function_name, file_path, count(DISTINCT author) AS author_count,
           array_to_string(list_sort(list(DISTINCT author)), ',') AS authors, count(*) AS change_count
    FROM h_function_changes GROUP BY 1, 2 HAVING count(DISTINCT author) >= 2
    ORDER BY author_count DESC, change_count DESC, function_name, file_path LIMIT 20""")
def coauthorship(h):
    return activity.coauthorship(h).withColumn("authors", F.array_join("authors", ","))


@over("function_changes", sql=f"""
    SELECT function_name, file_path, max("timestamp") AS last_changed, count(*) AS change_count
    FROM h_function_changes WHERE "timestamp" >= {AS_OF - 90 * 86400} GROUP BY 1, 2""")
def changed_since(h):
    return activity.changed_since(h, clock.parse_date_filter("90d", AS_OF), limit=None)


_LAST = """
    SELECT function_name, file_path, max("timestamp") AS last_ts, count(*) AS n
    FROM h_function_changes GROUP BY 1, 2"""


@over("functions", "function_changes", sql=f"""
    SELECT name, f.file_path, kind, last_ts AS last_changed,
           CASE WHEN last_ts > 0 THEN ({AS_OF} - last_ts) // 86400 ELSE -1 END AS days_ago,
           coalesce(n, 0) AS change_count
    FROM h_functions f LEFT JOIN ({_LAST}) c ON c.function_name = f.name AND c.file_path = f.file_path""")
def function_ages(h):
    return activity.function_ages(h, AS_OF, limit=None)


@over("functions", "function_changes", sql=f"""
    SELECT name, f.file_path, kind, last_ts AS last_changed,
           CASE WHEN last_ts > 0 THEN ({AS_OF} - last_ts) // 86400 ELSE -1 END AS days_ago,
           coalesce(n, 0) AS change_count
    FROM h_functions f LEFT JOIN ({_LAST}) c ON c.function_name = f.name AND c.file_path = f.file_path
    WHERE f.file_path ILIKE '%test%'
    ORDER BY last_ts IS NULL DESC, last_ts DESC, f.file_path, name, kind, start_line LIMIT 50""")
def function_ages_recent(h):
    return activity.function_ages(h, AS_OF, file_filter="test", recent_first=True)


@over("functions", "function_changes", sql=f"""
    SELECT f.name AS function_name, f.file_path, min(kind) AS kind, min(language) AS language,
           max(c."timestamp") AS last_changed, count(c."timestamp") AS total_changes
    FROM h_functions f LEFT JOIN h_function_changes c
      ON c.function_name = f.name AND c.file_path = f.file_path AND c."timestamp" >= {RECENT}
    GROUP BY 1, 2""")
def stale_functions(h):
    return activity.stale_functions(h, limit=None, since=RECENT)


@over("commits", "function_changes", sql="SELECT * FROM h_timeline")
def timeline(h):
    return activity.timeline(h, AS_OF, months=120)


@over("function_changes", sql=f"""
    SELECT CASE WHEN instr(file_path, '/') > 0 THEN split_part(file_path, '/', 1) ELSE '.' END AS directory,
           month, count(*) AS changes
    FROM h_month_changes WHERE "timestamp" >= {AS_OF - 24 * 30 * 86400} GROUP BY 1, 2""")
def churn(h):
    return activity.churn(h, AS_OF, months=24)


@over("functions", sql="SELECT language, count(*) AS count FROM h_functions GROUP BY 1")
def languages(h):
    return activity.languages(h)


@over("function_changes", sql="""
    SELECT 'economy' AS file_path, min("timestamp") AS first_commit, max("timestamp") AS last_commit,
           count(*) AS total_changes, count(DISTINCT author) AS unique_authors,
           count(*) FILTER (change_type = 'added') AS functions_added,
           count(*) FILTER (change_type = 'modified') AS functions_modified,
           count(*) FILTER (change_type = 'deleted') AS functions_deleted,
           count(DISTINCT function_name) AS unique_functions
    FROM h_function_changes WHERE file_path ILIKE '%economy%' HAVING count(*) > 0""")
def file_lifecycle(h):
    return activity.file_lifecycle(h, "economy")


@over("function_changes", sql="""
    SELECT month, count(*) AS new_functions,
           array_to_string(list_slice(list_sort(list(DISTINCT file_path)), 1, 10), ',') AS new_files,
           coalesce(array_to_string(list_slice(list_sort(list(DISTINCT regexp_extract(file_path, '^(.*/)', 1))
             FILTER (contains(file_path, '/'))), 1, 10), ','), '') AS expanding_areas,
           CAST(sum(count(*)) OVER (ORDER BY month) AS BIGINT) AS cumulative_functions
    FROM h_month_changes WHERE change_type = 'added' GROUP BY month""")
def feature_expansion(h):
    lists = {c: F.array_join(c, ",") for c in ["new_files", "expanding_areas"]}
    return activity.feature_expansion(h).withColumns(lists)


@over("commits", sql="""
    SELECT month, row_number() OVER (PARTITION BY month ORDER BY "timestamp", hash) AS position,
           message, author, hash FROM h_month_commits""")
def commits_by_month(h):
    return activity.commits_by_month(h)


@over("commits", "functions", "function_changes", "blame_entries", sql="""
    SELECT (SELECT count(*) FROM h_commits) AS commits, (SELECT count(*) FROM h_functions) AS functions,
           (SELECT count(*) FROM h_function_changes) AS changes,
           (SELECT count(*) FROM h_blame_entries) AS blame_entries""")
def index_stats(h):
    return activity.stats(h)


@over("function_changes", sql="""
    WITH target AS (SELECT DISTINCT commit_hash FROM h_function_changes
                    WHERE function_name = 'red_widget_1')
    SELECT function_name, file_path, count(*) AS co_change_count,
           (SELECT count(*) FROM target) AS total_target_commits,
           CAST(printf('%.2f', count(*) / (SELECT count(*) FROM target)) AS DOUBLE) AS coupling_ratio
    FROM h_function_changes WHERE commit_hash IN (FROM target) AND function_name <> 'red_widget_1'
    GROUP BY 1, 2""")
def coupled_functions(h):
    return activity.coupled_functions(h, "red_widget_1", limit=None)


_TEST = " OR ".join(f"{{}} ILIKE '{p}'" for p in paths.TEST_PATTERNS)


@over("function_changes", sql=f"""
    WITH changes AS MATERIALIZED (SELECT *, {_TEST.format(*["file_path"] * 4)} AS is_test FROM h_function_changes),
    tested AS MATERIALIZED (SELECT DISTINCT commit_hash FROM changes WHERE is_test)
    SELECT function_name, file_path, commit_hash, change_type, author, "timestamp", message
    FROM changes c
    WHERE NOT is_test AND NOT EXISTS (SELECT 1 FROM tested t WHERE t.commit_hash = c.commit_hash)""")
def untested_changes(h):
    return activity.untested_changes(h, limit=None)


@over("functions", "function_changes", sql="""
    SELECT function_name, file_path, max("timestamp") AS deleted_at,
           max({t: "timestamp", a: author}).a AS author
    FROM h_function_changes c
    WHERE change_type = 'deleted' AND NOT EXISTS (
        SELECT 1 FROM h_functions f WHERE f.name = c.function_name AND f.file_path = c.file_path)
    GROUP BY 1, 2""")
def deleted_functions(h):
    return activity.deleted_functions(h, limit=None)


# ---- lookups -------------------------------------------------------------------


@over("commits", sql="""
    SELECT hash, author, "timestamp", message, files_changed FROM h_commits
    ORDER BY "timestamp" DESC, hash LIMIT 500""")
def newest_commits(h):
    return lookup.newest_commits(h, 500).drop("semantic_tags")


@over("commits", "function_changes", sql=f"""
    SELECT hash, author, "timestamp", message, files_changed FROM h_commits
    WHERE hash IN (SELECT commit_hash FROM h_function_changes
                   WHERE file_path ILIKE '%economy%' AND function_name ILIKE '%widget%')
      AND author ILIKE '%dev_1%' AND message ILIKE '%high%' AND "timestamp" <= {RECENT}""")
def commits_filtered(h):
    return lookup.commits(
        h, None, file_filter="economy", function_filter="Widget", author_filter="DEV_1",
        message_filter="high", until=RECENT,
    )


@over("commits", sql="""
    SELECT hash, author, "timestamp", message, files_changed FROM h_commits
    WHERE regexp_matches(message, '^(Fix|Add) [12]-')""")
def commits_by_regex(h):
    return lookup.commits(h, None, message_filter="^(Fix|Add) [12]-")


@over("commits", sql="""
    SELECT hash, author, "timestamp", message, files_changed FROM h_commits
    WHERE hash = md5('77')""")
def one_commit(h):
    return lookup.commit(h, "28dd2c7955ce926456240b2ff0100bde").drop("semantic_tags")


@over("commit_files", sql="""
    SELECT folder || '/part_' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '.py' ELSE '.rs' END AS path,
           q AS insertions, q % 9 AS deletions, q + q % 9 AS lines
    FROM h_versions WHERE commit_hash = md5('77')""")
def files_of_commit(h):
    return lookup.commit_files(h, "28dd2c7955ce926456240b2ff0100bde")


@over("commits", sql="SELECT hash FROM h_commits")
def indexed_hashes(h):
    return lookup.indexed_hashes(h)


@over("functions", sql="""
    SELECT name, file_path, language, start_line, end_line, kind, signature FROM h_functions
    WHERE name ILIKE '%_ring_1%' AND kind = 'method' AND file_path ILIKE '%small%'""")
def find_functions(h):
    return lookup.find_functions(h, "_ring_1", kind="method", file_filter="small", limit=None)


@over("functions", sql="""
    SELECT name, file_path, language, start_line, end_line, kind, signature FROM h_functions
    WHERE file_path = (SELECT min(file_path) FROM h_functions)""")
def functions_in_file(h):
    first = h.functions.agg(F.min("file_path")).first()[0]
    return lookup.functions_in_file(h, first)


@over("functions", sql="""
    SELECT name, file_path, language, start_line, end_line, kind, signature FROM h_functions
    WHERE name = 'red_widget_1' AND file_path ILIKE '%brand%'
    ORDER BY file_path, start_line, kind LIMIT 1""")
def function_info(h):
    return lookup.function_info(h, "brand", "red_widget_1")


@over("blame_entries", sql="""
    SELECT function_name, file_path, author, line_count, percentage, commit_hash FROM h_blame_entries
    WHERE function_name = 'red_widget_1' AND file_path ILIKE '%brand%'""")
def function_blame(h):
    return lookup.function_blame(h, "brand", "red_widget_1")


def _last_named(rows, name: str) -> tuple[str, str]:
    """The last path of *rows*, and the first name in it."""
    path = rows.agg(F.max("file_path")).first()[0]
    return path, rows.filter(F.col("file_path") == path).agg(F.min(name)).first()[0]


_LAST_PATH = "(SELECT max(file_path) FROM {0})"
_LAST_NAME = "(SELECT min({1}) FROM {0} WHERE file_path = (SELECT max(file_path) FROM {0}))"


@over("functions", sql=f"""
    SELECT name, file_path, language, start_line, end_line, kind, signature FROM h_functions
    WHERE file_path = {_LAST_PATH.format('h_functions')} AND name = {_LAST_NAME.format('h_functions', 'name')}
    ORDER BY start_line, kind LIMIT 1""")
def function_info_exact(h):
    return lookup.function_info(h, *_last_named(h.functions, "name"))


@over("blame_entries", sql=f"""
    SELECT function_name, file_path, author, line_count, percentage, commit_hash FROM h_blame_entries
    WHERE file_path = {_LAST_PATH.format('h_blame_entries')} AND function_name = {_LAST_NAME.format('h_blame_entries', 'function_name')}""")
def function_blame_exact(h):
    return lookup.function_blame(h, *_last_named(h.blame_entries, "function_name"))


_DIFF = "function_name, file_path, change_type, lines_added, lines_removed, author, commit_hash"


@over("function_changes", sql=f"""
    SELECT {_DIFF} FROM h_function_changes WHERE starts_with(commit_hash, '28')""")
def commit_diff(h):
    return lookup.commit_changes(h, "28")


@over("commits", "function_changes", sql=f"""
    SELECT {_DIFF} FROM h_function_changes WHERE commit_hash IN (
        SELECT hash FROM h_commits WHERE "timestamp" BETWEEN
            (SELECT min("timestamp") FROM h_commits WHERE starts_with(hash, '28dd2c79'))
        AND (SELECT max("timestamp") FROM h_commits WHERE starts_with(hash, '28')))
      AND (contains(lower(file_path), 'brand') OR contains(lower(function_name), 'brand'))""")
def range_diff(h):
    return lookup.range_changes(h, "28dd2c79", "28", contains="Brand")


@over("blame_entries", sql="SELECT function_name, file_path, owner, ownership_pct FROM h_owners")
def primary_owners(h):
    return lookup.primary_owners(h.blame_entries)


_COUNTS = "SELECT function_name, file_path, count(*) AS n, max(\"timestamp\") AS last_ts FROM h_function_changes GROUP BY 1, 2"


@over("functions", "blame_entries", "function_changes", sql=f"""
    SELECT f.file_path, name, kind, start_line, end_line, language, coalesce(owner, '') AS primary_owner,
           coalesce(ownership_pct, 0.0) AS ownership_pct, coalesce(n, 0) AS change_count
    FROM h_functions f
    LEFT JOIN h_owners o ON o.function_name = f.name AND o.file_path = f.file_path
    LEFT JOIN ({_COUNTS}) c ON c.function_name = f.name AND c.file_path = f.file_path""")
def blame_summary(h):
    return lookup.blame_summary(h)


_REPORT = """
    (SELECT file_path FROM h_functions WHERE file_path ILIKE '%brand_1%'
     ORDER BY start_line, file_path LIMIT 1)"""


_REPORT_ROWS = f"""
    SELECT f.file_path, name, kind, start_line, end_line, coalesce(owner, '') AS owner,
           coalesce(ownership_pct, 0.0) AS ownership_pct, coalesce(n, 0) AS change_count,
           last_ts AS last_changed,
           CASE WHEN last_ts > 0 THEN ({AS_OF} - last_ts) // 86400 ELSE -1 END AS days_ago
    FROM h_functions f
    LEFT JOIN h_owners o ON o.function_name = f.name AND o.file_path = f.file_path
    LEFT JOIN ({_COUNTS}) c ON c.function_name = f.name AND c.file_path = f.file_path
    WHERE f.file_path = """


@over("functions", "blame_entries", "function_changes", sql=_REPORT_ROWS + _REPORT)
def file_report_functions(h):
    return lookup.file_report(h, "brand_1", AS_OF)["functions"]


@over("functions", "blame_entries", "function_changes", sql=_REPORT_ROWS + _LAST_PATH.format("h_functions"))
def file_report_exact(h):
    return lookup.file_report(h, _last_named(h.functions, "name")[0], AS_OF)["functions"]


@over("functions", "blame_entries", "function_changes", sql=f"""
    SELECT file_path, arg_min(language, start_line) AS language, count(*) AS total_functions,
           (SELECT count(*) FROM h_function_changes WHERE file_path = {_REPORT}) AS total_changes,
           (SELECT count(DISTINCT owner) FROM h_owners WHERE file_path = {_REPORT}) AS unique_owners
    FROM h_functions WHERE file_path = {_REPORT} GROUP BY 1""")
def file_report_header(h):
    return lookup.file_report(h, "brand_1", AS_OF)["header"]


@over("tags", sql="""SELECT name, hash, "timestamp", author, message FROM h_tags""")
def tags(h):
    return lookup.tags(h)


@over("commits", "commit_files", sql="""
    SELECT DISTINCT folder || '/part_' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '.py' ELSE '.rs' END AS path
    FROM h_versions WHERE commit_hash IN (
        SELECT c.hash FROM h_commits c, (SELECT * FROM h_commits WHERE hash = md5('0')) a,
               (SELECT * FROM h_commits WHERE hash = md5('3')) b
        WHERE (c."timestamp", c.hash) > (least(a."timestamp", b."timestamp"),
                                         CASE WHEN a."timestamp" < b."timestamp" THEN a.hash ELSE b.hash END)
          AND (c."timestamp", c.hash) <= (greatest(a."timestamp", b."timestamp"),
                                          CASE WHEN a."timestamp" < b."timestamp" THEN b.hash ELSE a.hash END))""")
def files_between(h):
    ends = h.commits.filter(F.col("hash").isin(_MD5_0, _MD5_3)).orderBy("timestamp").collect()
    return lookup.files_between(h, ends[0]["hash"], ends[1]["hash"])


_MD5_0 = "cfcd208495d565ef66e7dff9f98764da"
_MD5_3 = "eccbc87e4b5ce2fe28308fd9f2a7baf3"


# ---- scalar functions over whole columns -----------------------------------------


@direct(sql="""
    SELECT DISTINCT url AS path,
           CASE WHEN instr(url, '/') > 0 THEN split_part(url, '/', 1) ELSE '.' END AS top,
           regexp_extract(url, '^(.*/)', 1) AS parent,
           (url ILIKE '%test_%' OR url ILIKE '%_test.%' OR url ILIKE '%.test.%' OR url ILIKE '%__tests__%') AS test
    FROM pages""")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(
        url.alias("path"),
        paths.top_directory(url).alias("top"),
        paths.parent_directory(url).alias("parent"),
        paths.is_test(url).alias("test"),
    ).distinct()


@direct(sql=f"""
    SELECT event_id, {AS_OF} - (event_id % 400) * CASE event_id % 3 WHEN 0 THEN 86400 WHEN 1 THEN 30 * 86400
                                                               ELSE 365 * 86400 END AS since
    FROM events WHERE event_id % 4 <> 3
    UNION ALL
    SELECT event_id, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) FROM events WHERE event_id % 4 = 3""")
def date_filters(spark, sf_dir):
    key = F.col("event_id")
    units = F.array(F.lit("d"), F.lit("m"), F.lit("y"))
    spans = F.concat((key % 400).cast("string"), F.element_at(units, (key % 3 + 1).cast("int")))
    value = F.when(key % 4 == 3, F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd")).otherwise(spans)
    return read(spark, sf_dir, "events").select(
        "event_id", clock.date_filter(value, AS_OF).alias("since")
    )


@direct(sql="""
    SELECT name, file_path, kind, start_line, language, end_line, signature
    FROM (SELECT *, row_number() OVER (PARTITION BY name, file_path, kind, start_line
                                       ORDER BY end_line DESC) AS r
          FROM (SELECT * FROM h_functions UNION ALL
                SELECT name, file_path, language, start_line, end_line + 1, kind, signature, docstring
                FROM h_functions WHERE start_line % 3 = 0)) WHERE r = 1""")
def upsert_functions(spark, sf_dir):
    stored = history(spark, sf_dir, "functions").functions
    update = stored.filter(F.col("start_line") % 3 == 0).withColumn("end_line", F.col("end_line") + 1)
    return tables.upsert("functions", stored, update).select(
        "name", "file_path", "kind", "start_line", "language", "end_line", "signature"
    )


@direct(sql="""
    SELECT name, file_path, kind, start_line, language, end_line, signature FROM h_functions
    WHERE file_path NOT IN (SELECT file_path FROM h_functions WHERE name ILIKE '%ring%')
    UNION ALL
    SELECT name, file_path, kind, start_line, language, end_line, signature FROM h_functions
    WHERE name ILIKE '%ring%'""")
def replace_files(spark, sf_dir):
    stored = history(spark, sf_dir, "functions").functions
    fresh = stored.filter(F.col("name").ilike("%ring%"))
    return tables.replace_files(stored, fresh, fresh.select("file_path")).select(
        "name", "file_path", "kind", "start_line", "language", "end_line", "signature"
    )
