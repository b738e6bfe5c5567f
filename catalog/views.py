"""The sample tables seen as a code history: once as DataFrames, once as SQL text.

Orders are commits, parts are functions, line items are changes and blame lines. File
contents, manifests and configuration files are built per row from the same tables, so
every query grows with them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist import History
from annalist.functions import paths
from annalist.operators import ownership, search
from catalog import sources

AS_OF = 996710400  # 2001-08-02, the day after the last order
RECENT = 946684800  # 2000-01-01

View = Callable[[SparkSession, str], DataFrame]
VIEWS: dict[str, View] = {}


def view(function: View) -> View:
    VIEWS[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return sources.read(spark, sf_dir, table)


def history(spark: SparkSession, sf_dir: str, *tables: str) -> History:
    return History(**{name: VIEWS[name](spark, sf_dir) for name in tables})


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock time, whatever the session time zone."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86400
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def commit_id(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


# Opening word of the message by order key modulo 8.
_OPENINGS = ["Fix", "Add", "Refactor", "Docs", "Test", "Config", "Remove", "Update"]


def _commit_columns() -> list[Column]:
    key = F.col("o_orderkey")
    words = F.array(*map(F.lit, _OPENINGS))
    return [
        F.concat(F.lit("dev_"), (F.col("o_custkey") % 40).cast("string")).alias("author"),
        epoch(F.col("o_orderdate")).alias("timestamp"),
        F.concat_ws(
            " ", F.element_at(words, (key % 8 + 1).cast("int")), "o_orderpriority"
        ).alias("message"),
    ]


@view
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits_of(read(spark, sf_dir, "orders"))


def _commits_of(orders: DataFrame) -> DataFrame:
    return orders.select(
        commit_id("o_orderkey").alias("hash"),
        *_commit_columns(),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("files_changed"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    brand = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    kind = F.lower("p_type")
    path = (
        F.when(key % 10 == 0, F.concat(F.lit("tests/test_"), brand, F.lit(".py")))
        .when(key % 13 == 0, F.concat(F.lit("main_"), kind, F.lit(".py")))
        .otherwise(F.concat(kind, F.lit("/"), brand, F.lit(".py")))
    )
    name = F.concat_ws("_", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), (key % 20).cast("string"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_type", name.alias("fn"), path.alias("fp")
    )


@view
def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    start = (key % 97 * 20 + 1).cast("int")
    kinds = F.array(F.lit("class"), F.lit("method"), F.lit("function"))
    return _parts(spark, sf_dir).filter(key % 7 != 0).select(
        F.col("fn").alias("name"),
        F.col("fp").alias("file_path"),
        F.when(F.col("p_type") == "ECONOMY", "python")
        .when(F.col("p_type") == "SMALL", "go")
        .otherwise("rust")
        .alias("language"),
        start.alias("start_line"),
        (start + F.col("p_size")).alias("end_line"),
        F.element_at(kinds, F.col("p_size") % 3 + 1).alias("kind"),
        F.format_string("def %s()", "fn").alias("signature"),
        F.lit("").alias("docstring"),
    )


@view
def function_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(spark, sf_dir, read(spark, sf_dir, "lineitem"))


def changes_of(spark: SparkSession, sf_dir: str, lineitem: DataFrame) -> DataFrame:
    """Changes of the given line items, stored or streamed."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", *_commit_columns())
    parts = _parts(spark, sf_dir).filter(F.col("p_partkey") % 11 != 3)
    kind = (
        F.when(F.col("l_linenumber") == 7, "renamed")
        .when(F.col("l_returnflag") == "A", "added")
        .when(F.col("l_returnflag") == "R", "deleted")
        .otherwise("modified")
    )
    return (
        lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("fn").alias("function_name"),
            F.col("fp").alias("file_path"),
            commit_id("l_orderkey").alias("commit_hash"),
            kind.alias("change_type"),
            F.col("l_quantity").cast("int").alias("lines_added"),
            F.round(F.col("l_tax") * 100).cast("int").alias("lines_removed"),
            "author", "timestamp", "message",
        )
    )


@view
def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 2000 + 1
    first = (
        read(spark, sf_dir, "lineitem")
        .join(_parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("fp").alias("file_path"), number.cast("int").alias("line_number"))
        .agg(F.min("l_orderkey").alias("o_orderkey"))
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", *_commit_columns())
    return first.join(orders, "o_orderkey").select(
        "file_path", "line_number", commit_id("o_orderkey").alias("commit_hash"), "author"
    )


@view
def blame_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.blame_entries(history(spark, sf_dir, "functions", "blame_lines"))


@view
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "orders")
        .filter(F.col("o_orderkey") % 1500 == 0)
        .select(
            F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("name"),
            commit_id("o_orderkey").alias("hash"),
            *_commit_columns(),
        )
    )


@view
def function_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).filter(F.col("p_partkey") % 11 != 3)

    def end(prefix: str, key: str) -> DataFrame:
        return parts.select(
            F.col("p_partkey").alias(key),
            F.col("fn").alias(f"{prefix}_name"),
            F.col("fp").alias(f"{prefix}_file_path"),
        )

    return (
        read(spark, sf_dir, "lineitem")
        .filter(F.col("l_linenumber") == 7)
        .join(end("old", "l_suppkey"), "l_suppkey")
        .join(end("new", "l_partkey"), "l_partkey")
        .select(
            commit_id("l_orderkey").alias("commit_hash"),
            "old_name", "old_file_path", F.lit("function").alias("old_kind"),
            "new_name", "new_file_path", F.lit("function").alias("new_kind"),
            (1 - F.col("l_discount")).alias("confidence"),
        )
    )


@view
def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.versions(spark, sf_dir).select(
        commit_id("l_orderkey").alias("commit_hash"),
        sources.source_path().alias("path"),
        F.col("q").cast("int").alias("insertions"),
        (F.col("q") % 9).cast("int").alias("deletions"),
        (F.col("q") + F.col("q") % 9).cast("int").alias("lines"),
    )


@view
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.versions(spark, sf_dir).select(
        commit_id("l_orderkey").alias("commit_hash"),
        sources.source_path().alias("file_path"),
        sources.before_content().alias("before_content"),
        sources.after_content().alias("after_content"),
    )


@view
def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.config_versions(spark, sf_dir)


@view
def manifest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.manifest_versions(spark, sf_dir)


@view
def head_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources.head_files(spark, sf_dir)
    return files.select(
        "file_path", paths.language_of(F.col("file_path")).alias("language"), "content"
    )


@view
def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even vectors stand for functions, odd ones for commits."""
    key = F.col("vec_id")
    vectors = read(spark, sf_dir, "embeddings").join(
        _parts(spark, sf_dir), key == F.col("p_partkey"), "left"
    )
    is_function = (key % 2 == 0) & F.col("fn").isNotNull()
    named = vectors.select(
        F.when(is_function, "function").otherwise("commit").alias("type"),
        F.when(is_function, F.concat_ws("::", "fn", "fp")).otherwise(commit_id("vec_id")).alias("ref_id"),
        "vec_id", "embedding",
    )
    # names repeat among the parts; the vector with the smallest number stands for all
    return named.groupBy("type", "ref_id").agg(F.min_by("embedding", "vec_id").alias("vector")).select(
        "type", "ref_id", F.lit("").alias("text"), "vector", F.lit("sample-64").alias("model")
    )


@view
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are made of every commit and change, so these rows are spread by count before anything is made of them
    orders = sources.spread(read(spark, sf_dir, "orders"), "o_orderkey")
    items = sources.spread(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    h = history(spark, sf_dir, "functions", "blame_entries")
    return search.documents(h.with_tables(commits=_commits_of(orders), function_changes=changes_of(spark, sf_dir, items)))


# ---- the same views as SQL -----------------------------------------------------

SQL: dict[str, str] = {
    "h_commits": """
        SELECT md5(CAST(o_orderkey AS VARCHAR)) AS hash, 'dev_' || (o_custkey % 40) AS author,
               CAST(epoch(o_orderdate) AS BIGINT) AS "timestamp",
               ['Fix','Add','Refactor','Docs','Test','Config','Remove','Update'][o_orderkey % 8 + 1]
                 || ' ' || o_orderpriority AS message,
               CAST(o_orderkey % 5 + 1 AS INTEGER) AS files_changed
        FROM orders""",
    "h_part": """
        SELECT p_partkey, p_size, p_type, replace(p_name, ' ', '_') || '_' || (p_partkey % 20) AS fn,
               CASE WHEN p_partkey % 10 = 0 THEN 'tests/test_' || lower(replace(p_brand, '#', '')) || '.py'
                    WHEN p_partkey % 13 = 0 THEN 'main_' || lower(p_type) || '.py'
                    ELSE lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '.py' END AS fp
        FROM part""",
    "h_functions": """
        SELECT fn AS name, fp AS file_path,
               CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'SMALL' THEN 'go' ELSE 'rust' END AS language,
               CAST(1 + (p_partkey % 97) * 20 AS INTEGER) AS start_line,
               CAST(1 + (p_partkey % 97) * 20 + p_size AS INTEGER) AS end_line,
               ['class','method','function'][p_size % 3 + 1] AS kind,
               'def ' || fn || '()' AS signature, '' AS docstring
        FROM h_part WHERE p_partkey % 7 <> 0""",
    "h_function_changes": """
        SELECT fn AS function_name, fp AS file_path, hash AS commit_hash,
               CASE WHEN l_linenumber = 7 THEN 'renamed' WHEN l_returnflag = 'A' THEN 'added'
                    WHEN l_returnflag = 'R' THEN 'deleted' ELSE 'modified' END AS change_type,
               CAST(floor(l_quantity) AS INTEGER) AS lines_added,
               CAST(round(l_tax * 100) AS INTEGER) AS lines_removed, author, "timestamp", message
        FROM lineitem JOIN h_part ON l_partkey = p_partkey
        JOIN h_commits ON hash = md5(CAST(l_orderkey AS VARCHAR))
        WHERE p_partkey % 11 <> 3""",
    "h_blame_lines": """
        SELECT file_path, line_number, hash AS commit_hash, author FROM (
            SELECT fp AS file_path, CAST(1 + (l_orderkey * 7 + l_linenumber) % 2000 AS INTEGER) AS line_number,
                   min(l_orderkey) AS k
            FROM lineitem JOIN h_part ON l_partkey = p_partkey GROUP BY 1, 2)
        JOIN h_commits ON hash = md5(CAST(k AS VARCHAR))""",
    "h_blame_full": """
        SELECT function_name, file_path, kind, start_line, end_line, author,
               CAST(sum(n) AS INTEGER) AS line_count,
               arg_max(commit_hash, n * 100000 - low) AS commit_hash,
               CAST(printf('%.1f', sum(n) / total * 100) AS DOUBLE) AS percentage
        FROM (SELECT f.name AS function_name, f.file_path, f.kind, f.start_line, f.end_line, b.author,
                     b.commit_hash, count(*) AS n, min(b.line_number) AS low,
                     sum(count(*)) OVER (PARTITION BY f.name, f.file_path, f.kind, f.start_line, f.end_line) AS total
              FROM h_functions f JOIN h_blame_lines b
                ON b.file_path = f.file_path AND b.line_number BETWEEN f.start_line AND f.end_line
              GROUP BY f.name, f.file_path, f.kind, f.start_line, f.end_line, b.author, b.commit_hash)
        GROUP BY function_name, file_path, kind, start_line, end_line, author, total""",
    "h_blame_entries": """
        SELECT function_name, file_path, author, line_count, percentage, commit_hash FROM h_blame_full""",
    "h_owners": """
        SELECT function_name, file_path, author AS owner, percentage AS ownership_pct FROM (
            SELECT *, row_number() OVER (PARTITION BY function_name, file_path
                                         ORDER BY percentage DESC, author) AS r FROM h_blame_entries)
        WHERE r = 1""",
    "h_tags": """
        SELECT 'v' || o_orderkey AS name, hash, "timestamp", author, message
        FROM orders JOIN h_commits ON hash = md5(CAST(o_orderkey AS VARCHAR))
        WHERE o_orderkey % 1500 = 0""",
    "h_function_renames": """
        SELECT md5(CAST(l_orderkey AS VARCHAR)) AS commit_hash, o.fn AS old_name, o.fp AS old_file_path,
               n.fn AS new_name, n.fp AS new_file_path
        FROM lineitem JOIN h_part o ON l_suppkey = o.p_partkey JOIN h_part n ON l_partkey = n.p_partkey
        WHERE l_linenumber = 7 AND o.p_partkey % 11 <> 3 AND n.p_partkey % 11 <> 3""",
    "h_profile": """
        SELECT function_name, file_path, count(*) AS change_count, count(DISTINCT author) AS author_count,
               count(*) FILTER (change_type = 'added') AS added,
               count(*) FILTER (change_type = 'modified') AS modified,
               count(*) FILTER (change_type = 'deleted') AS deleted,
               min("timestamp") AS first_ts, max("timestamp") AS last_ts
        FROM h_function_changes GROUP BY 1, 2""",
    "h_scores": f"""
        SELECT *, CASE WHEN stability_score >= 0.8 THEN 'stable' WHEN stability_score >= 0.5 THEN 'moderate'
                       WHEN stability_score >= 0.3 THEN 'volatile' ELSE 'critical' END AS rating
        FROM (SELECT f.name AS function_name, f.file_path,
                 CAST(printf('%.3f', (1 - coalesce(change_count / mc, 0)) * 0.5
                     + CASE WHEN last_ts IS NULL THEN 1 ELSE least(({AS_OF} - last_ts) / 86400 / 365, 1) END * 0.3
                     + (1 - coalesce(author_count / ma, 0)) * 0.2) AS DOUBLE) AS stability_score,
                 coalesce(change_count, 0) AS change_count, coalesce(author_count, 0) AS author_count,
                 CASE WHEN last_ts IS NULL THEN 365 ELSE CAST(floor(({AS_OF} - last_ts) / 86400) AS INTEGER) END AS days_ago
              FROM (SELECT DISTINCT name, file_path FROM h_functions) f
              LEFT JOIN h_profile p ON p.function_name = f.name AND p.file_path = f.file_path
              CROSS JOIN (SELECT max(change_count) AS mc, max(author_count) AS ma FROM h_profile))""",
    "h_month_commits": """
        SELECT strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%Y-%m') AS month, * FROM h_commits""",
    "h_month_changes": """
        SELECT strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%Y-%m') AS month, *
        FROM h_function_changes""",
    "h_timeline": f"""
        SELECT coalesce(a.month, b.month) AS month, coalesce(commits, 0) AS commits,
               coalesce(changes, 0) AS changes, coalesce(functions, 0) AS functions,
               coalesce(authors, 0) AS authors
        FROM (SELECT month, count(*) AS changes, count(DISTINCT function_name) AS functions,
                     count(DISTINCT author) AS authors
              FROM h_month_changes WHERE "timestamp" > {AS_OF} - 120 * 30 * 86400 GROUP BY 1) a
        FULL JOIN (SELECT month, count(*) AS commits FROM h_month_commits
                   WHERE "timestamp" > {AS_OF} - 120 * 30 * 86400 GROUP BY 1) b ON a.month = b.month""",
    "h_levels": """
        SELECT t.*, CASE WHEN changes / m > 1.5 THEN 'high' WHEN changes / m >= 0.3 THEN 'normal' ELSE 'low' END AS level
        FROM h_timeline t CROSS JOIN (SELECT CASE WHEN median(changes) = 0 THEN 1 ELSE median(changes) END AS m
                                      FROM h_timeline)""",
    "h_runs": """
        SELECT *, sum(starts) OVER (ORDER BY month) AS run FROM (
            SELECT *, CASE WHEN lag(level) OVER (ORDER BY month) <> level THEN 1 ELSE 0 END AS starts
            FROM h_levels)""",
    "h_phases": """
        SELECT CAST(run AS INTEGER) AS phase_index, start_month, end_month,
               CASE level WHEN 'high' THEN CASE WHEN before = 'low' THEN 'revival' ELSE 'growth' END
                          WHEN 'normal' THEN CASE WHEN before = 'high' THEN 'decline' ELSE 'steady' END
                          ELSE CASE WHEN before IS NULL THEN 'dormant' ELSE 'decline' END END AS phase_type,
               months, total_commits, total_changes, avg_authors
        FROM (SELECT *, lag(level) OVER (ORDER BY run) AS before FROM (
            SELECT run, level, min(month) AS start_month, max(month) AS end_month, count(*) AS months,
                   CAST(sum(commits) AS BIGINT) AS total_commits, CAST(sum(changes) AS BIGINT) AS total_changes,
                   CAST(printf('%.1f', sum(authors) / count(*)) AS DOUBLE) AS avg_authors
            FROM h_runs GROUP BY run, level))""",
    "h_search": """
        SELECT 'commit' AS type, hash[1:8] AS name, '' AS file_path, author, h_split(message) AS content,
               'commit ' || hash[1:8] || ' on '
                 || strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%Y-%m-%d')
                 || ' (' || files_changed || ' files)' AS detail FROM h_commits
        UNION ALL
        SELECT 'function', name, f.file_path, coalesce(owner, ''),
               kind || ' ' || h_split(name) || ' ' || h_split(signature),
               kind || ' in ' || f.file_path || ' lines ' || start_line || '-' || end_line || ' (' || language || ')'
        FROM h_functions f LEFT JOIN h_owners o ON o.function_name = f.name AND o.file_path = f.file_path
        UNION ALL
        SELECT 'change', function_name, file_path, author,
               change_type || ' ' || h_split(function_name) || ' ' || h_split(message),
               change_type || ' +' || lines_added || '/-' || lines_removed || ' in ' || commit_hash[1:8]
        FROM h_function_changes""",
    "h_embeddings": """
        SELECT type, ref_id, arg_min(vector, vec_id) AS vector FROM (
            SELECT vec_id, CASE WHEN vec_id % 2 = 0 AND fn IS NOT NULL THEN 'function' ELSE 'commit' END AS type,
                   CASE WHEN vec_id % 2 = 0 AND fn IS NOT NULL THEN fn || '::' || fp
                        ELSE md5(CAST(vec_id AS VARCHAR)) END AS ref_id, embedding AS vector
            FROM embeddings LEFT JOIN h_part ON vec_id = p_partkey) GROUP BY type, ref_id""",
}


def _split_sql(value: str) -> str:
    """The identifier splitter as a SQL expression over *value*."""
    token_list = rf"regexp_extract_all({value}, '[A-Za-z_][\p{{L}}\p{{N}}_]*')"
    hump = r"t"
    for pattern in [
        "([a-z])([A-Z])", "([A-Z]+)([A-Z][a-z])", r"([a-zA-Z])(\d)", r"(\d)([a-zA-Z])",
    ]:
        hump = rf"regexp_replace({hump}, '{pattern}', '\1 \2', 'g')"
    humps = (
        f"flatten(list_transform({token_list}, lambda t: CASE WHEN contains({hump}, ' ')"
        f" THEN str_split(lower({hump}), ' ') ELSE [] END))"
    )
    snakes = (
        f"flatten(list_transform({token_list}, lambda t: CASE WHEN contains(t, '_')"
        " THEN list_filter(str_split(lower(t), '_'), lambda p: p <> '') ELSE [] END))"
    )
    words = (
        f"list_sort(list_distinct(list_filter({token_list} || {humps} || {snakes},"
        f" lambda w: w <> {value})))"
    )
    return (
        f"CASE WHEN len({words}) = 0 THEN {value}"
        f" ELSE {value} || ' ' || array_to_string({words}, ' ') END"
    )


def sql(query: str) -> str:
    """*query* preceded by the views it names, and those they name."""
    wanted: list[str] = []
    every = {**SQL, **sources.SQL}

    def need(text: str) -> None:
        for name in re.findall(r"\bh_\w+", text):
            if name in every and name not in wanted:
                need(every[name])
                wanted.append(name)

    need(query)
    ctes = ", ".join(f"{name} AS ({every[name]})" for name in wanted)
    body = query.strip()
    for opening in ("WITH RECURSIVE", "WITH"):
        if body.startswith(opening):
            body = f"{opening} {ctes}, {body[len(opening):]}" if wanted else body
            break
    else:
        body = f"WITH {ctes} {body}" if wanted else body
    return re.sub(r"h_split\((\w+)\)", lambda m: _split_sql(m[1]), body)
