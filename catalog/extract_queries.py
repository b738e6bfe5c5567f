"""Change extraction: definitions, function changes, renames, configuration, dependencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from annalist import History
from annalist.functions import paths
from annalist.operators import activity, changes, definitions, documents, lineage, lookup, renames, settings
from catalog.registry import direct, over
from catalog.views import VIEWS, history, read

_PATH = "folder || '/part_' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '.py' ELSE '.rs' END"

_HEAD = """
    SELECT replace(b.name, '{i}', CAST(i AS VARCHAR)) AS name,
           lower(p_type) || '/part_' || p_partkey || '.' || suffix AS file_path, language, kind,
           CAST((i - 1) * size + first AS INTEGER) AS start_line,
           CAST((i - 1) * size + last AS INTEGER) AS end_line,
           replace(signature, '{i}', CAST(i AS VARCHAR)) AS signature
    FROM part JOIN h_blocks b ON b.number = p_partkey % 8, LATERAL (SELECT unnest(range(1, p_size + 1)) AS i)"""


@over("head_files", sql=_HEAD)
def head_functions(h):
    return definitions.head_functions(h).drop("docstring")


@over("head_files", sql="""
    SELECT lower(p_type) || '/part_' || p_partkey || '.' || suffix AS file_path, language
    FROM part JOIN (SELECT DISTINCT number, suffix, language FROM h_blocks) ON number = p_partkey % 8""")
def source_files(h):
    return lookup.source_files(h).select("file_path", "language")


@over("head_files", sql=_HEAD.replace("replace(signature", "replace(source")
      .replace("AS signature", "AS source").replace("language, ", "")
      .replace("h_blocks b", "h_block_sources b"))
def definition_sources(h):
    parsed = h.with_tables(functions=definitions.head_functions(h))
    return lookup.definition_sources(parsed)


@over("head_files", sql="""
    SELECT name, file_path, start_line, end_line, source FROM (""" + _HEAD
      .replace("replace(signature", "replace(source").replace("AS signature", "AS source")
      .replace("h_blocks b", "h_block_sources b") + """)
    WHERE name = 'make_1' AND contains(file_path, 'econ') ORDER BY file_path LIMIT 1""")
def show_source(h):
    parsed = h.with_tables(functions=definitions.head_functions(h))
    return lookup.show_source(parsed, "econ", "make_1")


# ---- function changes -------------------------------------------------------------

# What each kind of edit does to the two definitions of every block (class, function).
_CHANGED = f"""
    WITH b AS (SELECT number, kind, name, first, last, size FROM h_blocks WHERE language IN ('python', 'rust')),
    v AS (SELECT *, {_PATH} AS file_path, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 3 END AS number FROM h_versions),
    d AS (SELECT v.*, b.kind, b.name AS pattern, i,
                 replace(b.name, '{{i}}', CAST(i AS VARCHAR)) AS name
          FROM v JOIN b USING (number), LATERAL (SELECT unnest(range(1, n + 2)) AS i)),
    found AS (
        SELECT commit_hash, file_path, name, kind, 'added' AS change_type FROM d WHERE ln = 1 AND i <= n
        UNION ALL SELECT commit_hash, file_path, name, kind, 'deleted' FROM d WHERE ln = 2 AND i <= n
        UNION ALL SELECT commit_hash, file_path, name, kind, 'modified' FROM d
                  WHERE ln = 3 AND i = 1 AND kind = 'class'
        UNION ALL SELECT commit_hash, file_path, name, kind, 'deleted' FROM d WHERE ln = 4 AND i = n
        UNION ALL SELECT commit_hash, file_path, name, kind, 'deleted' FROM d
                  WHERE ln = 5 AND i = 1 AND kind = 'function'
        UNION ALL SELECT commit_hash, file_path, CASE WHEN number = 0 THEN 'made_1' ELSE 'gone_1' END, kind, 'added'
                  FROM d WHERE ln = 5 AND i = 1 AND kind = 'function'
        UNION ALL SELECT commit_hash, file_path, name, kind, 'modified' FROM d
                  WHERE ln = 5 AND i = 1 AND kind = 'class' AND number = 0
        UNION ALL SELECT commit_hash, file_path, name, kind, 'modified' FROM d WHERE ln = 6 AND i <= n
        UNION ALL SELECT commit_hash, file_path, name, kind, 'added' FROM d WHERE ln = 7 AND i = n + 1)"""


@over("file_versions", sql=_CHANGED + " SELECT * FROM found")
def definition_changes(h):
    return changes.compare(h.file_versions).select(
        "commit_hash", "file_path", "name", "kind", "change_type"
    )


@over("file_versions", "commit_files", "commits")
def extracted_changes(h):
    """Changes after rename and move detection; text similarity has no SQL form."""
    return changes.extract(h)["function_changes"]


@over("file_versions", "commit_files", "commits")
def extracted_renames(h):
    found = changes.extract(h)["function_renames"]
    return found.select("*", "signals.*").drop("signals")


@over("file_versions", "commits", "commit_files", sql=_CHANGED + """
    SELECT commit_hash, file_path, name, change_type, true AS sound FROM found""")
def extracted_ends(h):
    """What changes and renames stand for: every deletion, addition and modification once. A rename is sound if
    its score is the weighted sum of its signals and those of equal names and texts are one."""
    found = changes.extract(h)
    kept = found["function_changes"].filter("change_type <> 'renamed'").select(
        "commit_hash", "file_path", F.col("function_name").alias("name"), "change_type", F.lit(True).alias("sound")
    )
    signal = F.col("signals")
    total = reduce(lambda a, b: a + b, [signal[name] * weight for name, weight in renames.WEIGHTS.items()])
    sound = (
        (F.abs(total - F.col("confidence")) < 0.00051) & (F.col("confidence") >= renames.THRESHOLD)
        & ((signal["name"] == 1.0) == (F.col("old_name") == F.col("new_name")))
        & ((signal["location"] == 1.0) == (F.col("old_file_path") == F.col("new_file_path")))
        & signal["body"].between(0.0, 1.0) & signal["size"].between(0.0, 1.0)
    )
    matched = found["function_renames"].withColumn("sound", sound)
    ends = [
        matched.select("commit_hash", F.col(f"{side}_file_path"), F.col(f"{side}_name"), F.lit(change), "sound")
        for side, change in (("old", "deleted"), ("new", "added"))
    ]
    return kept.union(ends[0]).union(ends[1])


@over("file_versions", "commits", "commit_files", sql=_CHANGED + """,
    newest AS (SELECT hash FROM h_commits ORDER BY "timestamp" DESC, hash LIMIT 2000)
    SELECT commit_hash, file_path, count(*) AS found FROM found
    WHERE commit_hash IN (FROM newest) AND change_type = 'modified' GROUP BY 1, 2""")
def extracted_newest(h):
    rows = changes.extract(h, max_commits=2000)["function_changes"]
    return (
        rows.filter("change_type = 'modified'")
        .groupBy("commit_hash", "file_path")
        .agg(F.count("*").alias("found"))
    )


@over("file_versions", sql=_CHANGED + """
    SELECT o.commit_hash, o.file_path AS old_file_path, o.name AS old_name, o.kind, r.name AS new_name
    FROM found o JOIN found r ON r.commit_hash = o.commit_hash AND r.file_path = o.file_path
      AND r.kind = o.kind AND r.change_type = 'added' AND o.change_type = 'deleted'""")
def renames_in_file(h):
    """The one renamed definition of a file whose other definitions stay."""
    ends = changes.compare(h.file_versions, text=True).filter("change_type <> 'modified'")
    matched = changes.renamed(changes.matched(ends, across=False))
    return matched.select(
        "commit_hash", "old_file_path", "old_name", F.col("old_kind").alias("kind"), "new_name"
    )


@over("file_versions", sql=f"""
    SELECT commit_hash AS commit, {_PATH} AS file, ln FROM h_versions WHERE ln <> 2""")
def files_at_commit(h):
    """Every file of every commit; the content is checked by its edit."""
    rows = h.file_versions.filter(F.col("after_content") != "")
    before, after = F.col("before_content"), F.col("after_content")
    edit = (
        F.when(before == "", 1)
        .when(after.contains("# changed") | after.contains("f32"), 3)
        .when(after.contains("made_1") | after.contains("gone_1"), 5)
        .when(after.rlike("^(# |// )moved"), 6)
        .when(F.length(after) < F.length(before), 4)
        .when(F.length(after) > F.length(before), 7)
    )
    return rows.select(
        F.col("commit_hash").alias("commit"), F.col("file_path").alias("file"), edit.alias("ln")
    )


@over("file_versions", sql=f"""
    SELECT commit_hash AS commit, {_PATH} AS file FROM h_versions
    WHERE commit_hash = md5('77') AND ln <> 2
      AND {_PATH} = (SELECT min({_PATH}) FROM h_versions WHERE commit_hash = md5('77') AND ln <> 2)""")
def file_at_commit(h):
    commit = "28dd2c79"
    first = (
        h.file_versions.filter(F.col("commit_hash").startswith(commit) & (F.col("after_content") != ""))
        .agg(F.min("file_path"))
        .first()[0]
    )
    return lookup.file_at_commit(h, commit, first or "").select("commit", "file")


# ---- configuration ----------------------------------------------------------------

_CONFIG = """
    WITH e AS (
        SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
               lag(CAST(json_extract_string(props, '$.k') AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r,
               'conf/user_' || user_id || CASE user_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.yaml' ELSE '.toml' END AS file_path
        FROM events),
    found AS (
        SELECT file_path, 'user.last.k' AS key_path, event_id,
               CASE WHEN r = 1 THEN 'added' ELSE 'modified' END AS change_type, old AS old_value, k AS new_value
        FROM e WHERE r = 1 OR old <> k
        UNION ALL SELECT file_path, 'flag', event_id, 'added', NULL, 'True' FROM e WHERE r = 1
        UNION ALL SELECT file_path, 'tags', event_id, 'added', NULL, '[1, "a"]' FROM e WHERE r = 1 AND user_id % 3 = 0
        UNION ALL SELECT file_path, 'none', event_id, 'added', NULL, 'null' FROM e WHERE r = 1 AND user_id % 3 = 0),
    stored AS (SELECT f.*, hash AS commit_hash, author, "timestamp", message
               FROM found f JOIN h_commits ON hash = md5(CAST(event_id AS VARCHAR)))"""


def with_versions(spark, sf_dir, view: str) -> History:
    return History(
        commits=VIEWS["commits"](spark, sf_dir), file_versions=VIEWS[view](spark, sf_dir)
    )


@direct(sql=_CONFIG + """
    SELECT file_path, key_path, commit_hash, change_type, old_value, new_value, author, "timestamp", message
    FROM stored""")
def config_changes(spark, sf_dir):
    return settings.config_changes(with_versions(spark, sf_dir, "config_versions"))


@direct(sql=_CONFIG + """
    SELECT key_path, file_path, count(*) AS change_count, max("timestamp") AS last_changed
    FROM stored GROUP BY 1, 2""")
def config_keys(spark, sf_dir):
    h = with_versions(spark, sf_dir, "config_versions")
    return activity.config_keys(h.with_tables(config_changes=settings.config_changes(h)), limit=None)


@direct(sql=_CONFIG + """
    SELECT file_path, key_path, change_type, old_value, new_value, author, commit_hash, "timestamp"
    FROM stored WHERE key_path ILIKE '%last%' AND file_path ILIKE '%user_1%'
    ORDER BY "timestamp" DESC, commit_hash, file_path, key_path LIMIT 50""")
def config_history(spark, sf_dir):
    h = with_versions(spark, sf_dir, "config_versions")
    return lookup.config_history(
        h.with_tables(config_changes=settings.config_changes(h)), "LAST", "user_1"
    )


# ---- dependencies -----------------------------------------------------------------

_DEPS = """
    WITH v AS (SELECT *, l_partkey % 5 AS m,
                      'part_' || l_partkey || '/' || ['requirements.txt', 'package.json', 'pyproject.toml',
                                                      'Cargo.toml', 'go.mod'][l_partkey % 5 + 1] AS file_path,
                      ['==', '', '>=', '', 'v'][l_partkey % 5 + 1] AS mark FROM h_versions),
    found AS (
        SELECT commit_hash, file_path, 'core' AS package, 'removed' AS change_type, mark || '1.0' AS old_version, NULL AS new_version FROM v
        UNION ALL SELECT commit_hash, file_path, 'extra' || (q % 5), 'added', NULL, mark || '0.1' FROM v
        UNION ALL SELECT commit_hash, file_path, 'lib', 'bumped', mark || '2.' || ln, mark || '2.' || (ln + 1) FROM v WHERE q % 2 = 1),
    stored AS (SELECT f.*, author, "timestamp", message FROM found f JOIN h_commits ON hash = commit_hash)"""


def _dependencies(spark, sf_dir) -> History:
    h = with_versions(spark, sf_dir, "manifest_versions")
    return h.with_tables(dep_changes=settings.dependency_changes(h))


@direct(sql=_DEPS + """
    SELECT file_path, package, commit_hash, change_type, old_version, new_version, author, "timestamp", message
    FROM stored""")
def dependency_changes(spark, sf_dir):
    return _dependencies(spark, sf_dir).dep_changes


@direct(sql=_DEPS + """
    SELECT package, file_path, count(*) AS change_count, max("timestamp") AS last_changed,
           count(*) FILTER (change_type = 'bumped') AS bumps, count(*) FILTER (change_type = 'added') AS adds,
           count(*) FILTER (change_type = 'removed') AS removes
    FROM stored GROUP BY 1, 2 ORDER BY change_count DESC, package, file_path LIMIT 100""")
def dependency_summary(spark, sf_dir):
    return activity.dependency_summary(_dependencies(spark, sf_dir))


@direct(sql=_DEPS + """
    SELECT file_path, package, change_type, old_version, new_version, author, commit_hash, "timestamp"
    FROM stored WHERE package ILIKE '%lib%' AND file_path ILIKE '%cargo%' AND change_type = 'bumped'
    ORDER BY "timestamp" DESC, commit_hash, file_path, package LIMIT 50""")
def dependency_history(spark, sf_dir):
    h = _dependencies(spark, sf_dir)
    return lookup.dependency_history(h, package="lib", file_filter="cargo", bumped=True)


# ---- rename chains ----------------------------------------------------------------

_CHAIN = """
    WITH RECURSIVE seeds AS (SELECT DISTINCT file_path AS seed FROM h_function_changes
                             WHERE function_name = 'red_widget_1'),
    back(seed, name, path) AS (
        SELECT seed, 'red_widget_1', seed FROM seeds
        UNION SELECT seed, old_name, old_file_path FROM back
              JOIN h_function_renames ON new_name = name AND new_file_path = path),
    forth(seed, name, path) AS (
        SELECT seed, 'red_widget_1', seed FROM seeds
        UNION SELECT f.seed, new_name, new_file_path FROM forth f
              JOIN h_function_renames ON old_name = f.name AND old_file_path = f.path
              WHERE NOT EXISTS (SELECT 1 FROM back b WHERE b.seed = f.seed AND b.name = new_name
                                                       AND b.path = new_file_path)),
    nodes AS (SELECT DISTINCT name, path FROM (FROM back UNION ALL FROM forth))
    SELECT function_name, file_path, commit_hash, r.change_type AS change_type, r.lines_added AS lines_added,
           r.lines_removed AS lines_removed, r.author AS author, r.ts AS "timestamp", r.message AS message
    FROM (SELECT function_name, file_path, commit_hash,
                 min({change_type: change_type, lines_added: lines_added, lines_removed: lines_removed,
                      author: author, ts: "timestamp", message: message}) AS r
          FROM h_function_changes JOIN nodes ON name = function_name AND path = file_path
          GROUP BY 1, 2, 3)"""


@over("function_changes", "function_renames", sql=_CHAIN)
def history_by_name(h):
    return lineage.history_by_name(h, "red_widget_1")


@over("function_changes", "function_renames", sql=_CHAIN.replace(
    "SELECT DISTINCT file_path AS seed FROM h_function_changes\n                             WHERE function_name = 'red_widget_1'",
    "SELECT min(file_path) AS seed FROM h_function_changes WHERE function_name = 'red_widget_1'"))
def function_history(h):
    name = "red_widget_1"
    seed = h.function_changes.filter(F.col("function_name") == name).agg(F.min("file_path")).first()[0]
    return lineage.function_history(h, name, seed)


@over("function_changes", sql="""
    SELECT function_name, file_path, commit_hash, change_type, lines_added, lines_removed, author,
           "timestamp", message
    FROM h_function_changes WHERE function_name = 'red_widget_1' AND file_path ILIKE '%brand%'""")
def function_history_fuzzy(h):
    return lineage.function_history(h, "red_widget_1", "brand", fuzzy=True)


# ---- project documents --------------------------------------------------------------


def _changelog(spark, sf_dir):
    key = F.col("doc_id")
    heading = F.concat(
        F.lit("\n## [v1."), (key % 9).cast("string"), F.lit(".2] - 2024-0"), (key % 9 + 1).cast("string"),
        F.lit("-17) — "), F.col("source"), F.lit("\n"),
    )
    last = F.concat(F.lit("\n##  2."), (key % 5).cast("string"), F.lit(" (2025-11-16) -"), F.col("lang"))
    return read(spark, sf_dir, "documents").select(
        key, F.concat(F.col("text"), heading, F.col("text"), last, heading, last).alias("content")
    )


@direct(sql="""
    SELECT doc_id, position, version, date, title FROM documents, LATERAL (
        VALUES (1, '1.' || (doc_id % 9) || '.2', '2024-0' || (doc_id % 9 + 1) || '-17', '— ' || source),
               (2, '2.' || (doc_id % 5), '2025-11-16', '-' || lang),
               (3, '1.' || (doc_id % 9) || '.2', '2024-0' || (doc_id % 9 + 1) || '-17', '— ' || source),
               (4, '2.' || (doc_id % 5), '2025-11-16', '')) m(position, version, date, title)""")
def changelog_milestones(spark, sf_dir):
    return documents.milestones(_changelog(spark, sf_dir), "doc_id", "content")


@direct(sql=r"""
    WITH l AS (SELECT doc_id, unnest(list_transform(str_split('# Title' || chr(10) || '==' || chr(10) || text, chr(10)),
                             lambda x: regexp_replace(x, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g'))) AS line,
                      generate_subscripts(str_split('# Title' || chr(10) || '==' || chr(10) || text, chr(10)), 1) AS i
               FROM documents),
    f AS (SELECT doc_id, min(i) AS first FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '=')
          GROUP BY 1),
    s AS (SELECT l.doc_id, min(i) AS stop FROM l JOIN f USING (doc_id) WHERE i > first AND line = '' GROUP BY 1)
    SELECT doc_id, coalesce(substring(string_agg(line, ' ' ORDER BY i)
             FILTER (i >= first AND i < coalesce(stop, 1000000000)), 1, 500), '') AS description
    FROM l LEFT JOIN f USING (doc_id) LEFT JOIN s USING (doc_id) GROUP BY 1""")
def project_descriptions(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("# Title\n==\n"), "text").alias("content")
    )
    return documents.descriptions(texts, "doc_id", "content")


@direct(sql="""
    SELECT count(*) AS doc_count,
           array_to_string(list_slice(list_sort(list(doc_id || '.md')), 1, 10), ',') AS doc_names
    FROM documents WHERE lang = 'en'""")
def documentation_inventory(spark, sf_dir):
    folder = F.when(F.col("lang") == "en", "docs/").otherwise("docs/other/")
    files = read(spark, sf_dir, "documents").select(
        F.concat(folder, F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"),
        F.col("text").alias("content"),
    )
    found = documents.project_context(files)
    names = found["doc_names"].agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("doc_names"))
    return found["doc_count"].join(names)


@direct(sql=f"""
    SELECT DISTINCT file_path, language, false AS config, false AS manifest FROM (
        SELECT lower(p_type) || '/part_' || p_partkey || '.' || suffix AS file_path, language
        FROM part JOIN (SELECT DISTINCT number, suffix, language FROM h_blocks) ON number = p_partkey % 8)
    UNION ALL
    SELECT DISTINCT 'conf/user_' || user_id || CASE user_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.yaml' ELSE '.toml' END,
           NULL, true, false FROM events
    UNION ALL
    SELECT 'part_' || p_partkey || '/' || ['requirements.txt', 'package.json', 'pyproject.toml', 'Cargo.toml', 'go.mod'][p_partkey % 5 + 1],
           NULL, p_partkey % 5 IN (1, 2, 3), true
    FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def file_kinds(spark, sf_dir):
    h = history(spark, sf_dir, "head_files")
    listed = h.head_files.select("file_path")
    for view in ("config_versions", "manifest_versions"):
        versions = with_versions(spark, sf_dir, view).file_versions
        listed = listed.unionByName(versions.select("file_path").distinct())
    path = F.col("file_path")
    return listed.select(
        path,
        paths.language_of(path).alias("language"),
        paths.is_config(path).alias("config"),
        paths.is_manifest(path).alias("manifest"),
    )
