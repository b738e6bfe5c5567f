"""Ownership, releases, stability, risks, phases and report facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import activity, lineage, ownership, phases, releases, reports, stability
from annalist.session import shared_folder
from annalist.sources import tables
from catalog.registry import direct, over
from catalog.views import AS_OF, history

LAST_TAG = "SELECT hash FROM h_tags ORDER BY \"timestamp\" DESC, name DESC LIMIT 1"


@over("functions", "blame_lines", sql="""
    SELECT f.name AS function_name, f.file_path, f.start_line, b.line_number, b.author
    FROM h_functions f JOIN h_blame_lines b
      ON b.file_path = f.file_path AND b.line_number BETWEEN f.start_line AND f.end_line""")
def lines_in_functions(h):
    return ownership.lines_in_functions(h).select(
        "function_name", "file_path", "start_line", "line_number", "author"
    )


@over("functions", "blame_lines", sql="""
    SELECT function_name, file_path, kind, start_line, author, line_count, percentage, commit_hash
    FROM h_blame_full""")
def blame_by_definition(h):
    return ownership.blame_by_definition(h).select(
        "function_name", "file_path", "kind", "start_line", "author", "line_count", "percentage",
        "commit_hash",
    )


# The sample spreads its lines over 40 authors, so no directory is dominated; names are cut
# to their first five characters ("dev_1", "dev_2", ...) in the second query to reach 80 %.
_BUS = """
    SELECT directory, author AS dominant_author,
           CAST(printf('%.1f', lines / total_lines * 100) AS DOUBLE) AS percentage, total_lines, author_count
    FROM (SELECT directory, author, CAST(sum(line_count) AS BIGINT) AS lines,
                 CAST(sum(sum(line_count)) OVER (PARTITION BY directory) AS BIGINT) AS total_lines,
                 count(*) OVER (PARTITION BY directory) AS author_count
          FROM (SELECT CASE WHEN instr(file_path, '/') > 0 THEN split_part(file_path, '/', 1) ELSE '.' END AS directory,
                       {author} AS author, line_count FROM h_blame_entries) GROUP BY 1, 2)
    WHERE total_lines > 0 AND lines / total_lines * 100 > 80"""


@over("blame_entries", sql=_BUS.format(author="author"))
def bus_factor(h):
    return ownership.bus_factor(h)


@over("blame_entries", sql=_BUS.format(
    author="CASE WHEN CAST(author[5:] AS INTEGER) % 7 = 0 THEN author ELSE 'core' END"))
def bus_factor_teams(h):
    number = F.substring("author", 5, 4).cast("int")
    team = F.when(number % 7 == 0, F.col("author")).otherwise("core")
    return ownership.bus_factor(h.with_tables(blame_entries=h.blame_entries.withColumn("author", team)))


# ---- releases ------------------------------------------------------------------

_RELEASE_COUNTS = """
    count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'modified') AS modified,
    count(*) FILTER (change_type = 'deleted') AS deleted, count(change_type) AS total,
    count(DISTINCT file_path) AS files_touched, count(DISTINCT c.author) AS authors"""


@over("commits", "tags", "function_changes", sql=f"""
    WITH chain AS (
        SELECT t.name, t.hash, t."timestamp", {{t: n."timestamp", h: n.hash}} AS high,
               lag(t.hash) OVER w AS previous, {{t: o."timestamp", h: o.hash}} AS low
        FROM (SELECT *, lag(hash) OVER (ORDER BY "timestamp", name) AS previous FROM h_tags) t
        JOIN h_commits n ON n.hash = t.hash LEFT JOIN h_commits o ON o.hash = t.previous
        WINDOW w AS (ORDER BY t."timestamp", t.name))
    SELECT k.name, k.hash, k."timestamp", {_RELEASE_COUNTS}
    FROM chain k LEFT JOIN (SELECT c.*, {{t: m."timestamp", h: m.hash}} AS at
                            FROM h_function_changes c JOIN h_commits m ON m.hash = c.commit_hash) c
      ON c.at <= k.high AND (k.previous IS NULL OR c.at > k.low)
    GROUP BY k.name, k.hash, k."timestamp" """)
def release_list(h):
    return releases.releases(h)


@over("commits", "function_changes", sql=f"""
    SELECT {_RELEASE_COUNTS} FROM h_function_changes c JOIN h_commits m ON m.hash = c.commit_hash,
        (SELECT * FROM h_commits WHERE hash = md5('0')) a, (SELECT * FROM h_commits WHERE hash = md5('1400')) b
    WHERE (m."timestamp", m.hash) > (least(a."timestamp", b."timestamp"),
                                     CASE WHEN a."timestamp" < b."timestamp" THEN a.hash ELSE b.hash END)
      AND (m."timestamp", m.hash) <= (greatest(a."timestamp", b."timestamp"),
                                      CASE WHEN a."timestamp" < b."timestamp" THEN b.hash ELSE a.hash END)""")
def release_summary(h):
    ends = h.commits.filter(F.col("hash").isin(F.md5(F.lit("0")), F.md5(F.lit("1400")))).orderBy("timestamp").collect()
    return releases.release_summary(h, ends[1]["hash"], ends[0]["hash"])


@over("commits", "function_changes", sql=f"""
    SELECT {_RELEASE_COUNTS} FROM h_function_changes c JOIN h_commits m ON m.hash = c.commit_hash
    WHERE (m."timestamp", m.hash) <= (SELECT ("timestamp", hash) FROM h_commits WHERE hash = md5('0'))""")
def first_release_summary(h):
    return releases.release_summary(h, "cfcd208495d565ef66e7dff9f98764da")


# ---- stability and risk ----------------------------------------------------------


@over("functions", "function_changes", sql="SELECT * FROM h_scores")
def stability_scores(h):
    return stability.stability(h, AS_OF, limit=None)


@over("functions", "function_changes", sql="""
    SELECT * FROM h_scores ORDER BY stability_score, file_path, function_name LIMIT 30""")
def most_volatile(h):
    return stability.stability(h, AS_OF, volatile_first=True)


_RATINGS = "(VALUES ('stable'), ('moderate'), ('volatile'), ('critical')) r(rating)"


@over("functions", "function_changes", sql=f"""
    SELECT r.rating, count(s.rating) AS functions FROM {_RATINGS}
    LEFT JOIN h_scores s ON s.rating = r.rating GROUP BY 1""")
def stability_distribution(h):
    return stability.distribution(stability.scores(h, AS_OF))


_SAMPLE = """
    (SELECT * FROM h_scores WHERE rating IN ('volatile', 'critical')
     UNION ALL (SELECT * FROM h_scores WHERE rating = 'moderate' AND change_count > 0
                ORDER BY stability_score DESC, file_path, function_name LIMIT 200)
     UNION ALL (SELECT * FROM h_scores WHERE rating = 'stable' AND change_count > 0
                ORDER BY stability_score DESC, file_path, function_name LIMIT 100))"""


@over("functions", "function_changes", sql=f"SELECT * FROM {_SAMPLE}")
def stability_report_sample(h):
    return stability.report_sample(h, AS_OF)


@over("functions", "function_changes", sql="""
    WITH d AS (SELECT rating, count(*) AS n FROM h_scores WHERE change_count > 0 GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS total,
           CAST(round_even(coalesce(sum(n) FILTER (rating = 'stable'), 0) / sum(n) * 100, 0) AS INTEGER) AS stable_pct,
           CAST(coalesce(sum(n) FILTER (rating = 'critical'), 0) AS BIGINT) AS critical,
           CAST(coalesce(sum(n) FILTER (rating = 'volatile'), 0) AS BIGINT) AS volatile FROM d""")
def stability_facts(h):
    return reports.stability_facts(stability.distribution(stability.scores(h, AS_OF), changed_only=True))


_RISKS = f"""
    WITH fragile AS (
        SELECT * FROM h_profile WHERE change_count >= 5 AND modified >= 3),
    shaky AS (SELECT * FROM h_scores WHERE rating IN ('volatile', 'critical')),
    listed AS (
        SELECT 'Fragile function: ' || function_name AS description,
               least(100, CAST(floor(change_count / (SELECT max(change_count) FROM fragile) * 85 + 15) AS INTEGER)) AS severity,
               file_path AS area, 'fragile' AS category, 0 AS kind FROM fragile
        UNION ALL
        SELECT 'Volatile function: ' || function_name,
               least(100, CAST(floor((1 - stability_score) * 90 + 10) AS INTEGER)), file_path, 'volatile', 1 FROM shaky
        UNION ALL
        SELECT 'Bus factor: ' || directory || '/ owned ' || percentage || '% by ' || dominant_author,
               least(80, CAST(floor(percentage * 0.7 + 10) AS INTEGER)), directory || '/', 'bus_factor', 2
        FROM ({_BUS.format(author="author")})
        UNION ALL
        SELECT 'Convergence point: ' || function_name || ' (' || author_count || ' authors, ' || change_count || ' changes)',
               least(75, CAST(author_count * 15 + change_count * 2 AS INTEGER)), file_path, 'convergence', 3
        FROM h_profile WHERE author_count >= 3)"""


@over("functions", "function_changes", "blame_entries", sql=_RISKS + """
    SELECT CAST(row_number() OVER (ORDER BY severity DESC, kind, area, description) AS INTEGER) AS rank,
           description, severity, area, category FROM listed ORDER BY rank LIMIT 10""")
def risks(h):
    return stability.risks(h, AS_OF)


@over("functions", "function_changes", "blame_entries", sql=_RISKS + """
    SELECT description, severity, area, category FROM listed""")
def all_risks(h):
    return stability.risks(h, AS_OF, limit=None)


# ---- phases --------------------------------------------------------------------


def _timeline(h):
    return activity.timeline(h, AS_OF, months=120)


@over("commits", "function_changes", sql="SELECT * FROM h_phases")
def project_phases(h):
    return phases.project_phases(_timeline(h))


_THEME = r"""
    CASE WHEN regexp_matches(m, '(?i)^(?:fix|bug|patch|hotfix|resolve)') THEN 'fix'
         WHEN regexp_matches(m, '(?i)^(?:add|implement|create|new|introduce|enable)') THEN 'feature'
         WHEN regexp_matches(m, '(?i)^(?:refactor|split|modular|reorgan|restructur|consolidat|clean)') THEN 'refactor'
         WHEN regexp_matches(m, '(?i)^(?:doc|readme|changelog|comment|update.*doc)') THEN 'docs'
         WHEN regexp_matches(m, '(?i)^(?:test|spec|assert|coverage)') THEN 'test'
         WHEN regexp_matches(m, '(?i)^(?:config|setup|deploy|ci|build|version|bump)') THEN 'config'
         WHEN regexp_matches(m, '(?i)^(?:remove|delete|deprecate|drop)') THEN 'remove' ELSE 'other' END"""

_THEMES = f"""
    WITH themed AS (SELECT phase_index, "timestamp", hash, m AS message, {_THEME} AS theme
                    FROM (SELECT *, message AS m FROM h_month_commits)
                    JOIN h_phases ON month BETWEEN start_month AND end_month),
    counted AS (SELECT phase_index, theme, count(*) AS commits, min(("timestamp", hash)) AS first
                FROM themed GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY phase_index ORDER BY commits DESC, first) AS rank,
                      row_number() OVER (PARTITION BY phase_index ORDER BY first) AS place FROM counted),
    few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phase_index, theme
                                                        ORDER BY "timestamp", hash) AS r FROM themed) WHERE r <= 3),
    told AS (SELECT phase_index, list_slice(list(few.message ORDER BY CASE WHEN rank = 1 THEN 0 ELSE place END, r), 1, 5) AS samples
             FROM few JOIN ranked USING (phase_index, theme) GROUP BY 1),
    listed AS (SELECT phase_index, string_agg(theme || '=' || commits, ',' ORDER BY theme) AS themes,
                      arg_min(theme, rank) AS dominant_theme FROM ranked GROUP BY 1)"""


@over("commits", "function_changes", sql=_THEMES + """
    SELECT phase_index, themes, dominant_theme, array_to_string(samples, '|') AS sample_messages
    FROM listed JOIN told USING (phase_index)""")
def period_themes(h):
    entry = F.transform(
        F.map_entries("themes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return phases.period_themes(h, phases.project_phases(_timeline(h))).select(
        "phase_index", F.array_join(entry, ",").alias("themes"), "dominant_theme",
        F.array_join("sample_messages", "|").alias("sample_messages"),
    )


@over("commits", sql=f"""
    SELECT {_THEME} AS theme, month, count(*) AS commits
    FROM (SELECT *, message AS m FROM h_month_commits) GROUP BY 1, 2""")
def commit_themes(h):
    return phases.themed_commits(h).groupBy("theme", "month").agg(F.count("*").alias("commits"))


@over("commits", "function_changes", sql="""
    WITH mean AS (SELECT sum(changes) / count(*) AS mean FROM h_timeline)
    SELECT start_month, end_month, phase_type, total_changes,
           CAST(printf('%.1f', total_changes / months / mean) AS DOUBLE) AS intensity
    FROM h_phases, mean WHERE total_changes / months > 2 * mean""")
def activity_bursts(h):
    timeline = _timeline(h)
    return phases.activity_bursts(phases.project_phases(timeline), timeline)


_TITLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in phases.CHAPTER_TITLES.items())


@over("commits", "function_changes", sql=_THEMES + f"""
    SELECT phase_index,
           CASE WHEN start_month = end_month THEN start_month ELSE start_month || ' to ' || end_month END AS period,
           CASE dominant_theme {_TITLES} END || ' (' || upper(phase_type[1]) || phase_type[2:] || ')' AS title,
           months || ' month(s) of ' || phase_type || ' activity with ' || total_commits || ' commits and '
             || total_changes || ' function changes. Dominant activity: ' || dominant_theme || '.' AS summary,
           'A ' || phase_type || ' phase with ' || total_commits || ' commits.' AS significance
    FROM h_phases JOIN listed USING (phase_index)""")
def period_chapters(h):
    spells = phases.project_phases(_timeline(h))
    return phases.chapters(spells, phases.period_themes(h, spells))


@over("commits", "function_changes", sql="""
    SELECT CASE WHEN bool_or(phase_type = 'growth') AND bool_or(phase_type = 'peak') THEN 'growth'
                WHEN bool_or(phase_type = 'revival') THEN 'revival'
                WHEN bool_or(phase_type = 'decline') THEN 'maturation' ELSE 'expansion' END AS arc_type,
           count(*) AS phases FROM h_phases""")
def project_arc(h):
    return phases.project_arc(phases.project_phases(_timeline(h)))


@over("commits", "function_changes", sql="""
    SELECT count(*) AS months, CAST(sum(commits) AS BIGINT) AS total_commits,
           CAST(sum(changes) AS BIGINT) AS total_changes, min(month) AS first_month, max(month) AS last_month,
           (SELECT month FROM h_timeline ORDER BY changes DESC, month LIMIT 1) AS peak_month,
           (SELECT changes FROM h_timeline ORDER BY changes DESC, month LIMIT 1) AS peak_changes,
           (SELECT commits FROM h_timeline ORDER BY changes DESC, month LIMIT 1) AS peak_commits
    FROM h_timeline""")
def timeline_facts(h):
    return phases.timeline_facts(_timeline(h))


@over("commits", "function_changes", sql="""
    SELECT avg(changes) AS avg_changes, avg(authors) AS avg_authors,
           CASE WHEN avg(changes) IS NULL THEN 'unknown'
                WHEN avg(changes) > 50 AND avg(authors) > 2 THEN 'active development'
                WHEN avg(changes) > 20 THEN 'steady iteration' WHEN avg(changes) > 5 THEN 'maintenance'
                WHEN avg(changes) > 0 THEN 'low activity' ELSE 'dormant' END AS phase
    FROM (SELECT * FROM h_timeline ORDER BY month DESC LIMIT 3)""")
def recent_phase(h):
    return reports.recent_phase(_timeline(h))


# ---- report facts ----------------------------------------------------------------

_LEAD = """
    WITH a AS (SELECT author, count(*) AS n FROM h_function_changes WHERE author <> '' GROUP BY 1
               ORDER BY n DESC, author),
    f AS (SELECT count(*) AS contributors, CAST(sum(n) AS BIGINT) AS total_changes,
                 (SELECT author FROM a ORDER BY n DESC, author LIMIT 1) AS top_author, max(n) AS top_changes,
                 CAST(round_even(max(n) / sum(n) * 100, 0) AS INTEGER) AS top_pct FROM a)"""


@over("function_changes", sql=_LEAD + "SELECT *, top_pct > 50 AS dominated FROM f")
def ownership_facts(h):
    return reports.ownership_facts(h)


@over("function_changes", sql=_LEAD + """
    SELECT contributors || ' contributors with ' || total_changes || ' total changes.' AS overview,
           CASE WHEN top_pct > 50 THEN 'Top contributor owns ' || top_pct || '% of all changes.'
                ELSE 'Changes distributed across ' || contributors || ' contributors.' END AS bus_factor,
           top_author || ' leads with ' || top_changes || ' changes (' || top_pct || '% of total)' AS highlight
    FROM f""")
def contributor_facts(h):
    return reports.contributor_facts(h)


@over("function_changes", sql="""
    SELECT function_name, file_path, count(DISTINCT author) AS author_count,
           function_name || ' in ' || file_path || ' (' || count(DISTINCT author) || ' authors: '
             || array_to_string(list_sort(list(DISTINCT author)), ', ') || ')' AS point
    FROM h_function_changes GROUP BY 1, 2 HAVING count(DISTINCT author) >= 2
    ORDER BY author_count DESC, count(*) DESC, function_name, file_path LIMIT 5""")
def convergence_points(h):
    return reports.convergence_points(h)


@over("function_changes", sql="""
    SELECT function_name AS name, file_path AS file,
           'Changed ' || change_count || ' times by ' || author_count || ' author(s).' AS explanation,
           CASE WHEN change_count > 15 THEN 'high' WHEN change_count > 5 THEN 'medium' ELSE 'low' END AS risk
    FROM h_profile ORDER BY change_count DESC, function_name, file_path LIMIT 10""")
def hotspot_notes(h):
    return reports.hotspot_notes(h)


@over("functions", "function_changes", sql="""
    (SELECT 'fragile' AS kind, function_name AS name, file_path AS file,
            'Modified ' || modified || ' times by ' || author_count || ' author(s).' AS observation
     FROM h_profile WHERE change_count >= 5 AND modified >= 3
     ORDER BY change_count DESC, function_name, file_path LIMIT 10)
    UNION ALL
    (SELECT 'stale', name, f.file_path,
            CASE WHEN max(last_ts) IS NULL THEN 'Never changed since indexing.'
                 ELSE 'Last changed ' || strftime(to_timestamp(max(last_ts)) AT TIME ZONE 'UTC', '%Y-%m-%d') || ', '
                      || (max(change_count) * count(*)) || ' total changes.' END
     FROM h_functions f LEFT JOIN h_profile p ON p.function_name = f.name AND p.file_path = f.file_path
     GROUP BY name, f.file_path ORDER BY max(last_ts) NULLS FIRST, name, f.file_path LIMIT 10)""")
def archaeology(h):
    return reports.archaeology(h)


@over("commits", "functions", "function_changes", "blame_entries", sql="""
    SELECT (SELECT count(*) FROM h_functions) AS functions, (SELECT count(*) FROM h_commits) AS commits,
           (SELECT count(*) FROM h_function_changes) AS changes, (SELECT count(*) FROM h_phases) AS phases,
           (SELECT count(*) FROM h_profile WHERE change_count >= 5 AND modified >= 3) AS fragile,
           (SELECT count(*) FROM h_scores WHERE change_count > 0 AND rating IN ('volatile', 'critical')) AS flagged,
           (SELECT count(DISTINCT author) FROM h_function_changes WHERE author <> '') AS contributors""")
def executive_facts(h):
    return reports.executive_facts(h, AS_OF)


_ONE_ROW = ["stats", "project_arc", "timeline_facts", "stability_facts", "ownership_facts",
            "contributor_facts", "executive_facts"]
_SIZES = {
    "timeline": "(SELECT count(*) FROM h_timeline)",
    "hotspots": "least(20, (SELECT count(*) FROM h_profile))",
    "stability": f"(SELECT count(*) FROM {_SAMPLE})",
    "stability_dist": "4",
    "authors": "least(100, (SELECT count(DISTINCT author) FROM h_function_changes WHERE author <> ''))",
    "languages": "(SELECT count(DISTINCT language) FROM h_functions)",
    "commits_by_month": "(SELECT count(*) FROM h_commits)",
    "fragile_zones": "least(15, (SELECT count(*) FROM h_profile WHERE change_count >= 5 AND modified >= 3))",
    "stale_zones": "least(15, (SELECT count(DISTINCT (name, file_path)) FROM h_functions))",
    "coauthorship_patterns": "least(20, (SELECT count(*) FROM h_profile WHERE author_count >= 2))",
    "feature_expansion": "(SELECT count(DISTINCT month) FROM h_month_changes WHERE change_type = 'added')",
    "phases": "(SELECT count(*) FROM h_phases)",
    "period_themes": "(SELECT count(*) FROM h_phases)",
    "chapters": "(SELECT count(*) FROM h_phases)",
    "activity_bursts": "(SELECT count(*) FROM h_phases WHERE total_changes / months > 2 * (SELECT sum(changes) / count(*) FROM h_timeline))",
    "convergence_points": "least(5, (SELECT count(*) FROM h_profile WHERE author_count >= 2))",
    "hotspot_notes": "least(10, (SELECT count(*) FROM h_profile))",
    "archaeology": "least(10, (SELECT count(*) FROM h_profile WHERE change_count >= 5 AND modified >= 3))"
                   " + least(10, (SELECT count(DISTINCT (name, file_path)) FROM h_functions))",
    **{name: "1" for name in _ONE_ROW},
}


@over("commits", "functions", "function_changes", "blame_entries", sql=" UNION ALL ".join(
    f"SELECT '{name}' AS section, {size} AS size" for name, size in _SIZES.items()))
def report_sections(h):
    """Rows in every section of the report data set."""
    parts = [
        rows.agg(F.count("*").alias("size")).select(F.lit(name).alias("section"), "size")
        for name, rows in reports.report_data(h, AS_OF).items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


# ---- summary, why and export, flattened to one listing each ------------------------


def _flat(sections):
    """(section, row as JSON) of every section, in one listing."""
    parts = [
        rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*rows.columns)).alias("row"))
        for name, rows in sections.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


@over("commits", "functions", "function_changes", "blame_entries", sql=f"""
    SELECT 'stats' AS section, '{{"commits":' || (SELECT count(*) FROM h_commits) || ',"functions":'
           || (SELECT count(*) FROM h_functions) || ',"changes":' || (SELECT count(*) FROM h_function_changes)
           || ',"blame_entries":' || (SELECT count(*) FROM h_blame_entries) || '}}' AS row
    UNION ALL (SELECT 'hotspots', '{{"name":"' || function_name || '","file":"' || file_path || '","changes":' || change_count || '}}'
               FROM h_profile ORDER BY change_count DESC, function_name, file_path LIMIT 5)
    UNION ALL (SELECT 'fragile_zones', '{{"name":"' || function_name || '","file":"' || file_path || '","changes":' || change_count || '}}'
               FROM h_profile WHERE change_count >= 5 AND modified >= 3
               ORDER BY change_count DESC, function_name, file_path LIMIT 3)
    UNION ALL (SELECT 'top_authors', '{{"author":"' || author || '","changes":' || count(*) || '}}'
               FROM h_function_changes GROUP BY author ORDER BY count(*) DESC, author LIMIT 3)
    UNION ALL SELECT 'languages', '{{"language":"' || language || '","count":' || count(*) || '}}'
              FROM h_functions GROUP BY language
    UNION ALL SELECT 'stability_distribution', '{{"rating":"' || r.rating || '","functions":' || count(s.rating) || '}}'
              FROM {_RATINGS} LEFT JOIN h_scores s ON s.rating = r.rating GROUP BY r.rating
    UNION ALL SELECT 'phase', '{{"phase":"active development"}}'""")
def summary(h):
    return _flat(reports.summary(h, AS_OF))


@over("functions", "function_changes", "blame_entries", "function_renames", sql="""
    WITH target AS (SELECT DISTINCT commit_hash FROM h_function_changes
                    WHERE function_name = 'red_widget_1' AND file_path ILIKE '%brand%')
    (SELECT 'history' AS section, commit_hash || change_type || file_path AS row FROM h_function_changes
     WHERE function_name = 'red_widget_1' AND file_path ILIKE '%brand%'
     ORDER BY "timestamp" DESC, commit_hash, file_path, function_name, change_type LIMIT 10)
    UNION ALL SELECT 'blame', author || ' ' || line_count || ' ' || percentage FROM h_blame_entries
     WHERE function_name = 'red_widget_1' AND file_path ILIKE '%brand%'
    UNION ALL (SELECT 'coupled', function_name || file_path || count(*) FROM h_function_changes
     WHERE commit_hash IN (FROM target) AND function_name <> 'red_widget_1'
     GROUP BY function_name, file_path ORDER BY count(*) DESC, function_name, file_path LIMIT 10)""")
def why_function(h):
    told = reports.why(h, "red_widget_1", AS_OF, file_filter="brand")
    history = lineage.function_history(h, "red_widget_1", "brand", fuzzy=True, limit=10)
    rows = {
        "history": history.select(F.concat("commit_hash", "change_type", "file_path").alias("row")),
        "blame": told["blame"].select(
            F.concat_ws(" ", "author", F.col("lines").cast("string"), F.col("pct").cast("string")).alias("row")
        ),
        "coupled": told["coupled"].select(
            F.concat("function_name", "file_path", F.col("co_change_count").cast("string")).alias("row")
        ),
    }
    listing = None
    for name, part in rows.items():
        part = part.select(F.lit(name).alias("section"), "row")
        listing = part if listing is None else listing.unionByName(part)
    return listing


@over("functions", "function_changes", "blame_entries", "commits", sql="""
    SELECT 'functions' AS section, name AS a, file_path AS b, start_line AS n FROM h_functions
    UNION ALL SELECT 'changes', function_name, file_path, lines_added FROM h_function_changes
    UNION ALL SELECT 'blame', function_name, file_path, line_count FROM h_blame_entries
    UNION ALL (SELECT 'authors', author, '', count(*) FROM h_function_changes WHERE author <> ''
               GROUP BY author)
    UNION ALL SELECT 'hotspots', function_name, file_path, change_count FROM h_profile""")
def export_sections(h):
    parts = tables.export_sections(h, AS_OF, ["functions", "changes", "blame", "authors", "hotspots"])
    shape = {
        "functions": ["name", "file_path", "start_line"],
        "changes": ["function_name", "file_path", "lines_added"],
        "blame": ["function_name", "file_path", "line_count"],
        "authors": ["author", None, "change_count"],
        "hotspots": ["function_name", "file_path", "change_count"],
    }
    listing = None
    for name, (a, b, n) in shape.items():
        part = parts[name].select(
            F.lit(name).alias("section"), F.col(a).alias("a"),
            (F.col(b) if b else F.lit("")).alias("b"), F.col(n).cast("bigint").alias("n"),
        )
        listing = part if listing is None else listing.unionByName(part)
    return listing


@direct(sql="""
    SELECT 'timeline' AS section, coalesce(c.month, f.month) AS a, '' AS b, coalesce(f.n, 0) AS n, coalesce(c.n, 0) AS m
    FROM (SELECT month, count(*) AS n FROM h_month_commits GROUP BY 1) c
    FULL JOIN (SELECT month, count(*) AS n FROM h_month_changes GROUP BY 1) f ON c.month = f.month
    UNION ALL SELECT 'blame', function_name, file_path, line_count, CAST(percentage * 10 AS BIGINT) FROM h_blame_entries
    UNION ALL SELECT 'authors', author, '', count(*), count(DISTINCT function_name) FROM h_function_changes WHERE author <> '' GROUP BY author""")
def exported_files(spark, sf_dir):
    """The export written as JSON lines, timeline uncut, and read again."""
    h = history(spark, sf_dir, "commits", "functions", "function_changes", "blame_entries")
    root = shared_folder(spark, "export")
    tables.export(h, root, AS_OF, "json", ["timeline", "blame", "authors"], months=None)

    def section(name, schema, *columns):
        rows = spark.read.schema(schema).json(f"{root}/{name}")
        return rows.select(F.lit(name).alias("section"), *[c.alias(a) for c, a in zip(columns, "abnm")])

    whole = lambda c: F.col(c).cast("bigint")
    return (
        section("timeline", "month string, commits bigint, changes bigint", F.col("month"), F.lit(""), whole("changes"), whole("commits"))
        .unionByName(section("blame", "function_name string, file_path string, line_count bigint, percentage double",
                             F.col("function_name"), F.col("file_path"), whole("line_count"), F.round(F.col("percentage") * 10).cast("bigint")))
        .unionByName(section("authors", "author string, change_count bigint, functions_touched bigint", F.col("author"), F.lit(""), whole("change_count"), whole("functions_touched")))
    )
