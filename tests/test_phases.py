from conftest import dicts

from annalist.functions import text
from annalist.operators import phases
from pyspark.sql import functions as F


def timeline(spark, counts):
    rows = [(f"2025-{i + 1:02d}", c, c, 1, 2) for i, c in enumerate(counts)]
    return spark.createDataFrame(rows, "month string, commits bigint, changes bigint, functions bigint, authors bigint")


def kinds(spark, counts):
    return [r["phase_type"] for r in dicts(phases.project_phases(timeline(spark, counts)))]


def test_phases(spark):
    assert kinds(spark, [10, 10, 100, 100, 3]) == ["steady", "growth", "decline"]
    assert kinds(spark, [1, 10, 10, 1, 100]) == ["dormant", "steady", "decline", "revival"]
    assert kinds(spark, [0, 0]) == ["dormant"]
    assert kinds(spark, []) == []
    first = dicts(phases.project_phases(timeline(spark, [10, 10, 100, 100, 3])))[0]
    assert (first["start_month"], first["end_month"], first["months"], first["total_changes"], first["avg_authors"]) == (
        "2025-01", "2025-02", 2, 20, 2.0,
    )


def test_bursts(spark):
    line = timeline(spark, [10, 10, 100])
    found = dicts(phases.activity_bursts(phases.project_phases(line), line))
    assert [(r["total_changes"], r["intensity"]) for r in found] == [(100, 2.5)]
    flat = timeline(spark, [10, 10, 10])
    assert dicts(phases.activity_bursts(phases.project_phases(flat), flat)) == []


def test_themes(spark):
    messages = {
        "Fix authentication bug": "fix", "Bug in parser": "fix", "Add new search feature": "feature",
        "Implement caching": "feature", "Refactor core module": "refactor", "Document API endpoints": "docs",
        "Update dependencies": "other", "": "other", "  update the docs": "docs", "CI: x": "config",
    }
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    got = {r[0]: r[1] for r in df.select("m", text.commit_theme(F.col("m"))).collect()}
    assert got == messages


def test_period_themes(spark, make_history):
    month = 86400 * 31
    rows = [(f"h{i}", "A", 1_735_700_000 + i, m, 1) for i, m in enumerate(
        ["Docs a", "Fix a", "Fix b", "Docs b", "Add x\nbody", "Fix c", "Fix d"])]
    rows += [("z", "A", 1_735_700_000 + month, "Remove y", 1)]
    h = make_history(commits=rows)
    spells = spark.createDataFrame(
        [(0, "2025-01", "2025-01"), (1, "2025-02", "2025-03"), (2, "2025-05", "2025-05")],
        "phase_index int, start_month string, end_month string",
    )
    got = dicts(phases.period_themes(h, spells))
    assert got[0]["themes"] == {"docs": 2, "feature": 1, "fix": 4}
    assert got[0]["dominant_theme"] == "fix"
    assert got[0]["sample_messages"] == ["Fix a", "Fix b", "Fix c", "Docs a", "Docs b"]
    assert got[1]["dominant_theme"] == "remove"
    assert got[2] == {"phase_index": 2, "themes": {}, "dominant_theme": "other", "sample_messages": []}


def test_chapters_and_arc(spark):
    spells = phases.project_phases(timeline(spark, [1, 10, 10, 1, 100]))
    themes = spells.select(
        "phase_index", F.lit("fix").alias("dominant_theme"), F.array(F.lit("m")).alias("sample_messages")
    )
    rows = dicts(phases.chapters(spells, themes))
    assert rows[1]["title"] == "Bug Fix Sprint (Steady)" and rows[1]["period"] == "2025-02 to 2025-03"
    assert rows[0]["summary"] == (
        "1 month(s) of dormant activity with 1 commits and 1 function changes. Dominant activity: fix."
    )
    assert dicts(phases.project_arc(spells))[0]["arc_type"] == "revival"
    facts = dicts(phases.timeline_facts(timeline(spark, [5, 9, 9])))[0]
    assert (facts["peak_month"], facts["total_changes"]) == ("2025-02", 23)
