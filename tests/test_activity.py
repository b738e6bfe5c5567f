from datetime import datetime, timezone

import pytest
from conftest import dicts

from annalist.functions import clock
from annalist.operators import activity, lookup, reports, stability
from pyspark.sql import functions as F


def ts(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp())


AS_OF = ts("2025-06-01")


@pytest.fixture(scope="module")
def h(make_history):
    commits = [
        ("a1", "Alice", ts("2025-01-15"), "Add parser", 1), ("a2", "Bob", ts("2025-01-20"), "Fix timeout", 1),
        ("b1", "Alice", ts("2025-02-10"), "Refactor core", 1), ("a3", "Bob", ts("2025-02-15"), "Fix [x]", 1),
        ("c1", "Alice", ts("2025-03-05"), "Add search", 1), ("a4", "Alice", ts("2025-03-05"), "Tune", 1),
        ("c2", "Bob", ts("2025-03-15"), "Docs", 1), ("a5", "Bob", ts("2025-03-15"), "Tune more", 1),
    ]
    by_hash = {c[0]: c for c in commits}

    def change(name, path, commit, kind, plus=5, minus=2):
        c = by_hash[commit]
        return (name, path, commit, kind, plus, minus, c[1], c[2], c[3])

    changes = [change("parse", "parser.py", "a1", "added")]
    changes += [change("parse", "parser.py", c, "modified") for c in ["a2", "b1", "a3", "a4", "a5"]]
    changes += [change("search", "search.py", "c1", "added", 30, 0)]
    functions = [
        ("parse", "parser.py", "python", 1, 20, "function", "def parse()", ""),
        ("search", "search.py", "python", 1, 30, "function", "def search()", ""),
        ("old", "legacy.py", "python", 1, 5, "function", "def old()", ""),
    ]
    return make_history(commits=commits, function_changes=changes, functions=functions, blame_entries=[])


def test_hotspots_and_filters(h):
    top = dicts(activity.hotspots(h))
    assert [(r["function_name"], r["change_count"], r["author_count"]) for r in top] == [
        ("parse", 6, 2), ("search", 1, 1),
    ]
    assert (top[0]["added"], top[0]["modified"], top[0]["deleted"]) == (1, 5, 0)
    assert dicts(activity.hotspots(h, author="Bob"))[0]["change_count"] == 3
    assert dicts(activity.hotspots(h, author="bob")) == []  # exact author
    assert len(dicts(activity.hotspots(h, file_filter="PARSER"))) == 1
    since = clock.parse_date_filter("2025-02-15", AS_OF)
    assert dicts(activity.hotspots(h, since=since, until=since))[0]["change_count"] == 1


def test_fragile_and_stale(h):
    fragile = dicts(activity.fragile_functions(h))
    assert [(r["function_name"], r["modify_count"]) for r in fragile] == [("parse", 5)]
    stale = dicts(activity.stale_functions(h))
    assert (stale[0]["function_name"], stale[0]["last_changed"], stale[0]["total_changes"]) == ("old", None, 0)
    windowed = dicts(activity.stale_functions(h, since=ts("2025-03-10")))
    assert [r["total_changes"] for r in windowed] == [0, 0, 1]


def test_coauthors_and_authors(h):
    assert dicts(activity.coauthorship(h))[0]["authors"] == ["Alice", "Bob"]
    assert dicts(activity.coauthorship(h, limit=None))[0]["author_count"] == 2
    alice = dicts(activity.authors(h))[0]
    assert (alice["author"], alice["change_count"], alice["functions_touched"], alice["total_added"]) == (
        "Alice", 4, 2, 45,
    )


def test_ages_put_never_changed_first(h):
    for recent in (False, True):
        rows = dicts(activity.function_ages(h, AS_OF, recent_first=recent))
        assert (rows[0]["name"], rows[0]["days_ago"]) == ("old", -1)
    assert [r["name"] for r in rows] == ["old", "parse", "search"]


def test_timeline_and_months(h):
    months = {r["month"]: r for r in dicts(activity.timeline(h, AS_OF))}
    assert months["2025-01"]["commits"] == 2
    assert months["2025-03"] == {"month": "2025-03", "commits": 4, "changes": 3, "functions": 2, "authors": 2}
    listed = dicts(activity.commits_by_month(h))
    assert listed[0] == {"month": "2025-01", "position": 1, "message": "Add parser", "author": "Alice", "hash": "a1"}
    assert [r["position"] for r in listed if r["month"] == "2025-03"] == [1, 2, 3, 4]


def test_feature_expansion(h):
    rows = dicts(activity.feature_expansion(h))
    assert [(r["month"], r["new_functions"], r["cumulative_functions"]) for r in rows] == [
        ("2025-01", 1, 1), ("2025-03", 1, 2),
    ]
    assert rows[0]["new_files"] == ["parser.py"] and rows[0]["expanding_areas"] == []


def test_coupling_counts_rows(h):
    assert dicts(activity.coupled_functions(h, "nothing")) == []
    assert dicts(activity.coupled_functions(h, "parse")) == []


def test_commits_filters(h):
    def hashes(**kw):
        return [r["hash"] for r in dicts(lookup.commits(h, **kw))]

    assert hashes(file_filter="search") == ["c1"]
    assert hashes(author_filter="ali", message_filter="TUNE") == ["a4"]
    assert hashes(message_filter="^(Fix|Docs)") == ["c2", "a3", "a2"]
    assert hashes(limit=2) == ["a5", "c2"]


def test_unknown_time_is_null(make_history):
    h = make_history(function_changes=[("f", "a.py", "x", "added", 1, 0, "A", 0, "m")])
    assert dicts(activity.hotspots(h))[0]["last_changed"] is None


def test_deleted_author_is_of_last_deletion(make_history):
    change = lambda c, a, t: ("f", "a.py", c, "deleted", 0, 1, a, t, "m")
    h = make_history(
        functions=[("g", "a.py", "python", 1, 2, "function", "", "")],
        function_changes=[change("c1", "Old", 10), change("c2", "New", 20),
                          ("g", "a.py", "c2", "deleted", 0, 1, "New", 20, "m")],
    )
    assert dicts(activity.deleted_functions(h)) == [
        {"function_name": "f", "file_path": "a.py", "deleted_at": 20, "author": "New"}
    ]


def test_untested_underscore_is_a_wildcard(make_history):
    row = lambda f, p, c: (f, p, c, "added", 1, 0, "A", 5, "m")
    h = make_history(function_changes=[
        row("f", "src/a.py", "c1"), row("t", "contest.py", "c1"), row("g", "src/b.py", "c2"),
    ])
    assert [r["function_name"] for r in dicts(activity.untested_changes(h))] == ["g"]


def test_duplicate_definitions_multiply(make_history):
    f = lambda line: ("f", "a.py", "python", line, line + 1, "function", "", "")
    h = make_history(
        functions=[f(1), f(9)],
        function_changes=[("f", "a.py", f"c{i}", "modified", 1, 0, "A", i, "m") for i in range(1, 4)],
    )
    assert dicts(activity.stale_functions(h))[0]["total_changes"] == 6


def test_date_filter(spark):
    as_of = 1_700_000_000
    assert clock.parse_date_filter("2026-01-01", as_of) == ts("2026-01-01")
    assert clock.parse_date_filter("30d", as_of) == as_of - 30 * 86400
    assert clock.parse_date_filter("6m", as_of) == as_of - 180 * 86400
    assert clock.parse_date_filter("1y", as_of) == as_of - 365 * 86400
    with pytest.raises(ValueError):
        clock.parse_date_filter("not-a-date", as_of)
    given = ["30d", "2026-01-01", "2026-01-01T10:20:30", "2026-01-01 10:20", "2026-01-01T10:20:30Z", "2026-01-01T10:20:30+02:00"]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    assert [r[0] for r in df.select(clock.date_filter(F.col("v"), as_of)).collect()] == [
        clock.parse_date_filter(v, as_of) for v in given
    ]
    with pytest.raises(Exception, match="not a date filter"):
        spark.createDataFrame([("soon",)], "v string").select(clock.date_filter(F.col("v"), as_of)).collect()


def test_months_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(ts("2025-01-31") + 86399,)], "t bigint")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(clock.month_of(F.col("t"))).first()[0] == "2025-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


# ---- stability ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def shaky(make_history):
    day = 86400
    changes = [("stable_func", "core.py", "aaa", "added", 10, 0, "Alice", AS_OF - 300 * day, "initial")]
    changes += [
        ("volatile_func", "api.py", f"c{i:03d}", "modified", 5, 2, f"Author{i % 3}", AS_OF - i * day, f"change {i}")
        for i in range(10)
    ]
    functions = [
        ("stable_func", "core.py", "python", 1, 20, "function", "", ""),
        ("volatile_func", "api.py", "python", 1, 30, "function", "", ""),
        ("untouched_func", "lib.py", "python", 1, 10, "function", "", ""),
    ]
    return make_history(functions=functions, function_changes=changes, blame_entries=[], commits=[])


def test_stability(shaky):
    rows = dicts(stability.stability(shaky, AS_OF))
    assert [r["function_name"] for r in rows] == ["untouched_func", "stable_func", "volatile_func"]
    by_name = {r["function_name"]: r for r in rows}
    untouched = by_name["untouched_func"]
    assert (untouched["stability_score"], untouched["rating"], untouched["days_ago"]) == (1.0, "stable", 365)
    expected = round((1 - 1 / 10) * 0.5 + 300 / 365 * 0.3 + (1 - 1 / 3) * 0.2, 3)
    assert by_name["stable_func"]["stability_score"] == expected
    assert by_name["volatile_func"]["rating"] == "critical"
    assert len(dicts(stability.stability(shaky, AS_OF, file_filter="core"))) == 1
    counts = {r["rating"]: r["functions"] for r in dicts(stability.distribution(stability.scores(shaky, AS_OF)))}
    assert counts == {"stable": 2, "moderate": 0, "volatile": 0, "critical": 1}


def test_volatile_first_reverses_before_the_limit(shaky):
    rows = dicts(stability.stability(shaky, AS_OF, limit=1, volatile_first=True))
    assert rows[0]["function_name"] == "volatile_func"


def test_risks(shaky):
    rows = dicts(stability.risks(shaky, AS_OF))
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0]["description"] == "Fragile function: volatile_func" and rows[0]["severity"] == 100
    assert {r["category"] for r in rows} == {"fragile", "volatile", "convergence"}


def test_summary_and_why(shaky):
    told = reports.summary(shaky, AS_OF)
    assert dicts(told["stats"])[0]["functions"] == 3
    assert dicts(told["phase"]) == [{"phase": "low activity"}]  # 1, 2 and 8 changes
    why = reports.why(shaky, "volatile_func", AS_OF, file_filter="api")
    assert len(dicts(why["history"])) == 10
    assert dicts(why["stability"])[0]["rating"] == "critical"


def test_no_timeline_is_unknown(make_history):
    empty = make_history(commits=[], function_changes=[])
    assert dicts(reports.recent_phase(activity.timeline(empty, AS_OF)))[0]["phase"] == "unknown"
