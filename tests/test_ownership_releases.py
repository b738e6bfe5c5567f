import random

from conftest import dicts

from annalist.operators import lookup, ownership, releases


def test_blame_against_brute_force(make_history):
    rng = random.Random(7)
    functions = []
    for path in ("a.py", "b/c.py"):
        for i in range(25):
            start = rng.randint(1, 1500)
            functions.append((f"f{i}", path, "python", start, start + rng.randint(0, 700), "function", "", ""))
    lines = [
        (path, n, f"c{rng.randint(0, 30)}", f"dev{rng.randint(0, 3)}")
        for path in ("a.py", "b/c.py") for n in range(1, 2001) if rng.random() < 0.6
    ]
    h = make_history(functions=functions, blame_lines=lines)
    got = {
        (r["function_name"], r["file_path"], r["start_line"], r["author"]): (
            r["line_count"], r["percentage"], r["commit_hash"])
        for r in dicts(ownership.blame_by_definition(h))
    }
    expected = {}
    for name, path, _, start, end, *_ in functions:
        inside = [x for x in lines if x[0] == path and start <= x[1] <= end]
        for author in {x[3] for x in inside}:
            mine = [x for x in inside if x[3] == author]
            counts = {}
            for _, _, commit, _ in mine:
                counts[commit] = counts.get(commit, 0) + 1
            best = max(counts, key=counts.get)  # the first seen of equals
            share = round(len(mine) / len(inside) * 100, 1)
            expected[(name, path, start, author)] = (len(mine), share, best)
    assert got == expected


def test_no_blame_in_span(make_history):
    h = make_history(
        functions=[("f", "a.py", "python", 10, 12, "function", "", "")],
        blame_lines=[("a.py", 1, "c", "A")],
    )
    assert dicts(ownership.blame_entries(h)) == []


def test_bus_factor(make_history):
    entry = lambda p, a, n: ("f", p, a, n, 50.0, "c")
    h = make_history(blame_entries=[
        entry("src/a.py", "Alice", 85), entry("src/b.py", "Bob", 15), entry("lib/a.py", "Alice", 80),
        entry("lib/b.py", "Bob", 20), entry("main.py", "Bob", 3),
    ])
    assert dicts(ownership.bus_factor(h)) == [
        {"directory": ".", "dominant_author": "Bob", "percentage": 100.0, "total_lines": 3, "author_count": 1},
        {"directory": "src", "dominant_author": "Alice", "percentage": 85.0, "total_lines": 100, "author_count": 2},
    ]


def test_file_report_and_summary(make_history):
    h = make_history(
        functions=[("f", "src/x.py", "python", 1, 5, "function", "", ""),
                   ("g", "src/x.py", "python", 7, 9, "class", "", ""),
                   ("k", "src/xy.py", "go", 2, 3, "function", "", "")],
        blame_entries=[("f", "src/x.py", "A", 3, 60.0, "c"), ("f", "src/x.py", "B", 2, 40.0, "c"),
                       ("k", "src/xy.py", "C", 2, 100.0, "c")],
        function_changes=[("f", "src/x.py", "c", "added", 1, 0, "A", 86400 * 10, "m")],
    )
    report = lookup.file_report(h, "src/x", 86400 * 15 + 5)
    assert dicts(report["header"]) == [{
        "file_path": "src/x.py", "language": "python", "total_functions": 2, "total_changes": 1, "unique_owners": 1}]
    rows = dicts(report["functions"])
    assert [(r["name"], r["owner"], r["days_ago"]) for r in rows] == [("f", "A", 5), ("g", "", -1)]
    summary = dicts(lookup.blame_summary(h, "src/x.py"))
    assert [(r["primary_owner"], r["ownership_pct"], r["change_count"]) for r in summary] == [("A", 60.0, 1), ("", 0.0, 0)]
    assert [r["author"] for r in dicts(lookup.function_blame(h, "src/x.py", "f"))] == ["A", "B"]
    assert [r["author"] for r in dicts(lookup.function_blame(h, "xy", "k"))] == ["C"]
    assert dicts(lookup.function_info(h, "src/x", "k"))[0]["file_path"] == "src/xy.py"


def release_history(make_history, tags, n=12):
    # pairs of commits share a second, so the hash decides
    commits = [(f"h{i:02d}", f"A{i % 2}", 100 + i // 2, f"m{i}", 1) for i in range(n)]
    changes = [("f", f"p{i % 3}.py", c[0], ["added", "modified", "deleted", "renamed"][i % 4], 1, 1, c[1], c[2], c[3])
               for i, c in enumerate(commits)]
    return make_history(commits=commits, function_changes=changes, tags=tags), commits, changes


def brute(commits, changes, low, high):
    at = {c[0]: (c[2], c[0]) for c in commits}
    if high not in at or (low is not None and low not in at):
        return dict.fromkeys(["added", "modified", "deleted", "total", "files_touched", "authors"], 0)
    rows = [x for x in changes if at[x[2]] <= at[high] and (low is None or at[x[2]] > at[low])]
    kinds = [x[3] for x in rows]
    return {
        "added": kinds.count("added"), "modified": kinds.count("modified"), "deleted": kinds.count("deleted"),
        "total": len(rows), "files_touched": len({x[1] for x in rows}), "authors": len({x[6] for x in rows}),
    }


def test_releases_against_brute_force(make_history):
    cases = [
        [("v1", "h03", 1), ("v2", "h07", 2), ("v3", "h07", 3), ("v4", "h11", 4)],
        [("v1", "h09", 1), ("v2", "h02", 2), ("v3", "h10", 3)],  # tag order against commit order
        [("v1", "h03", 1), ("v2", "gone", 2), ("v3", "h06", 3), ("v4", "h08", 4)],
    ]
    for tags in cases:
        h, commits, changes = release_history(make_history, [(*t, "A", "m") for t in tags])
        got = {r["name"]: r for r in dicts(releases.releases(h))}
        previous = None
        for i, (name, commit, _) in enumerate(tags):
            expected = brute(commits, changes, previous if i else None, commit)
            assert {k: got[name][k] for k in expected} == expected, name
            previous = commit


def test_release_summary(make_history):
    h, commits, changes = release_history(make_history, [])
    for low, high in [(None, "h05"), ("h02", "h07"), ("h07", "h07"), ("h08", "h02"), ("gone", "h07"), ("h01", "gone")]:
        got = dicts(releases.release_summary(h, high, low))[0]
        expected = brute(commits, changes, low, high)
        if high == "gone":
            expected = dict.fromkeys(expected, 0)
        assert got == expected, (low, high)


def test_diffs(make_history):
    h, commits, changes = release_history(make_history, [])
    rows = dicts(lookup.commit_changes(h, "h0", contains="P1"))
    assert {r["commit_hash"] for r in rows} == {"h01", "h04", "h07"}
    rows = dicts(lookup.range_changes(h, "h02", "h04"))
    assert {r["commit_hash"] for r in rows} == {"h02", "h03", "h04", "h05"}
