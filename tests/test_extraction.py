import difflib
import random

import pytest
from conftest import dicts

from annalist import History
from annalist.operators import changes, definitions, lookup, renames
from annalist.schema import SCHEMAS


def parsed(spark, path, source):
    df = spark.createDataFrame([(path, source)], "file_path string, content string")
    rows = dicts(definitions.parse(df, ["file_path"], "content"))
    return sorted((r["start_line"], r["end_line"], r["name"], r["kind"]) for r in rows)


PYTHON = '''import os

def hello(name):
    """Greet."""
    return name

class UserService:
    # first

    def get(self):
        return 1

    async def skip(self):
        pass
x = 1
\tdef odd(): pass
'''

SNIPPETS = {
    "t.py": (PYTHON, [(3, 5, "hello", "function"), (7, 14, "UserService", "class"), (10, 11, "get", "function"),
                      (16, 16, "odd", "function")]),
    "t.js": ("async function processData(d) {\n  if (d) { return '}'; }\n}\nclass DataService {\n}\n"
             "const helper = (x) => {\n  return `{`;\n};\nlet f = y =>\n  y;\n",
             [(1, 3, "processData", "function"), (4, 5, "DataService", "class"), (6, 8, "helper", "function"),
              (9, 11, "f", "function")]),
    "t.ts": ("export function fetchData(url: string): Promise<Response> {\n    return fetch(url);\n}\n\n"
             "export class ApiClient {\n    constructor(private baseUrl: string) {}\n}\n",
             [(1, 3, "fetchData", "function"), (5, 7, "ApiClient", "class")]),
    "t.rs": ("pub fn add(a: i32) -> i32 {\n    a + 1\n}\nimpl Point {\n    pub async unsafe fn go(&self) {}\n}\ntrait Draw {\n}\n",
             [(1, 3, "add", "function"), (4, 6, "Point", "class"), (5, 9, "go", "function"), (7, 8, "Draw", "class")]),
    "t.go": ("func Add(a, b int) int {\n\treturn a\n}\nfunc (s *Server) Run(x int) {\n\t// }\n}\ntype T struct {\n\tn int\n}\n",
             [(1, 3, "Add", "function"), (4, 6, "Run", "function"), (7, 9, "T", "class")]),
    "T.java": ("public class A {\n    private static int run(String s) {\n        if (s == null) { return new Foo(1); }\n"
               "        return 0;\n    }\n}\ninterface B {\n}\n",
               [(1, 6, "A", "class"), (2, 5, "run", "function"), (3, 9, "Foo", "function"), (7, 8, "B", "class")]),
    "t.c": ("typedef struct Node {\n  int v;\n} Node;\nstatic int sum(int a, int b) {\n  return a;\n}\nint decl(int a);\n",
            [(1, 3, "Node", "class"), (4, 6, "sum", "function")]),
    "t.cpp": ("enum Color { RED };\nclass Shape {\n public:\n  double area() { return 0; }\n};\n",
              [(1, 5, "Color", "class"), (2, 5, "Shape", "class"), (4, 6, "area", "function")]),
    "naïve.py": ("def naïve():\n    pass\n", [(1, 2, "naïve", "function")]),
}


@pytest.mark.parametrize("path", SNIPPETS)
def test_definitions(spark, path):
    source, expected = SNIPPETS[path]
    assert parsed(spark, path, source) == expected


def test_nothing_to_parse(spark):
    assert parsed(spark, "a.py", "") == []
    assert parsed(spark, "a.py", "  \n ") == []
    assert parsed(spark, "a.txt", "def f(): pass") == []


def test_long_blocks_are_followed_to_their_end(spark):
    body = "\n".join(["  x();"] * 1500)
    assert parsed(spark, "a.js", f"function big() {{\n{body}\n}}\n") == [(1, 1502, "big", "function")]


def test_long_string_literals_do_not_overflow(spark):
    literal = "\\\\n{" * 20000
    assert parsed(spark, "a.js", f'function f() {{\n  s = "{literal}";\n}}\n') == [(1, 3, "f", "function")]


# ---- changes --------------------------------------------------------------------------


def version_history(make_history, versions):
    """versions: (commit, path, before, after, insertions, deletions)"""
    commits = sorted({v[0] for v in versions})
    return make_history(
        commits=[(c, "A", i + 1, "m" * 300, 1) for i, c in enumerate(commits)],
        file_versions=[v[:4] for v in versions],
        commit_files=[(v[0], v[1], v[4], v[5], v[4] + v[5]) for v in versions],
    )


def listed(rows):
    return sorted((r["commit_hash"], r["file_path"], r["function_name"], r["change_type"], r["lines_added"],
                   r["lines_removed"]) for r in rows)


def test_extract(make_history):
    long_a = "def alpha(x):\n    total = x + 1\n    return total * 2\n"
    long_b = "def beta(x):\n    total = x + 1\n    return total * 2\n"
    other = "def other():\n    return [k for k in range(10)]\n"
    h = version_history(make_history, [
        ("c1", "a.py", "", long_a + "\n" + other, 7, 0),  # created
        ("c2", "a.py", long_a + "\n" + other, long_b + "\n" + other, 3, 4),  # renamed inside the file
        ("c3", "a.py", long_a + "\n" + other, "\n" + long_a + "\n" + other, 1, 0),  # shifted
        ("c4", "src/a.py", long_a, "", 0, 3),  # moved to another file
        ("c4", "lib/b.py", other, other + long_a, 3, 0),
        ("c5", "a.py", long_a, "", 0, 9),  # removed
        ("c6", "README.md", "x", "y", 1, 1),
    ])
    found = changes.extract(h)
    assert listed(dicts(found["function_changes"])) == [
        ("c1", "a.py", "alpha", "added", 3, 0),
        ("c1", "a.py", "other", "added", 3, 0),
        ("c2", "a.py", "beta", "renamed", 3, 4),
        ("c3", "a.py", "alpha", "modified", 0, 0),
        ("c3", "a.py", "other", "modified", 0, 0),
        ("c4", "lib/b.py", "alpha", "renamed", 0, 0),
        ("c5", "a.py", "alpha", "deleted", 0, 9),
    ]
    first = dicts(found["function_changes"])[0]
    assert len(first["message"]) == 200
    by_commit = {r["commit_hash"]: r for r in dicts(found["function_renames"])}
    assert set(by_commit) == {"c2", "c4"}
    inside, moved = by_commit["c2"], by_commit["c4"]
    assert inside["signals"]["location"] == 1.0 and inside["signals"]["body"] > 0.8
    assert moved["signals"]["body"] == 1.0 and moved["signals"]["name"] == 1.0
    assert (moved["old_file_path"], moved["new_file_path"], moved["confidence"]) == ("src/a.py", "lib/b.py", 0.85)
    newest = dicts(changes.extract(h, max_commits=2)["function_changes"])
    assert {r["commit_hash"] for r in newest} == {"c5"}


def test_duplicate_names_compare_the_last(make_history):
    twice = "def f():\n    return 1\n\ndef f():\n    return 2\n"
    h = version_history(make_history, [("c1", "a.py", twice, twice.replace("1", "9"), 1, 1),
                                       ("c2", "a.py", twice, twice.replace("2", "9"), 1, 1)])
    rows = dicts(changes.compare(h.file_versions))
    assert [(r["commit_hash"], r["change_type"]) for r in rows] == [("c2", "modified")]


# ---- renames against a plain greedy reading ---------------------------------------------


def loose_rows(rng, commits, per_side, files):
    bodies = ["for i in range(n):\n    total += i * k\nreturn total", "with open(p) as f:\n    return f.read()",
              "x = compute(a, b)\nif x > 3:\n    raise ValueError(x)\nreturn x", "pass"]
    rows = []
    for commit in range(commits):
        seen = set()
        for side in ("deleted", "added"):
            for place in range(per_side):
                name = rng.choice(["load", "loads", "save", "run", "fetch"]) + rng.choice(["", "_all", "2"])
                path = rng.choice(files)
                kind = rng.choice(["function", "function", "class"])
                if (name, path, kind) in seen:
                    continue
                seen.add((name, path, kind))
                body = f"def {name}(a):\n" + rng.choice(bodies) + rng.choice(["", "\n# end"])
                lines = body.count("\n") + 1
                rows.append((f"c{commit}", path, name, kind, side, place + 1, place + 1, place + lines,
                             f"def {name}(a):", str(hash(body)), len(body), body))
    return rows


LOOSE = ("commit_hash string, file_path string, name string, kind string, change_type string, place int,"
         " start_line int, end_line int, signature string, body_hash string, body_length int, body string")


def folder(path):
    return path.rsplit("/", 1)[0]


def plain_greedy(rows, within_file):
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    pairs = []
    for o in (r for r in rows if r[4] == "deleted"):
        for n in (r for r in rows if r[4] == "added"):
            if o[0] != n[0] or o[3] != n[3] or (within_file and o[1] != n[1]):
                continue
            place = 1.0 if o[1] == n[1] else 0.3 if folder(o[1]) == folder(n[1]) else 0.0
            old_lines, new_lines = o[7] - o[6] + 1, n[7] - n[6] + 1
            size = 1.0 - abs(old_lines - new_lines) / max(old_lines, new_lines, 1)
            score = round(ratio(o[11], n[11]) * 0.45 + ratio(o[8], n[8]) * 0.20 + place * 0.15
                          + size * 0.10 + ratio(o[2], n[2]) * 0.10, 3)
            if score >= 0.65:
                pairs.append((-score, o[1], o[5], n[1], n[5], o, n))
    used, kept = set(), set()
    for score, *_, o, n in sorted(pairs, key=lambda p: p[:5]):
        if ("o", *o[:4]) not in used and ("n", *n[:4]) not in used:
            used |= {("o", *o[:4]), ("n", *n[:4])}
            kept.add((o[0], o[3], o[2], o[1], n[2], n[1], -score))
    return kept


def matched(df):
    return {(r["commit_hash"], r["old_kind"], r["old_name"], r["old_file_path"], r["new_name"],
             r["new_file_path"], r["confidence"]) for r in dicts(df)}


FILES = ["a.py", "src/a.py", "src/b.py", "lib/c.py", "lib/x/d.py"]


@pytest.mark.parametrize("within_file", [True, False])
def test_matching(spark, within_file):
    rows = loose_rows(random.Random(3), commits=6, per_side=12, files=FILES)
    df = spark.createDataFrame(rows, LOOSE)
    assert matched(renames.match(df, within_file)) == plain_greedy(rows, within_file)


def test_matching_in_blocks_and_rounds(spark, monkeypatch):
    rows = loose_rows(random.Random(4), commits=3, per_side=14, files=FILES)
    df = spark.createDataFrame(rows, LOOSE)
    monkeypatch.setattr(renames, "BLOCK", 3)
    assert matched(renames.match(df, False)) == plain_greedy(rows, False)


def test_twins_go_first(spark):
    body = "def f():\n    return compute(1, 2, 3)"
    def row(side, path, place, name="f"):
        text = body if name == "f" else "def g(a, b, c):\n    raise KeyError"
        head = text.split("\n")[0]
        return ("c", path, name, "function", side, place, place, place + 1, head, "h" + name, len(text), text)

    rows = [row("deleted", f"old/m{i}.py", 1) for i in range(6)] + [row("added", f"new/m{i}.py", 1) for i in range(5)]
    rows += [row("deleted", "keep/a.py", 1, "g"), row("added", "keep/b.py", 1, "g"), row("added", "far/b.py", 1, "g")]
    df = spark.createDataFrame(rows, LOOSE)
    plain = matched(renames.match(df, False))
    assert plain == plain_greedy(rows, False)
    assert {r[3:6:2] for r in plain if r[2] == "f"} == {(f"old/m{i}.py", f"new/m{i}.py") for i in range(5)}


def test_rename_schema(spark):
    df = spark.createDataFrame([], LOOSE)
    got = renames.match(df, False)
    assert got.columns == SCHEMAS["function_renames"].fieldNames() and got.count() == 0


# ---- shapes and checks that came with the row-local comparison ------------------------------


def test_comparing_shuffles_nothing(spark, make_history):
    h = version_history(make_history, [("c1", "a.py", "", "def f():\n    pass\n", 2, 0)])
    plan = changes.compare(h.file_versions, text=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_both_sides_of_repeated_names(make_history):
    before = "class A:\n    x = 1\n\ndef f():\n    return 1\n\ndef f():\n    return 2\n"
    after = "def f():\n    return 2\n\ndef g():\n    return 3\n\ndef g():\n    return 4\n"
    h = version_history(make_history, [("c1", "a.py", before, after, 1, 1), ("c2", "a.py", None, after, 1, 1), ("c3", "a.txt", before, after, 1, 1)])
    rows = dicts(changes.compare(h.file_versions, text=True))
    got = sorted((r["commit_hash"], r["name"], r["kind"], r["change_type"], r["place"], r["start_line"], r["body"]) for r in rows if r["change_type"] != "modified")
    assert got == [
        ("c1", "A", "class", "deleted", 1, 1, "class A:\n    x = 1"), ("c1", "g", "function", "added", 4, 7, "def g():\n    return 4"),
        ("c2", "f", "function", "added", 1, 1, "def f():\n    return 2"), ("c2", "g", "function", "added", 4, 7, "def g():\n    return 4"),
    ]
    assert [(r["commit_hash"], r["name"], r["place"], r["body"]) for r in rows if r["change_type"] == "modified"] == [("c1", "f", 1, None)]


def test_block_ends_against_a_reading_line_by_line():
    import numpy as np

    draw = random.Random(9)
    for _ in range(300):
        n = draw.randint(1, 40)
        levels = np.array([draw.choice([-1, 0, 0, 2, 4, 4, 8]) for _ in range(n)])
        starts = np.array(sorted(draw.sample(range(n), draw.randint(1, n))))
        starts = starts[levels[starts] >= 0]
        want = []
        for s in starts:
            last = s
            for i in range(s + 1, n):
                if levels[i] >= 0:
                    if levels[i] <= levels[s]:
                        break
                    last = i
            want.append(last + 1)
        if len(starts):
            assert definitions._indented_ends(levels, starts).tolist() == want
        braces = np.array([draw.choice([-1, 0, 0, 1, 1, 2, -2]) for _ in range(n)])
        starts, want = np.array(sorted(draw.sample(range(n), draw.randint(1, n)))), []
        for s in starts:
            depth, opened, end = 0, False, n
            for i in range(s, n):
                depth += braces[i]
                opened |= depth > 0
                if opened and depth <= 0:
                    end = i + 1
                    break
            want.append(end)
        assert definitions._braced_ends(braces, starts).tolist() == want


def test_texts_of_all_lengths_meet(spark):
    rng, rows = random.Random(8), []
    for commit in range(2):
        for side in ("deleted", "added"):
            for place, n in enumerate((1, 2, 3, 5, 9, 17, 33, 60)):
                body = f"def work(a):\n" + "\n".join(f"    step_{k % 7}(a, {rng.choice([1, 1, 1, 2])})" for k in range(n))
                path = rng.choice(FILES)
                rows.append((f"c{commit}", path, f"work{place}", "function", side, place + 1, place + 1, place + 1 + n, "def work(a):", str(hash(body)), len(body), body))
    df = spark.createDataFrame(rows, LOOSE)
    want = plain_greedy(rows, False)
    assert matched(renames.match(df, False)) == want and len(want) > 8


def test_lines_are_matched_once_in_the_helper(spark, make_history):
    """No regular expression of a line is an expression of the plan, where it would be interpreted line by line."""
    h = version_history(make_history, [("c1", "a.rs", "", "fn f() {\n}\n", 2, 0)])
    plan = changes.compare(h.file_versions, text=True)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan.upper().split("ARROWEVALPYTHON")[0] and "regexp_replace" not in plan


def test_lines_with_and_without_wide_letters(spark):
    source = "struct naïve_́é {\n} \nfn ²x() {\n  // {\n}\n fn wide() { '{' }\nfn last() {\n  \"{\\\"{\"\n}"
    assert parsed(spark, "t.rs", source) == [(1, 2, "naïve_́é", "class"), (6, 9, "wide", "function"), (7, 9, "last", "function")]


def test_texts_of_sources_are_not_broadcast(spark):
    heads = spark.createDataFrame([("a.py", "def f():\n    pass\nclass A:\n    x = 1"), ("b.py", "x"), (None, "def g(): pass")], "file_path string, content string")
    h = History(head_files=heads)
    found = lookup.definition_sources(h.with_tables(functions=definitions.head_functions(h)))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["name"], r["kind"], r["start_line"], r["end_line"], r["source"]) for r in dicts(found)) == [
        ("A", "class", 3, 4, "class A:\n    x = 1"), ("f", "function", 1, 2, "def f():\n    pass"),
    ]


def test_characters_are_counted_by_batch(spark):
    texts = ["def f(a):\n    return é_1", "", None, "𝐀 x{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string").select("i", renames._profile("body").alias("p"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    for row in df.collect():
        text = texts[row["i"]] or ""
        want = [sum(c in group for c in text) for group in renames._GROUPS]
        assert list(row["p"]) == [*want, len(text) - sum(want)]


def test_file_versions_are_spread_by_count(spark, tmp_path):
    """Also where the shuffle width is the width asked for, so that the grouping could stand for the repartition."""
    from pyspark.sql import functions as F

    from catalog import sources

    items = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame([(i, i % 7, 1, 2.0) for i in range(50)], items).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = "p_partkey long, p_type string, p_size int"
    spark.createDataFrame([(i, "T", i) for i in range(7)], parts).write.parquet(f"{tmp_path}/part.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = sources.versions(spark, str(tmp_path)).select("l_orderkey", F.explode(F.array("ln", "n")))
        assert rows.rdd.getNumPartitions() == 64
        assert rows.count() == 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# ---- renames of commits that lie in one task ---------------------------------------------------


def as_matched(spark, rows, across=True):
    df = spark.createDataFrame(rows, LOOSE)
    out = changes.matched(df, across)
    return sorted(map(repr, (tuple(r) for r in out.collect())))


@pytest.mark.parametrize("across", [True, False])
def test_commits_in_one_task_and_in_joins_give_the_same(spark, monkeypatch, across):
    """Also with rows that come twice, files that are in the root, changes that are no ends, and commits without a hash."""
    rng = random.Random(11)
    rows = loose_rows(rng, commits=7, per_side=11, files=[*FILES, "/x.py"])
    rows += rng.sample(rows, 12)
    rows += [(None, *r[1:]) for r in rows[:9]] + [(*r[:4], "modified", *r[5:11], None) for r in rows[:5]]
    rows += [("c1", "a.py", "é", "function", side, i, i, i, "", "e", 0, "") for i, side in enumerate(("deleted", "added"), 1)]
    one_task = as_matched(spark, rows, across)
    monkeypatch.setattr(renames, "TOGETHER", 0)
    assert as_matched(spark, rows, across) == one_task
    monkeypatch.setattr(renames, "TOGETHER", 20)  # some commits each way
    assert as_matched(spark, rows, across) == one_task


def test_batches_cut_commits_anywhere():
    import pyarrow as pa
    from annalist.operators import together

    rows = sorted(loose_rows(random.Random(5), commits=5, per_side=9, files=FILES))
    names = [c.split()[0] for c in LOOSE.replace("body_hash", "lines").split(", ")]
    columns = dict(zip(names, zip(*rows)))
    columns["lines"] = [e - s + 1 for s, e in zip(columns["start_line"], columns["end_line"])]
    types = {"place": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32()}
    whole = pa.RecordBatch.from_arrays([pa.array(v, types.get(k)) for k, v in columns.items()], names)

    def found(size):
        parts = [whole.slice(i, size) for i in range(0, whole.num_rows, size)]
        return sorted(map(repr, (r for b in together.matcher(True)(iter(parts)) for r in b.to_pylist())))

    want = {(o[0], o[2], o[1], o[3], o[4]) for o in plain_greedy(rows, False)}
    assert found(1) == found(7) == found(1000)
    monkey = together.PAIRS
    try:
        together.PAIRS = 3
        assert found(1000) == found(7)
    finally:
        together.PAIRS = monkey
    inside = plain_greedy(rows, True)
    got = [r for b in together.matcher(False)(iter([whole])) for r in b.to_pylist() if r["change_type"] == "renamed"]
    assert {(r["commit_hash"], r["kind"], r["old_name"], r["old_file_path"], r["name"], r["file_path"], r["confidence"]) for r in got} == inside and want


def test_ordinary_commits_meet_after_one_shuffle(spark, monkeypatch):
    """No join, and no step that is repeated for every round of the choice."""
    rows = loose_rows(random.Random(6), commits=3, per_side=8, files=FILES)
    monkeypatch.setattr(renames, "match", lambda *a, **k: pytest.fail("ends of small commits were joined"))
    out = changes.matched(spark.createDataFrame(rows, LOOSE), True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and out.count() > 0


def test_lines_of_a_batch_are_read_once(monkeypatch):
    """Two versions of a file share their lines; both sides of a row are compared in the helper."""
    import pyarrow as pa

    read = []
    plain = definitions._named
    monkeypatch.setattr(definitions, "_named", lambda line, language: read.append(line) or plain(line, language))
    before = "def f():\n    return 1\n\ndef g():\n    return 2"
    after = before.replace("2", "3")
    found = definitions.comparer(True).func(*[pa.array(x) for x in ([before, None, before], [after, after, before], ["python"] * 3)]).to_pylist()
    assert [[(d["name"], d["change_type"], d["start_line"], d["end_line"], d["body"]) for d in row] for row in found] == [
        [("g", "modified", 4, 5, None)],
        [("f", "added", 1, 2, "def f():\n    return 1"), ("g", "added", 4, 5, "def g():\n    return 3")],
        [],
    ]
    assert len(read) == len(set(read))
