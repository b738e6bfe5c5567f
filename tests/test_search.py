import math
import random

import pytest
from conftest import dicts

from annalist.functions import text
from annalist.functions.numbers import round_exact
from annalist.operators import documents, lineage, search
from annalist.sources import tables
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_split_identifiers(spark):
    split = lambda v: one(spark, text.split_identifiers, v)
    assert split("GitMiningEngine") == "GitMiningEngine engine git mining"
    assert split("get_blame_for_file") == "get_blame_for_file blame file for get"
    assert split("test123func") == "test123func 123 func test"
    assert split("XMLParser2") == "XMLParser2 2 parser xml"
    assert split("plain") == "plain"
    assert split("Fix plain __x") == "Fix plain __x Fix __x plain x"
    assert split("42") == "42"


def test_query_weights(spark):
    for query, side, least in [
        ("EmailSyncManager", 0, 0.7), ("get_auth_token", 0, 0.7), ("email streaming bridge", 1, 0.6),
        ("how does authentication work", 1, 0.7),
    ]:
        weights = tuple(one(spark, text.query_weights, query))
        assert weights[side] > least and min(weights) >= 0.15 - 1e-9 and math.isclose(sum(weights), 1)
    assert tuple(one(spark, text.query_weights, "two words")) == (0.5, 0.5)
    assert tuple(one(spark, text.query_weights, "")) == (0.5, 0.5)


def test_like_wildcards_and_case(spark):
    df = spark.createDataFrame([("contest.py",), ("TEST_a",), ("Ärger",), ("a\\b",)], "v string")
    match = lambda needle: [r[0] for r in df.filter(text.contains(F.col("v"), needle)).collect()]
    assert match("test_") == ["contest.py", "TEST_a"]
    assert match("ärger") == []  # only ASCII letters fold
    assert match("a\\b") == ["a\\b"]


def test_round_exact(spark):
    rng = random.Random(1)
    values = [0.15, 2.675, 1.005, 0.0625, 12.25, 33.45, 2.5, 0.5, 1 / 3, 0.8125, 0.0005, 0.1235, 100.0, 0.0]
    values += [rng.randint(0, 4000) / rng.choice([80, 400, 2000, 16, 7]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", *[round_exact(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 3)]).collect()
    for row in rows:
        assert [row[f"d{d}"] for d in (0, 1, 2, 3)] == [round(row["v"], d) for d in (0, 1, 2, 3)]


def corpus(make_history):
    changes = [("process_data", f"f{i}.py", f"c{i}", "modified", 1, 0, "Ann", 86400 * i, f"Fix café bug {i}") for i in range(6)]
    return make_history(
        commits=[(f"c{i}0000000", "Ann", 86400 * i, f"Fix café bug {i}", i) for i in range(6)]
        + [("dead", "Bob", 0, "Tidy up", 1)],
        functions=[("process_data", "f1.py", "python", 1, 4, "function", "def process_data(x)", "Doc"),
                   ("data", "f2.py", "python", 1, 4, "function", "def data(process)", "")],
        function_changes=changes,
        blame_entries=[("process_data", "f1.py", "Ann", 15, 75.0, "c1"), ("process_data", "f1.py", "Bob", 5, 25.0, "c1")],
    )


def plain_scores(docs, terms):
    """Word positions and BM25 in plain Python."""
    import re
    import unicodedata

    def tokens(value):
        bare = "".join(c for c in unicodedata.normalize("NFD", value.lower()) if not unicodedata.combining(c))
        return re.findall(r"[^\W_]+", bare)

    fields = [[tokens(d[c]) for c in search.DOCUMENT] for d in docs]
    lengths = [sum(map(len, f)) for f in fields]
    mean = sum(lengths) / len(lengths)

    def tf(doc, phrase):
        return sum(f[i : i + len(phrase)] == phrase for f in doc for i in range(len(f)))

    scores = {}
    for n, (doc, field) in enumerate(zip(docs, fields)):
        total, every = 0.0, True
        for phrase in terms:
            holding = sum(tf(f, phrase) > 0 for f in fields)
            idf = math.log((len(docs) - holding + 0.5) / (holding + 0.5))
            count = tf(field, phrase)
            every &= count > 0
            total += (idf if idf > 0 else 1e-6) * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * lengths[n] / mean))
        if every:
            scores[tuple(doc[c] for c in search.DOCUMENT)] = round(total, 9)
    return scores


@pytest.mark.parametrize("query, terms", [
    ("cafe", [["cafe"]]), ("process_data", [["process", "data"]]), ("Fix bug", [["fix"], ["bug"]]),
    ("tidy", [["tidy"]]), ("café", [["caf"]]),
])
def test_keyword_scores(make_history, query, terms):
    docs = search.documents(corpus(make_history))
    got = {tuple(r[c] for c in search.DOCUMENT): round(r["score"], 9) for r in dicts(search.keyword_scores(docs, query))}
    assert got == plain_scores(dicts(docs), terms)


def test_documents(make_history):
    docs = {(r["type"], r["name"], r["file_path"]): r for r in dicts(search.documents(corpus(make_history)))}
    f = docs["function", "process_data", "f1.py"]
    assert f["author"] == "Ann" and f["detail"] == "function in f1.py lines 1-4 (python)"
    assert f["content"].startswith("function process_data data process def process_data(x)")
    assert docs["commit", "c1000000", ""]["detail"] == "commit c1000000 on 1970-01-02 (1 files)"
    assert docs["change", "process_data", "f3.py"]["detail"] == "modified +1/-0 in c3"
    counts = {r["type"]: r["documents"] for r in dicts(search.document_counts(search.documents(corpus(make_history))))}
    assert counts == {"commit": 7, "function": 2, "change": 6}
    assert dicts(search.keyword_search(search.documents(corpus(make_history)), " .. ")) == []


def test_vector_search(make_history, table):
    h = corpus(make_history)
    vectors = [("function", "process_data::f1.py", "", [1.0, 0.0], "m"), ("function", "gone::a::b.py", "", [0.6, 0.8], "m"),
               ("commit", "c20000000", "", [0.28, 0.96], "m"), ("commit", "dead", "", [0.0, 1.0], "m")]
    h = h.with_tables(embeddings=table("embeddings", vectors))
    rows = dicts(search.vector_search(h, search.unit([2.0, 0.0])))
    assert [(r["name"], r["file_path"], r["relevance"]) for r in rows] == [
        ("process_data", "f1.py", "HIGH"), ("gone", "a::b.py", "HIGH"), ("c2000000", "", "FAIR"),
    ]
    assert rows[0]["detail"] and rows[1]["detail"] == "" and rows[2]["author"] == "Ann"
    assert dicts(search.embedding_stats(h.embeddings)) == [{"total": 4, "functions": 2, "commits": 2, "model": "m", "dim": 2}]
    assert dicts(search.embedding_stats(h.embeddings.limit(0))) == []
    todo = {r["ref_id"]: r["text"] for r in dicts(search.embedding_work(h))}
    assert "process_data::f1.py" not in todo and "dead" not in todo
    assert todo["data::f2.py"] == "data — function in f2.py\nSignature: def data(process)"
    assert todo["c10000000"] == "Fix café bug 1\nFiles changed: 1\nAuthor: Ann"
    assert len(dicts(search.embedding_work(h, model_changed=True))) == 9
    replaced = tables.upsert("embeddings", h.embeddings, table("embeddings", [("commit", "dead", "t", [1.0, 1.0], "n")]))
    assert replaced.count() == 4 and replaced.filter("model = 'n'").count() == 1


def test_hybrid_keeps_three_per_file(make_history, table):
    functions = [(f"func{i} x", "same_file.py", "python", i, i, "function", "func", "") for i in range(10)]
    functions += [("func", "other.py", "python", 1, 2, "function", "func", "")]
    h = make_history(commits=[("h" * 40, "A", 5, "func too", 1)], functions=functions, function_changes=[],
                     blame_entries=[], embeddings=[("commit", "h" * 40, "", [1.0, 0.0], "m")])
    h = h.with_tables(search_index=search.documents(h))
    exact = dicts(search.hybrid_search(h, "func", None, limit=20))
    paths = [r["file_path"] for r in exact]
    assert paths.count("same_file.py") == 3 and paths.count("other.py") == 1
    assert {r["source"] for r in exact} == {"exact"}
    # with vectors the commit found both ways is far ahead, and the rest falls below the cutoff
    rows = dicts(search.hybrid_search(h, "func", [1.0, 0.0], limit=20))
    assert [(r["type"], r["source"], r["relevance"]) for r in rows] == [("commit", "hybrid", "HIGH")]


# ---- rename chains ----------------------------------------------------------------------


def test_history_follows_renames(make_history):
    change = lambda name, commit, ts: (name, "a.py", commit, "modified", 1, 0, "A", ts, "m")
    rename = lambda old, new: ("c", old, "a.py", "function", new, "a.py", "function", 0.9)
    h = make_history(
        function_changes=[change("old", "c1", 1), change("mid", "c2", 2), change("new", "c3", 3), change("side", "c4", 4)],
        function_renames=[rename("old", "mid"), rename("mid", "new"), rename("old", "side"), rename("new", "old")],
    )
    names = lambda rows: [r["function_name"] for r in dicts(rows)]
    # the cycle back to old is not walked forward again, so "side" stays out of it
    assert names(lineage.function_history(h, "mid", "a.py")) == ["new", "mid", "old"]
    assert names(lineage.history_by_name(h, "mid")) == ["new", "mid", "old"]
    assert names(lineage.function_history(h, "mid", "a", fuzzy=True)) == ["mid"]
    gone = make_history(function_changes=[change("new", "c3", 3)], function_renames=[rename("lost", "new")])
    assert names(lineage.history_by_name(gone, "lost")) == ["new"]


def test_long_chains(make_history, monkeypatch):
    monkeypatch.setattr(lineage, "MERGED", 2)
    change = lambda i: (f"n{i}", "a.py", f"c{i}", "modified", 1, 0, "A", i + 1, "m")
    h = make_history(
        function_changes=[change(i) for i in range(9)],
        function_renames=[("c", f"n{i}", "a.py", "function", f"n{i + 1}", "a.py", "function", 0.9) for i in range(8)],
    )
    assert [r["function_name"] for r in dicts(lineage.function_history(h, "n4", "a.py"))] == [f"n{i}" for i in range(8, -1, -1)]


# ---- documents -----------------------------------------------------------------------------


def test_project_context(spark):
    changelog = ("# Log\n## [1.2.0] - 2025-11-16 — Big\n## v0.9 (2025-01-02)\nx\n##  0.8 — 2024-01-01 - odd\n## 0.7 - 2023-01-01")
    files = [("README.md", "# T\n\n  First line \nsecond\n\nmore", ), ("README.rst", "no"), ("CHANGELOG.md", changelog),
             ("docs/b.md", ""), ("docs/a.rst", ""), ("docs/x/c.md", ""), ("docs/p.png", "")]
    got = documents.project_context(spark.createDataFrame(files, "file_path string, content string"))
    assert dicts(got["description"])[0]["description"] == "First line second"
    assert [(r["version"], r["date"], r["title"]) for r in dicts(got["milestones"])] == [
        ("1.2.0", "2025-11-16", "— Big".lstrip("—").strip()), ("0.9", "2025-01-02", ""),
        ("0.8", "2024-01-01", "odd"), ("0.7", "2023-01-01", ""),
    ]
    assert dicts(got["doc_count"]) == [{"doc_count": 2}]
    assert [r["name"] for r in dicts(got["doc_names"])] == ["a.rst", "b.md"]


def test_a_chain_reads_the_renames_once(spark, make_history):
    chain = [("c", f"n{i}", "a.py", "function", f"n{i + 1}", "a.py", "function", 0.9, None) for i in range(6)]
    changes = [("n3", "a.py", "c3", "modified", 1, 1, "Ada", 5, "m")]
    h = make_history(function_renames=chain, function_changes=changes)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    columns = h.function_renames.drop("signals")
    h = h.with_tables(function_renames=columns.mapInPandas(counted, columns.schema))
    seeds = spark.createDataFrame([("a.py", "n3", "a.py")], "seed string, name string, path string")
    assert {r["name"] for r in lineage.rename_chain(h, seeds).collect()} == {f"n{i}" for i in range(7)}
    assert read.value == len(chain)


def test_chains_end_at_nodes_without_a_name(spark, make_history):
    renames = [
        ("c", None, "a.py", "function", "n1", "a.py", "function", 0.9, None),
        ("c", "n0", "a.py", "function", None, "a.py", "function", 0.9, None),
        ("c", "n1", "a.py", "function", "n0", "a.py", "function", 0.9, None),
    ]
    h = make_history(function_renames=renames)
    seeds = spark.createDataFrame([(None, "n1", "a.py"), ("s", "n1", "a.py"), ("s", None, "a.py")], "seed string, name string, path string")
    assert sorted(((r["seed"], r["name"]) for r in lineage.rename_chain(h, seeds).collect()), key=str) == [
        ("s", "n0"), ("s", "n1"), ("s", None), (None, "n0"), (None, "n1"), (None, None)
    ]
