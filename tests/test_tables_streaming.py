import random

from conftest import dicts

from annalist.plans.shapes import ordered_chunks, running_count, with_previous
from annalist.schema import SCHEMAS
from annalist.sources import tables
from annalist.streaming import ingest, live
from pyspark.sql import functions as F


def small(make_history):
    return make_history(
        commits=[("c1", "A", 86400, "Add f", 1, ["x"]), ("c2", "B", 2 * 86400, 'Say "hi",\nplease', 1)],
        functions=[("f", "a.py", "python", 1, 2, "function", "def f()", ""), ("g", "b.py", "python", 1, 2, "function", "def g()", "")],
        function_changes=[("f", "a.py", "c1", "added", 2, 0, "A", 86400, "Add f"),
                          ("f", "a.py", "c2", "modified", 1, 1, "B", 2 * 86400, 'Say "hi",\nplease')],
        blame_entries=[("f", "a.py", "A", 2, 100.0, "c1")],
    )


def test_save_and_load(spark, make_history, tmp_path):
    h = small(make_history)
    tables.save(h, str(tmp_path))
    back = tables.load(spark, str(tmp_path), "commits", "functions")
    assert dicts(back.commits.orderBy("hash")) == dicts(h.commits.orderBy("hash"))
    assert back.functions.schema == SCHEMAS["functions"]


def test_export(spark, make_history, tmp_path):
    h = small(make_history)
    tables.export(h, str(tmp_path / "j"), as_of=86400 * 30, fmt="json")
    assert spark.read.json(str(tmp_path / "j" / "changes")).count() == 2
    tables.export(h, str(tmp_path / "c"), as_of=86400 * 30, fmt="csv", sections=["changes", "authors"])
    rows = spark.read.csv(str(tmp_path / "c" / "changes"), header=True, multiLine=True, escape='"').collect()
    assert [r["message"] for r in rows] == ["Add f", 'Say "hi",\nplease']
    assert not (tmp_path / "c" / "blame").exists()


def test_upsert_and_replace(make_history, table):
    h = small(make_history)
    update = table("functions", [("f", "a.py", "python", 1, 9, "function", "def f(x)", ""), ("n", "a.py", "python", 4, 5, "function", "", "")])
    rows = {r["name"]: r for r in dicts(tables.upsert("functions", h.functions, update))}
    assert (rows["f"]["end_line"], rows["g"]["end_line"], rows["n"]["end_line"]) == (9, 2, 5)
    changed = update.select("file_path")
    assert sorted(r["name"] for r in dicts(tables.replace_files(h.functions, update, changed))) == ["f", "g", "n"]


# ---- ordered chunks -------------------------------------------------------------------


def test_running_count_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(5 if i % 3 else rng.randint(0, 50), f"{rng.random():.12f}", rng.choice("ab"), rng.randint(0, 1)) for i in range(5000)]
    df = spark.createDataFrame(rows, "t bigint, k string, g string, x int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep small chunks apart
    try:
        chunks = ordered_chunks(df, "t", "k")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert chunks.rows.select("chunk").distinct().count() > 1
    got = {r["k"]: (r["total"], r["mine"]) for r in running_count(chunks, F.col("x"), "total")
           .join(running_count(chunks, F.col("x"), "mine", "g").select("k", "mine"), "k").collect()}
    total, mine = 0, {"a": 0, "b": 0}
    for t, k, g, x in sorted(rows):
        assert got[k] == (total, mine[g])
        total, mine[g] = total + x, mine[g] + x
    previous = {r["k"]: r["p"] for r in with_previous(chunks, "k", "p").collect()}
    order = sorted(rows)
    assert previous == {b[1]: a[1] if a else None for a, b in zip([None, *order], order)}


# ---- streaming ------------------------------------------------------------------------


def raw_tables(make_history, step):
    a1, a2 = "def f():\n    return 1\n", "def f():\n    return 2\n\ndef h():\n    pass\n"
    versions = [("c1", "a.py", "", a1), ("c1", "b.py", "", "def g():\n    pass\n")]
    files = [("c1", "a.py", 2, 0, 2), ("c1", "b.py", 2, 0, 2)]
    heads = {"a.py": a1, "b.py": "def g():\n    pass\n"}
    if step > 1:
        versions += [("c2", "a.py", a1, a2), ("c2", "b.py", "def g():\n    pass\n", ""),
                     ("c2", "requirements.txt", "", "x==1\n"), ("c2", "k.json", "", '{"a": 1}')]
        files += [("c2", "a.py", 4, 1, 5), ("c2", "b.py", 0, 2, 2)]
        heads = {"a.py": a2}
    lines = [(p, i + 1, "c1", "A") for p, t in heads.items() for i in range(t.count("\n"))]
    return make_history(
        file_versions=versions, commit_files=files, blame_lines=lines,
        head_files=[(p, None, t) for p, t in heads.items()],
    )


def test_incremental_ingest(spark, make_history, table, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    step = {"n": 1}

    def run():
        stream = spark.readStream.schema(SCHEMAS["commits"]).parquet(source)
        ingest.start(stream, lambda: raw_tables(make_history, step["n"]), root, checkpoint).awaitTermination()
        return ingest.current(spark, root)

    first = table("commits", [("c1", "A", 10, "Add", 2)])
    first.coalesce(1).write.parquet(source)
    h = run()
    assert sorted(r["name"] for r in dicts(h.functions)) == ["f", "g"]
    assert h.function_changes.count() == 2

    step["n"] = 2
    table("commits", [("c1", "A", 10, "Add", 2), ("c2", "B", 20, "Change", 2)]).coalesce(1).write.mode("append").parquet(source)
    h = run()
    assert sorted(r["name"] for r in dicts(h.functions)) == ["f", "h"]  # b.py is gone
    later = [(r["commit_hash"], r["change_type"]) for r in dicts(h.function_changes)]
    assert sorted(later) == [("c1", "added"), ("c1", "added"), ("c2", "modified"), ("c2", "renamed")]  # g became h
    assert dicts(h.dep_changes)[0]["package"] == "x" and dicts(h.config_changes)[0]["key_path"] == "a"
    assert {r["author"] for r in dicts(h.blame_entries)} == {"A"}

    # the same batch again leaves the tables as they are
    before = {n: sorted(map(str, dicts(t))) for n, t in h.present().items()}
    ingest.index_batch(raw_tables(make_history, 2), table("commits", [("c2", "B", 20, "Change", 2)]), root, 1)
    again = ingest.current(spark, root)
    assert {n: sorted(map(str, dicts(t))) for n, t in again.present().items()} == before
    # and a batch that did not finish is not seen
    table("commits", [("c9", "Z", 30, "x", 1)]).write.parquet(f"{root}/commits/batch=7")
    assert ingest.current(spark, root).commits.count() == 2

    vectors = table("embeddings", [("function", "g::b.py", "", [1.0], "m"), ("function", "f::a.py", "", [1.0], "m"), ("commit", "c1", "", [1.0], "m")])
    assert sorted(r["ref_id"] for r in dicts(ingest.live_embeddings(vectors, again))) == ["c1", "f::a.py"]
    ingest.rebuild_search_index(again, f"{root}/search")
    assert spark.read.parquet(f"{root}/search").filter("type = 'commit'").count() == 2


def test_live_activity(spark, make_history, tmp_path):
    h = small(make_history)
    source = str(tmp_path / "in")
    h.function_changes.write.parquet(source)
    stream = spark.readStream.schema(SCHEMAS["function_changes"]).parquet(source)
    for name, rows in [("months", live.monthly_activity(stream)), ("spots", live.running_hotspots(stream)), ("days", live.daily_activity(stream))]:
        rows.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    assert dicts(spark.table("months")) == [{"month": "1970-01", "changes": 2, "authors": 2}]
    assert dicts(spark.table("spots"))[0]["change_count"] == 2
    assert sorted(r["day"] for r in dicts(spark.table("days"))) == [86400, 2 * 86400]


def test_final_months_leave_the_state(spark, table, tmp_path):
    """Each run restarts from the checkpoint; a month that is long past is written, dropped and closed."""
    day, start = 86400, 18262 * 86400  # 2020-01-01
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    batches = [
        [("f", 10 * day), ("f", 20 * day), ("g", 20 * day)],  # January
        [("f", 50 * day), ("f", 25 * day)],  # February, and January again: not yet late
        [("f", 200 * day)],  # July
        [("f", 15 * day), ("g", 201 * day)],  # January is final by now
    ]
    progress = []
    for n, rows in enumerate(batches):
        facts = [(name, "a.py", f"c{n}{i}", "modified", 1, 0, "A", start + at, "m") for i, (name, at) in enumerate(rows)]
        table("function_changes", facts).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMAS["function_changes"]).parquet(source)

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = live.running_hotspots(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append(query.lastProgress["stateOperators"][0])
    got = {r["function_name"]: (r["change_count"], r["last_changed"] - start) for r in dicts(live.total_hotspots(spark.read.parquet(out)))}
    # the late row of January is left out, all else is counted as a batch would
    assert got == {"f": (5, 200 * day), "g": (2, 201 * day)}
    assert progress[-1]["numRowsTotal"] == 2 and progress[-1]["numRowsDroppedByWatermark"] == 1


def test_vectors_by_batch(spark, make_history, table, tmp_path):
    h, root = small(make_history), str(tmp_path / "v")

    def put(batch, *rows):
        ingest.put_embeddings(table("embeddings", [(t, ref, "", [value], "m") for t, ref, value in rows]), root, batch)

    def now(of=None, at=root):
        return sorted((r["ref_id"], r["vector"][0]) for r in dicts(ingest.current_embeddings(spark, at, of or h)))

    assert now() == []
    put(0, ("function", "f::a.py", 1.0), ("commit", "c1", 1.0), ("function", "gone::a.py", 1.0))
    put(1, ("function", "f::a.py", 2.0), ("function", "g::b.py", 2.0))
    assert now() == [("c1", 1.0), ("f::a.py", 2.0), ("g::b.py", 2.0)]
    put(1, ("function", "f::a.py", 2.0), ("function", "g::b.py", 2.0))  # a replay changes nothing
    assert now() == [("c1", 1.0), ("f::a.py", 2.0), ("g::b.py", 2.0)]
    vanished = h.with_tables(functions=h.functions.filter("name = 'g'"))
    assert now(vanished) == [("c1", 1.0), ("g::b.py", 2.0)]
    other = str(tmp_path / "w")
    ingest.compact_embeddings(spark, root, other, vanished)
    assert now(at=other) == now(vanished) and spark.read.parquet(f"{other}/vectors").count() == 2
    ingest.clear_embeddings(spark, root, 2)
    assert now() == []
    put(3, ("commit", "c2", 3.0))
    assert now() == [("c2", 3.0)]


def test_export_of_all_months(spark, make_history, tmp_path):
    h = small(make_history)
    late = 86400 * 365 * 40
    tables.export(h, str(tmp_path / "cut"), as_of=late, sections=["timeline"])
    tables.export(h, str(tmp_path / "all"), as_of=late, sections=["timeline"], months=None)
    read = lambda n: [r["commits"] for r in spark.read.schema("month string, commits int").json(str(tmp_path / n / "timeline")).collect()]
    assert read("cut") == [] and read("all") == [2]


def test_lookups_skip_files(spark, table, make_history, tmp_path):
    def scanned(df):
        """Rows that a filter over one scan is given after files and row groups were skipped."""
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return leaves.head().metrics().apply("numOutputRows").value()

    rng = random.Random(4)
    facts = [(f"f{i % 50}", f"d{i % 7}/a.py", f"{rng.getrandbits(64):016x}", "modified", 1, 0, "A", 1_000_000 + 1000 * (i // 3), "m") for i in range(4000)]
    h = make_history(function_changes=facts, commits=[(f[2], "A", f[7], "m", 1) for f in facts], tags=[("v1", facts[0][2], 5, "A", "m")])
    tables.save_for_lookup(h, str(tmp_path), files=8)
    back = tables.load(spark, str(tmp_path), "commits", "function_changes", "tags")
    assert len(back.commits.inputFiles()) == 8 and back.tags.count() == 1
    assert sorted(map(str, dicts(back.function_changes))) == sorted(map(str, dicts(h.function_changes)))
    one = back.commits.filter(F.col("hash") == facts[1234][2])
    assert one.count() == 1 and 0 < scanned(one) <= 2 * 4000 / 8  # Bloom filters leave the file that holds it
    period = back.function_changes.filter(F.col("timestamp").between(1_000_000, 1_100_000))
    assert period.count() == 303 and scanned(period) <= 2 * 4000 / 8
    assert scanned(back.function_changes.filter(F.col("commit_hash") == "0" * 16)) <= 4000 / 8
