"""Quality rules and source mixture against plain versions and their SQL."""

import collections

import duckdb
from helpers import MESSY, docs, prose, words

from annalist.llm import mixture, quality


def against_sql(spark, tmp_path, frame, result, sql):
    frame.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "t"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    answer = db.execute(sql)
    columns = [d[0] for d in answer.description]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, result.select(*columns).collect()), key=key) == sorted(answer.fetchall(), key=key)


def counts(text):
    """The base counts, written plainly."""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(windows)
    inside = {j for i, g in enumerate(windows) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    bare = "".join(w)
    return len(w), len(bare), sum(c in "#*$%&|<>" for c in bare), len(lines) - len(set(lines)), len(inside)


def corpus(spark):
    rows = [(100 + i, prose(i, 100 + i % 37), "en", "a") for i in range(90)]
    rows += [(300 + i, " ".join(w + "%%%" for w in prose(i, 90).split()), "en", "a") for i in range(6)]
    rows += [(400 + i, "x y z\nx y z\n" * 3 + prose(i, 60) + "\n" + "é ü 😀 " * 2, "de", "b") for i in range(12)]
    return docs(spark, rows + MESSY)


def test_quality_counts_and_outliers(spark, tmp_path):
    frame = corpus(spark)
    result = quality.quality(frame)
    rows = result.collect()
    expected = collections.Counter((i, *counts(t)) for i, t in ((r["doc_id"], r["text"]) for r in frame.collect()))
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == expected
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.doc_id and 100 <= r.doc_id < 200:
            assert r.kept
        if r.doc_id and 300 <= r.doc_id < 310:
            assert not r.kept and not r.base_failed
    against_sql(spark, tmp_path, frame, result.drop("d2"), quality.check_sql())
    assert quality.good(frame).columns == frame.columns
    assert sorted(r.doc_id for r in quality.good(frame).filter("doc_id < 10").collect()) == [4, 4, 6, 9]


def test_quality_of_nothing(spark):
    assert quality.quality(docs(spark, [])).collect() == []
    assert all(not r.kept for r in quality.quality(docs(spark, [(1, None, None, None), (None, "", None, None)])).collect())


def test_quality_is_native(spark):
    plan = quality.quality(docs(spark, MESSY))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixture_against_sql_and_rules(spark, tmp_path):
    frame = corpus(spark)
    result = mixture.mixture(frame)
    against_sql(spark, tmp_path, frame, result, mixture.check_sql())
    rows = result.collect()
    assert len(rows) == frame.count()
    taken, targets = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    assert all(taken[s] == int(targets[s]) for s in targets)
    assert abs(sum(targets.values()) - sum(r.size for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixture.mixture(frame.repartition(7)).collect()))


def test_mixture_refills_until_nothing_is_above(spark):
    rows = [(i, prose(i, n), "en", s) for i, (s, n) in enumerate([("a", 10), ("b", 2000), ("c", 500), ("d", 40), ("e", 900), (None, 30)])]
    sizes = {s: n for s, n in [("a", 10), ("b", 2000), ("c", 500), ("d", 40), ("e", 900), (None, 30)]}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    total, open_, targets = sum(sizes.values()), set(sizes), {}
    while True:
        left = total - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        targets |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    targets |= share
    got = {r.source: r.target for r in mixture.mixture(docs(spark, rows)).collect()}
    assert all(abs(got[s] - targets[s]) < 1e-6 for s in sizes)


def test_mixture_of_nothing(spark):
    assert mixture.mixture(docs(spark, [])).collect() == []
    assert [r.taken for r in mixture.mixture(docs(spark, [(1, None, None, None)])).collect()] == [0]
    frame = docs(spark, MESSY)
    assert mixture.mixed(frame).columns == frame.columns
