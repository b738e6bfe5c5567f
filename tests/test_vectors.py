import numpy as np
from conftest import dicts

from annalist.operators import vectors

SCHEMA = "type string, ref_id string, vector array<float>"


def frames(spark, seed, n, dims, clusters, spread, asked):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dims))
    rows = centres[draw.integers(clusters, size=n)] + spread * draw.normal(size=(n, dims))
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    stored = spark.createDataFrame([("function" if i % 3 else "commit", f"r{i:05d}", r.tolist()) for i, r in enumerate(rows)], SCHEMA)
    queries = spark.createDataFrame([(f"q{i}", rows[i].tolist()) for i in asked], "query_id string, vector array<float>")
    return rows.astype(np.float64), stored, queries


def plain(rows, asked, k):
    """query: references of the k most similar rows with a cosine of 0.05 or more, by cosine and key."""
    out = {}
    for i in asked:
        scored = sorted((-float(rows[i] @ r), "function" if j % 3 else "commit", f"r{j:05d}") for j, r in enumerate(rows))
        out[f"q{i}"] = [ref for s, _, ref in scored[:k] if -s >= 0.05]
    return out


def listed(df):
    out = {}
    for r in sorted(dicts(df), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["ref_id"])
    return out


def test_all_lists_are_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "VECTORS", 40)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    asked = range(0, 600, 20)
    rows, stored, queries = frames(spark, 1, 600, 12, 40, 0.8, asked)
    odd = spark.createDataFrame([("commit", "short", [1.0]), ("commit", "none", None)], SCHEMA)
    vectors.build(stored.unionByName(odd), str(tmp_path / "l"), 12, lists=8)
    index = vectors.load(spark, str(tmp_path / "l"))
    assert index.vectors.count() == 600 and len(index.centroids) == 8
    assert listed(vectors.search(index, queries, k=5)) == plain(rows, asked, 5)


def test_recall_of_some_lists(spark, tmp_path):
    asked = range(0, 4000, 50)
    rows, stored, queries = frames(spark, 2, 4000, 32, 100, 0.25, asked)
    vectors.build(stored, str(tmp_path / "l"), 32, lists=32)
    got = listed(vectors.search(vectors.load(spark, str(tmp_path / "l")), queries, k=10, probes=6))
    want = plain(rows, asked, 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_nothing_stored_or_asked(spark, tmp_path):
    _, stored, queries = frames(spark, 3, 20, 4, 2, 0.1, [1])
    vectors.build(stored.limit(0), str(tmp_path / "none"), 4)
    assert dicts(vectors.search(vectors.load(spark, str(tmp_path / "none")), queries)) == []
    vectors.build(stored, str(tmp_path / "some"), 4)
    assert dicts(vectors.search(vectors.load(spark, str(tmp_path / "some")), queries.limit(0))) == []
