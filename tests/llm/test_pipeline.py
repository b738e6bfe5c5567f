"""The pipeline against its stages written plainly, and the registered queries."""

import collections
import hashlib
import itertools

import pytest
from helpers import docs, prose, words
from test_native import counts
from test_pairs import closure, shingles

import __spark_entry__ as entry
import corpus_pipeline
from annalist.llm import mixture, transducer

tokenizers = pytest.importorskip("tokenizers")


def corpus():
    rows = [(i, prose(i, 90 + i % 23) + f"\nthis page number {i} belongs to the usual series", "en", f"s{i % 3}") for i in range(1, 40)]
    rows += [(50 + i, rows[i][1] + " end", "en", "s0") for i in range(6)] + [(60, rows[3][1], "en", "s1"), (61, "too short", "en", "s1"), (62, None, None, None)]
    rows += [(70 + i, " ".join(w + "###" for w in prose(i, 80).split()), "en", "s0") for i in range(4)]
    return rows


def test_pipeline(spark, tmp_path):
    rows = corpus()
    frame = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t, s) for i, t, _, s in rows if counts(t)[0] >= 50 and counts(t)[2] == 0]
    # the last line of all is one template; the first document keeps it
    stripped = []
    lines = collections.defaultdict(set)
    for i, t, _ in kept:
        for line in t.split("\n"):
            lines[line].add(i)
    for i, t, s in kept:
        out = []
        for line in t.split("\n"):
            usual = line.startswith("this page number")
            first = 1 if usual and not line.endswith("end") else min(lines[line])
            often = usual or len(lines[line]) >= 3
            if usual and line.endswith("end"):
                often, first = True, 50
            if not often or i == first:
                out.append(line)
        if words("\n".join(out)):
            stripped.append((i, "\n".join(out), s))
    sets = {i: shingles(t) for i, t, _ in stripped}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = closure(sets, links)
    single = [(i, t, s) for i, t, s in stripped if label[i] == i]
    shares = {r.doc_id: r for r in mixture.mixture(docs(spark, [(i, t, "en", s) for i, t, s in single])).collect()}
    library = tokenizers.Tokenizer.from_file(transducer.vocabulary_path())
    expected = []
    for i, t, _ in single:
        times = -(-shares[i].taken // shares[i].size)
        ids = library.encode(t, add_special_tokens=False).ids
        expected += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * times
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(expected)
    assert all(len(r.ids) == r.n_tokens for r in got)


def test_stages_keep_the_columns(spark):
    frame = docs(spark, corpus())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == docs(spark, []).columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "source mixture", "BPE encoding"]


def test_all_ten_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {n for n in entry.oracle_sql() if n.startswith("op")} >= {n for n in names if n.split("_")[0] in ("op1", "op4", "op5", "op8", "op9")}
