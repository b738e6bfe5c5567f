"""Similarity joins, line templates and cap filters against brute force."""

import itertools

import duckdb
import numpy as np
from helpers import MESSY, docs, prose, words

from annalist.llm import capfilters, logtree, partenum


def closure(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies():
    """A chain whose neighbours are similar and whose ends are not, copies, and texts around the limit."""
    base = prose(1, 400).split()
    rows = [(10 + k, " ".join([f"x{k}{i}" if i < 14 * k and i % 2 else w for i, w in enumerate(base)]), "en", "a") for k in range(8)]
    rows += [(40 + k, " ".join(base[: 300 + 3 * k]).upper(), "en", "a") for k in range(20)]
    rows += [(70 + k, " ".join(prose(2, 60).split() + prose(90 + k, 25).split()), "en", "a") for k in range(25)]
    rows += [(100 + k, "one two three four"[: 3 + 5 * (k % 4)], "en", "a") for k in range(8)]
    rows += [(120 + k, prose(200 + k, 6 + k % 9), "en", "a") for k in range(30)] + [(160 + k, prose(200 + k, 6 + k % 9) + " more", "en", "a") for k in range(30)]
    return rows


def expected_classes(rows):
    sets = {}
    for i, t, _, _ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    links = [
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])
    ]
    return closure(sets, links)


def test_partenum_equals_all_pairs(spark):
    rows = near_copies() + MESSY
    frame = docs(spark, rows)
    got = partenum.classes(frame).collect()
    labels = expected_classes(rows)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(labels.items())
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t, _, _ in rows)
    kept = partenum.first_of_each(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in labels.items() if i == c} | {None}


def test_partenum_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 3)
    rows = near_copies()
    got = partenum.classes(docs(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected_classes(rows)


def test_every_similar_pair_shares_a_signature():
    random = np.random.default_rng(3)
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 14, 15, 16, 17, 31, 40, 63, 64, 100, 127, 128, 129, 300, 511, 512, 700]:
        for _ in range(30):
            whole = random.integers(1, 2**63, size * 2, dtype=np.uint64)
            common = int(np.ceil(size * 0.75))
            a = np.unique(whole[:size])
            b = np.unique(whole[size - common : size])  # a subset at the limit
            swap = (2 * size) // 14
            c = np.unique(np.concatenate([whole[swap:size], whole[size : size + swap]]))
            for other in (b, c):
                inter = len(np.intersect1d(a, other))
                if 100 * inter < 75 * len(np.union1d(a, other)):
                    continue
                found = [set(partenum._signatures(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0].tolist()) for x in (a, other)]
                assert found[0] & found[1], size


def test_partenum_of_nothing(spark):
    assert partenum.classes(docs(spark, [])).collect() == []
    got = partenum.classes(docs(spark, [(1, None, None, None), (2, "", None, None), (None, "a b", None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("1", 0, "1"), ("2", 0, "2"), ("None", 1, "None")]


def test_templates_against_sql(spark, tmp_path):
    rows = [(i, f"Posted by user{i} on day {i * 3} of the month\n{prose(i, 12)}\n" + "all rights of this page are reserved", "en", "a") for i in range(101, 109)]
    rows += [(20 + i, "short line\n" + f"The item {prose(i, 1)} has {prose(50 + i, 1)} of {prose(70 + i, 1)} here", "en", "a") for i in range(5)]
    rows += [r for r in MESSY if r[0] not in (None, 4)]
    frame = docs(spark, rows)
    frame.select("doc_id", "text").write.parquet(str(tmp_path / "t"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    got = sorted(map(tuple, logtree.report(frame).collect()))
    assert got == sorted(db.execute(logtree.check_sql()).fetchall())
    dropped = {r[0]: r[3] for r in got}
    assert dropped[101] == "" and all(dropped[i] == "0,2" for i in range(102, 109))
    assert dropped[20] == "" and all(dropped[i] == "1" for i in range(21, 25))
    out = {}
    for r in logtree.without_repeats(frame).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [(r.text, r.n_chars) for r in out[105]] == [(prose(105, 12), len(prose(105, 12)))]
    assert [r.text for r in out[101]] == [rows[0][1]] and [r.text for r in out[21]] == ["short line"] and [r.lang for r in out[102]] == ["en"]
    # every other row stays as it is
    assert sorted((r[0], r[1] or "") for r in rows[13:]) == sorted((r.doc_id, r.text or "") for i in out if i < 20 for r in out[i])


def test_templates_drop_emptied_rows_and_nothing_else(spark):
    line = "this very line stands in many documents"
    frame = docs(spark, [(i, line, "en", "a") for i in range(5)] + MESSY)
    out = logtree.without_repeats(frame)
    assert out.columns == frame.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(0) == 1 and not {1, 2, 3, 4} - set(ids) - {1, 2, 3, 4}
    assert {6, 7, 8, 9, None} <= set(ids)
    assert logtree.report(docs(spark, [])).collect() == []
    assert logtree.without_repeats(docs(spark, [])).collect() == []


def test_rows_of_one_document_lose_their_own_lines(spark):
    line = "this very line stands in many documents"
    rows = [(i, line, "en", "a") for i in range(4)] + [(3, prose(1, 20), "en", "a"), (3, f"{prose(2, 9)}\n{line}", "en", "a")]
    out = sorted((r.doc_id, r.text) for r in logtree.without_repeats(docs(spark, rows)).collect())
    assert out == sorted([(0, line), (3, prose(1, 20)), (3, prose(2, 9))])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int, first int, filter int")


def test_cap_filters_equal_all_pairs(spark):
    random = np.random.default_rng(1)
    rows, centres = [], random.normal(size=(40, 32))
    for i in range(400):
        rows.append((i, (centres[i % 40] + random.normal(size=32) * 0.18).astype(np.float32).tolist()))
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(540 + i, [2 * x for x in rows[1][1]]) for i in range(3)]
    rows += [(600, None), (601, []), (602, [0.0] * 32), (603, [float("nan")] * 32), (604, [None] + [1.0] * 31), (605, [float("inf")] * 32),
             (606, [1.0, 2.0]), (607, [1.0, 2.01]), (None, rows[0][1]), (608, [1e-30] * 32), (609, [1e30] * 32)]
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and i not in range(600, 606)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(good), 2) if len(good[a]) == len(good[b]) and unit[a] @ unit[b] >= 0.95]
    label = closure([i for i, _ in rows if i is not None], links)
    got = {r.vec_id: r for r in capfilters.linked(vectors(spark, rows)).collect()}
    count = {i: 0 for i in got}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert len(got) == len(rows)
    assert {i: r.n_links for i, r in got.items()} == count
    assert {i: r.component_id for i, r in got.items() if i is not None} == label
    assert all(r.kept == (i is None or label[i] == i) for i, r in got.items())


def test_cap_filters_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", 4)
    random = np.random.default_rng(2)
    centre = random.normal(size=16)
    rows = [(i, (centre + random.normal(size=16) * 0.05).astype(np.float32).tolist()) for i in range(30)]
    got = capfilters.linked(vectors(spark, rows)).collect()
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
    expected = ((unit @ unit.T) >= 0.95).sum(axis=1) - 1
    assert [r.n_links for r in sorted(got)] == expected.tolist()


def test_codes_keep_the_miss_bound():
    random = np.random.default_rng(8)
    for size, words in ((2, 16), (8, 16), (32, 16), (64, 24)):
        several = [capfilters.Code(size, words, k) for k in range(capfilters.codes_needed(size, words, 0.95))]
        for _ in range(200):
            x, y = np.linalg.qr(random.normal(size=(size, 2)))[0].T
            y = 0.95 * x + np.sqrt(1 - 0.95**2) * y
            assert any(set(code.passed(x).tolist()) & set(code.passed(y).tolist()) for code in several)


def test_cap_filters_of_nothing(spark):
    assert capfilters.linked(vectors(spark, [])).collect() == []


def test_decoding_lists_all_filters():
    code = capfilters.Code(16, 5)
    vector = np.random.default_rng(0).normal(size=16)
    unit = vector / np.linalg.norm(vector)
    turned = code.turn @ unit
    scores = {}
    for choice in itertools.product(range(5), repeat=4):
        number = (choice[0] * 5 + choice[1]) * 25 + choice[2] * 5 + choice[3]
        scores[number] = sum(book[c] @ turned[p] for book, c, p in zip(code.books, choice, code.parts))
    found = code.passed(unit)
    assert len(set(found.tolist())) == len(found) >= 12
    least = min(scores[f] for f in found)
    assert {n for n, s in scores.items() if s > least} <= set(found.tolist())


def test_partenum_gives_no_more_signatures_than_partners_may_differ_in():
    """A set gives one signature more than a partner may differ in, per band, and similar sets still share one."""
    random = np.random.Generator(np.random.PCG64(5))
    for n in (1, 2, 3, 4, 7, 12, 31, 48, 63, 64, 150, 255, 256, 500):
        whole = random.integers(0, 2**63, n + n // 3, dtype=np.uint64)
        base, sets = np.unique(whole[:n]), []
        for more in range(0, n // 3 + 1, max(1, n // 12)):
            # *more* shingles come and as many go as a Jaccard similarity of 3/4 allows
            less = (len(base) - 3 * more) // 4 if len(base) >= 3 * more else 0
            sets.append(np.unique(np.concatenate([base[less:], whole[n : n + more]])))
        sets.append(base)
        sizes = np.array([len(s) for s in sets])
        rows = np.repeat(np.arange(len(sets)), sizes)
        signatures, of = partenum._signatures(np.concatenate(sets), rows, sizes)
        mine = [set(signatures[of == i].tolist()) for i in range(len(sets))]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                common = len(np.intersect1d(a, b))
                if 4 * common >= 3 * (len(a) + len(b) - common):
                    assert mine[i] & mine[j], (n, len(a), len(b))
        bands = 1 + (4 * sizes >= 3 * (1 << np.frexp(sizes)[1]))
        if n >= 150:
            assert all(len(m) <= k * (s // 3 + 1) for m, k, s in zip(mine, bands, sizes))
