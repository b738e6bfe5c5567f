import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import hardneg, queries

VECTORS = "vec_id bigint, embedding array<float>, label int, block int, dims int, chunk string, key int, score int"


def plain(rows, positives=5, negatives=10, least=30, most=90):
    """The contract row by row on (vec_id, label, anchor, q)."""
    out = []
    for a_id, a_label, asks, a in rows:
        if not asks:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, q)), i, label) for i, label, _, q in rows if len(q) == len(a)))
        good = [(i, -s) for s, i, label in scored if label == a_label and i != a_id][:positives]
        for p_id, p in good:
            fits = [(i, -s) for s, i, label in scored if label != a_label and least * p <= -100 * s <= most * p][:negatives]
            out += [(a_id, p_id, rank, i, p, s) for rank, (i, s) in enumerate(fits, 1)]
    return sorted(out)


def clustered(seed, n, dims, labels=6, spread=0.15):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dims))
    out = []
    for i in range(n):
        label = int(draw.integers(labels))
        out.append((i, label, i % 9 == 0, np.floor(256 * (centres[label] + spread * draw.normal(size=dims))).astype(int).tolist()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label bigint, anchor boolean, q array<bigint>")


@pytest.mark.parametrize("bits,dims", [(1, 4), (2, 3), (3, 2), (4, 2), (5, 1), (2, 5)])
def test_hilbert_neighbours(bits, dims):
    cells = np.array(list(itertools.product(range(2**bits), repeat=dims)))
    keys = hardneg.hilbert_keys(cells, bits)
    order = sorted(range(len(cells)), key=lambda i: keys[i].tobytes())
    assert len({keys[i].tobytes() for i in order}) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_products_are_exact():
    draw = np.random.default_rng(4)
    for size in (100, 2**20, 2**40):
        a, q = draw.integers(-size, size, (7, 5)), draw.integers(-size, size, (50, 5))
        scores = hardneg.products(a, q)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in q] for r in a]
        assert scores.tolist() == np.clip(np.array(want, dtype=object), -(2**63), 2**63 - 1).tolist()
        least, greatest = hardneg.bounds(a, q.min(axis=0)[None], q.max(axis=0)[None])
        assert (least[:, 0] <= scores.min(axis=1)).all() and (greatest[:, 0] >= scores.max(axis=1)).all()
    assert hardneg.products(np.zeros((2, 0), int), np.zeros((3, 0), int)).tolist() == [[0] * 3] * 2


@pytest.mark.parametrize("block,chunk,zones", [(7, 5, 4), (64, 256, 256)])
def test_against_all_pairs(spark, monkeypatch, block, chunk, zones):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "CHUNK", chunk)
    monkeypatch.setattr(hardneg, "ZONES", zones)
    monkeypatch.setattr(hardneg, "LANE_BLOCKS", 10)
    rows = clustered(1, 300, 6) + [(i + 1000, 2, i % 5 == 0, [40, 40, 40, -3, 0, 0]) for i in range(60)]  # ties
    rows += [(7, 0, True, rows[7][3]), (7, 0, True, rows[7][3]), (9, 1, True, rows[9][3])]  # repeated rows
    rows += [(2000 + i, i % 2, i == 0, [i, 5]) for i in range(8)] + [(3000 + i, i, True, []) for i in range(3)] + [(3100 + i, 0, True, []) for i in range(2)]
    got = sorted(map(tuple, hardneg.mine(frame(spark, rows)).collect()))
    assert got == plain(rows) and len(got) > 1000


def test_other_numbers_of_rows_and_windows(spark):
    rows = clustered(8, 120, 3, labels=3, spread=0.6)
    got = hardneg.mine(frame(spark, rows), positives=2, negatives=4, least=0, most=100)
    assert sorted(map(tuple, got.collect())) == plain(rows, 2, 4, 0, 100)


def test_bounds_choose_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 8)) * 4
    rows = []
    for i in range(2000):
        at = int(draw.integers(20))
        rows.append((i, at, i == 3, np.floor(256 * (centres[at] + 0.02 * draw.normal(size=8))).astype(int).tolist()))
    read, inner = [], hardneg.staged

    def watched(df, name):
        out = inner(df, name)
        if name == "hardneg-wanted":
            read.append(out.count())
        return out

    monkeypatch.setattr(hardneg, "staged", watched)
    got = sorted(map(tuple, hardneg.mine(frame(spark, rows)).collect()))
    # of about 125 blocks: those of the label that reach the floor, and those of labels that meet a window
    assert got == plain(rows) and read[0] < 12 and read[1] < 80


def test_query_against_sql(spark, tmp_path):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(8)], draw.randint(0, 9), 1, 1, "", 1, 1) for i in range(900)]
    rows += [(None, [1.0] * 8, 1, 1, 1, "", 1, 1), (901, None, 1, 1, 1, "", 1, 1), (1000, [0.5] * 8, None, 1, 1, "", 1, 1), (1100, [None] * 8, 3, 1, 1, "", 1, 1)]
    rows += [(1200, [float("nan")] * 8, 3, 1, 1, "", 1, 1), (1300, [float("inf")] * 8, 3, 1, 1, "", 1, 1), (1400, [0.0] * 8, 3, 1, 1, "", 1, 1)]
    rows += [(1500 + i, [0.25, -0.5], i % 4, 1, 1, "", 1, 1) for i in range(12)] + [(1600, [], 4, 1, 1, "", 1, 1), (1601, [], 4, 1, 1, "", 1, 1), (1602, [], 5, 1, 1, "", 1, 1)]
    rows += [(2000 + i, rows[100][1], 9 if i % 3 else 4, 1, 1, "", 1, 1) for i in range(40)]  # copies of one vector
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.execute(hardneg.check_sql())
    names = [d[0] for d in want.description]
    got = queries.op11_zone_negatives(spark, str(tmp_path))
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.filter("anchor_id = 1600").select("negative_id").collect() == [(1602,)]


def test_empty_tables(spark):
    rows = frame(spark, [(1, 1, True, [1, 2]), (2, 2, False, [1, 2]), (None, 1, True, [3, 4]), (4, 1, None, None)])
    assert hardneg.mine(rows.limit(0)).collect() == [] and hardneg.mine(rows).collect() == []
    assert hardneg.mine(rows.withColumn("anchor", F.lit(None).cast("boolean"))).collect() == []
