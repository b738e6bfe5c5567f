"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product exceeds a level. The directions are a
product code: the rotated space is cut into blocks of dimensions, each with a small random codebook, and
every choice of one word per block is a direction. A vector is decoded to the list of all directions it
exceeds, without looking at the others: sums over half of the blocks are sorted and matched with the sums
over the other half. A vector passes its LEAST best filters. Vectors at a small angle pass common filters;
they meet there and are compared.

The size of the codebooks follows the number of vectors, so that a filter holds few unrelated ones at any
scale. Several codes with independent rotations are used. As a rotation is random, any pair with the cosine of
the limit shares no filter of one code with the same probability, which is measured on random pairs for the
dimension and codebooks at hand; the number of codes keeps its power below MISS.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import components, staged

CUT = 0.95
PARTS = 4
LEAST = 12  # filters of a code that every vector passes: the best ones
SPREAD = 6  # directions of a code per vector in the corpus
MISS = 1e-6  # probability that a pair at the limit is missed
TRIALS = 2000  # random pairs that the miss probability of one code is measured on
BLOCK = 512
SEED = 5


class Code:
    """The product code for vectors of one length."""

    def __init__(self, size: int, words: int, number: int = 0):
        random = np.random.Generator(np.random.PCG64([SEED, size, words, number]))
        turn, upper = np.linalg.qr(random.normal(size=(size, size)))
        self.turn = turn * np.sign(np.diag(upper))  # so signed, rotations are uniform
        edges = np.linspace(0, size, PARTS + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges, edges[1:])]
        self.books = [random.normal(size=(words, p.stop - p.start)) for p in self.parts]
        self.words = words
        # Inner products with directions of normal components are normal with variance one.
        self.level = NormalDist().inv_cdf(1 - min(0.5, 2 * LEAST / words**PARTS))

    def passed(self, unit: np.ndarray) -> np.ndarray:
        """The filters of one unit vector, by number."""
        turned = self.turn @ unit
        scores = [book @ turned[p] for p, book in zip(self.parts, self.books)]
        left = (scores[0][:, None] + scores[1][None, :]).ravel()
        right = (scores[2][:, None] + scores[3][None, :]).ravel()
        by_left, by_right = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
        ordered_left, ordered_right = left[by_left], right[by_right]
        level = self.level
        while True:
            reach = np.searchsorted(-ordered_right, ordered_left - level, side="right")
            found = int(reach.sum())
            if found >= min(LEAST, self.words**PARTS):
                break
            level -= 0.15
        rows = np.repeat(np.arange(len(reach)), reach)
        columns = np.arange(found) - np.repeat(np.cumsum(reach) - reach, reach)
        best = np.argsort(-(ordered_left[rows] + ordered_right[columns]), kind="stable")[:LEAST]
        return by_left[rows[best]] * self.words**2 + by_right[columns[best]]


def missed(size: int, words: int, cut: float, trials: int = TRIALS) -> float:
    """An upper estimate of the probability that two vectors with cosine *cut* share no filter of one code."""
    random = np.random.Generator(np.random.PCG64([SEED, size, words, trials]))
    apart = 0
    for trial in range(trials):
        if trial % (trials // 4) == 0:
            code = Code(size, words, 1_000_000 + trial)
        x, y = random.normal(size=(2, size))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y = cut * x + math.sqrt(1 - cut * cut) * y / max(np.linalg.norm(y), 1e-300) if size > 1 else x
        apart += not np.intersect1d(code.passed(x), code.passed(y)).size
    return min(0.999, (apart + 2 * math.sqrt(apart) + 3) / trials)


@functools.lru_cache(maxsize=1000)
def codes_needed(size: int, words: int, cut: float) -> int:
    """As many codes as miss a pair at the limit with at most MISS."""
    return math.ceil(math.log(MISS) / math.log(missed(size, words, cut)))


def _filtered(words: int, needed: dict[int, int]):
    """*needed*: the number of codes for vectors of each length."""
    codes: dict[int, list[Code]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                filters, rows = [], []
                for i, v in enumerate(part["embedding"]):
                    x = np.array(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                    x /= np.abs(x).max()
                    several = codes.get(len(x))
                    if several is None:
                        several = codes[len(x)] = [Code(len(x), words, k) for k in range(needed[len(x)])]
                    unit = x / np.linalg.norm(x)
                    found = np.concatenate([code.passed(unit) * len(several) + k for k, code in enumerate(several)])
                    filters.append(found * 4096 + len(x) % 4096)
                    rows.append(np.full(len(found), i))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(filters)), part["vec_id"].take(take), part["embedding"].take(take)],
                    ["filter", "vec_id", "embedding"],
                )

    return run


def _compared(cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for name in ("members_a", "members_b"):
                    members = batch[name][row].values
                    ids = members.field("vec_id").to_numpy()
                    vectors = members.field("embedding")
                    length = np.diff(vectors.offsets.to_numpy())
                    sides.append((ids, length, vectors))
                same = batch["same"][row].as_py()
                (ids_a, length_a, va), (ids_b, length_b, vb) = sides
                if len(ids_a) * len(ids_b) == 1 and same:
                    continue
                for size in np.unique(length_a):
                    at_a, at_b = np.flatnonzero(length_a == size), np.flatnonzero(length_b == size)
                    if not len(at_b):
                        continue
                    a, b = (_units(v, at, size) for v, at in ((va, at_a), (vb, at_b)))
                    x, y = np.nonzero(a @ b.T >= cut)
                    left, right = ids_a[at_a[x]], ids_b[at_b[y]]
                    keep = left < right if same else left != right
                    left, right = left[keep], right[keep]
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    return run


def _units(vectors: pa.ListArray, at: np.ndarray, size: int) -> np.ndarray:
    rows = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def linked(vectors: DataFrame, cut: float = CUT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of *vectors* (vec_id, embedding).

    Pairs with a cosine of at least *cut*, in double precision, are links. Equal vectors are compared once
    and counted as often as they stand. NULL and zero vectors and those with a component that is NULL or
    not finite link with nothing, vectors of different length neither. Rows of one vec_id are one vector, the
    smallest of theirs; rows without vec_id have no links and a NULL component, and are kept. An empty table
    gives an empty result; other columns are ignored. vec_id is an integer.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    one_each = rows.filter(F.col("vec_id").isNotNull() & usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    kinds = one_each.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    one_each, kinds = staged(one_each, "vectors"), staged(kinds, "vector-kinds")
    count = kinds.count()
    words = max(16, math.ceil((SPREAD * max(count, 1)) ** (1 / PARTS)))
    lengths = [r.size for r in kinds.select(F.size("embedding").alias("size")).distinct().collect()]
    needed = {size: codes_needed(size, words, cut) for size in lengths}
    members = staged(
        kinds.select(F.col("first").alias("vec_id"), "embedding")
        .mapInArrow(_filtered(words, needed), "filter bigint, vec_id bigint, embedding " + rows.schema["embedding"].dataType.simpleString()),
        "vector-filters",
    )
    sizes = members.groupBy("filter").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("bigint").alias("blocks"), F.count(F.lit(1)).alias("size"))
    blocks = staged(
        members.join(sizes.filter("size > 1"), "filter")
        .groupBy("filter", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "embedding")).alias("members")),
        "vector-blocks",
    )
    left = blocks.select("filter", F.col("block").alias("block_a"), F.col("members").alias("members_a"))
    right = blocks.select("filter", F.col("block").alias("block_b"), F.col("members").alias("members_b"))
    links = staged(
        left.join(right, "filter").filter("block_a <= block_b")
        .select("members_a", "members_b", (F.col("block_a") == F.col("block_b")).alias("same"))
        .mapInArrow(_compared(cut), "a bigint, b bigint").distinct(),
        "vector-links",
    )
    copies = kinds.select(F.col("first").alias("other"), F.col("copies"))
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    neighbours = both.join(copies, F.col("b") == F.col("other")).groupBy(F.col("a").alias("first")).agg(F.sum("copies").alias("near"))
    labels = components(links)
    found = (
        kinds.join(neighbours, "first", "left").join(labels, F.col("first") == F.col("node"), "left")
        .select("embedding", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"), F.coalesce("component", "first").alias("component"))
    )
    by_id = one_each.join(found, "embedding").select(F.col("vec_id").alias("id"), "links", "component")
    return (
        rows.select("vec_id").join(by_id, F.col("vec_id") == F.col("id"), "left")
        .select(
            "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )


def check_sql(table: str = "embeddings", cut: float = CUT) -> str:
    """The rows of ``op4_cap_filters`` in DuckDB: all pairs, and their closure."""
    return f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM {table}
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= {cut}),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM {table} UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT t.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, t.vec_id = component_id AS kept
FROM {table} t JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) USING (vec_id)
 LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
